import pytest

from zipfloom.llm import language as L
from zipfloom.runtime import table

LABELS = {"en_US": "en", " EN ": "en", "ger": "de", "Deutsch": "de", "pt-BR": "pt", "Français": "fr", "dut": "nl", "und": None,
          "??": None, "": None, None: None, "null": None, "English (UK)": "en", "xx": None}


def test_labels():
    assert {k: L.label_language(k) for k in LABELS} == LABELS


def test_sentences_and_words():
    text = "idx=3 nll=5.1\nIs it so? Yes, it is. 3/64 <p>"
    assert [(text[a:b].strip(), w) for a, b, w in L.split_sentences(text)] == [
        ("idx=3 nll=5.1", False), ("Is it so?", True), ("Yes, it is.", True), ("3/64 <p>", False)]
    assert L.words_of('The note says “la soglia” here {"i": 1} 0xab12 x=1.') == ["the", "note", "says", "here"]


def test_codes_have_no_language():
    assert L.named_sentences(None, [None, "", "0x12 3/64\n-----"]) == [[], [], [L.Stretch(0, 10), L.Stretch(10, 15)]]


def test_nothing_is_cut():
    word = "a" * 70 + "b" * 70
    assert len(L.subwords(word)) == 1 + sum(142 - n + 1 for n in L.NGRAMS) and L.subwords(word) != L.subwords(word + "c")
    for n in (199, 201, 5000):
        assert L.words_of(f"One “{'x ' * n}” two <p {'y ' * n}> three {{{'z ' * n}}}.") == ["one", "two", "three"]
    assert [w for _, _, w in L.split_sentences("他们 知道。 真的 吗？")] == [True, True]


@pytest.fixture(scope="module")
def model(spark):
    return L.train(table(spark, "/root/testdata/sf0.01", "documents"), limit=700)


def test_held_out_accuracy(spark, model):
    """Labels of other documents, which are right for all but a few percent."""
    docs = table(spark, "/root/testdata/sf0.1", "documents").where("doc_id % 5 = 0")
    got = L.name_languages(docs, model).where("label_lang is not null and lang is not null").collect()
    assert sum(r["label_lang"] == r["lang"] for r in got) / len(got) > 0.9
    single = [r for r in got if r["status"] != "mixed"]
    assert sum(r["confidence"] > 0.8 for r in single) / len(single) > 0.95


def test_cases(spark, model):
    rows = [
        (1, "en", "Nobody knows why the parser skipped the old threshold."),
        (2, "de", "Nobody knows why the parser skipped the old threshold."),
        (3, None, "Niemand weiß, warum der Parser den alten Schwellenwert prüfte."),
        (4, "en", "Nobody knows why the parser skipped the old threshold. Niemand weiß, warum der Parser den alten Schwellenwert prüfte."),
        (5, None, None), (6, "xx", ""), (7, "xx", "0x1 3/64"), (8, "en", "It is not clear. " * 5000),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, lang string, text string, status string")
    loose = "Niemand weiß warum der Parser den alten Schwellenwert prüfte"
    more = spark.createDataFrame([(9, None, loose), (10, "de", f"- {loose}\n- Nobody knows why the parser skipped the old threshold")], "doc_id bigint, lang string, text string")
    lines = {r["doc_id"]: r for r in L.name_languages(more, model).collect()}
    assert lines[9]["lang"] == "de" and lines[9]["status"] == "no_sentence" and lines[9]["confidence"] > 0.6
    assert [s["lang"] for s in lines[10]["stretches"]] == ["de", "en"]
    assert L.label_cases(L.name_languages(more, model)).count() == 0
    named = L.name_languages(df, model)
    status = {r["doc_id"]: r["status"] for r in named.collect()}
    assert status == {1: "right", 2: "wrong", 3: "missing", 4: "mixed", 5: "no_sentence", 6: "no_sentence", 7: "no_sentence", 8: "right"}
    assert {tuple(r) for r in L.label_cases(named).collect()} == {(2, "en"), (3, "de"), (4, "en"), (4, "de")}
    four = next(r for r in named.collect() if r["doc_id"] == 4)
    assert [s["lang"] for s in four["stretches"]] == ["en", "de"]


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id bigint, lang string, text string")
    assert L.train(none) is None and L.name_languages(none, None).count() == 0
    one = spark.createDataFrame([(1, "en", "It is so.")], "doc_id bigint, lang string, text string")
    assert L.name_languages(one, L.train(one)).collect()[0]["status"] == "unsure"
