import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from zipfloom.llm import encoding as E

pytestmark = pytest.mark.skipif(not os.path.exists(E.DEFAULT_VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def merges():
    return E.Merges()


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(E.DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    return t


def both(merges, public, texts):
    flat, count = E.Encoder(merges).encode(texts)
    ours = [x.tolist() for x in np.split(flat, np.cumsum(count)[:-1])]
    return ours, [e.ids for e in public.encode_batch([t or "" for t in texts], add_special_tokens=False)]


CASES = [
    None, "", " ", "\n\n", "a", "aaaaaaaaaaa", "don't we'll I'M", "Straße über ñandú — “x”", "Привет, мир!", "漢字 字漢",
    "🙂🤷🏽‍♂️​\xa0", "<|endoftext|> x", "x" * 5000, "ab" * 4000, " " * 3000, "1234567890" * 50, "\t\r\n mixed \t ws  ", "é",
]


def test_cases_equal_the_public_library(merges, public):
    ours, theirs = both(merges, public, CASES)
    assert ours == theirs
    assert ours[0] == [] and ours[1] == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=6))
def test_any_text(merges, public, texts):
    ours, theirs = both(merges, public, texts)
    assert ours == theirs


def test_long_words_merge_alike(merges):
    rng = np.random.default_rng(1)
    word = bytes(rng.choice(np.frombuffer(b"abcdeent his", np.uint8), 1800))
    ids, _ = E.merge_words(merges, [word])
    assert ids.tolist() == E._merge_long(merges, word).tolist()


def test_small_chunks(merges, monkeypatch):
    whole = E.Encoder(merges).encode(["one two", None, "three"])
    monkeypatch.setattr(E, "CHARS_AT_ONCE", 3)
    parts = E.Encoder(merges).encode(["one two", None, "three"])
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()


def test_dataframe(spark, public):
    df = spark.createDataFrame([(1, "Hello there", "x"), (2, None, "y"), (3, "", "z"), (None, "same", "z")], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in E.encode_texts(df, ["doc_id"]).collect()}
    assert got == {1: public.encode("Hello there").ids, 2: [], 3: [], None: public.encode("same").ids}
    assert E.encode_texts(df.limit(0), ["doc_id"]).count() == 0
    assert sorted(r["n_tokens"] for r in E.count_tokens(df, ["doc_id"]).collect()) == [0, 0, 1, 2]


def test_documents(spark, sf, public):
    from zipfloom.llm.queries import p7_ids
    from zipfloom.runtime import table

    text = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    got = {r["doc_id"]: r["ids"] for r in p7_ids(spark, sf).collect()}
    assert got.keys() == text.keys()
    for k, ids in got.items():
        assert ids == public.encode(text[k] or "", add_special_tokens=False).ids
