import io
import json
import tarfile
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from zipfloom.sources import archive, config, documents, files, jsonl, markup

SCHEMA = StructType([StructField("a", IntegerType()), StructField("b", StringType())])


def test_tolerant_scan(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1, "b": "x"}\n\nnot json\n{"a": "text", "b": "y"}\n[1]\n{"a": 2}\n')
    got = [(r["_row"], r["a"], r["b"]) for r in jsonl.read_tolerant(spark, str(p), SCHEMA).orderBy("_row").collect()]
    assert got == [(0, 1, "x"), (3, None, "y"), (5, 2, None)]
    assert jsonl.read_tolerant(spark, str(p), SCHEMA, physical_limit=3).count() == 1
    assert jsonl.read_tolerant(spark, str(p), SCHEMA, record_limit=2).count() == 2
    with pytest.raises(Exception):
        jsonl.read_strict(spark, str(p), SCHEMA).collect()


def test_line_numbers_over_splits(spark, tmp_path):
    p = tmp_path / "big.txt"
    p.write_text("".join(f"line {i}\n" for i in range(5000)))
    (tmp_path / "small.txt").write_text("line 0\nline 1\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        rows = jsonl.numbered_lines(spark, str(tmp_path / "*.txt")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 5002 and all(r["value"] == f"line {r['_row']}" for r in rows)


def test_sink_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "ü")], "a int, good_original string, good_freq string")
    jsonl.write_jsonl(df, str(tmp_path / "o"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "o").glob("part-*.json"))
    assert json.loads(text) == {"a": 1, "good_original": None, "good_freq": "ü"} and "ü" in text
    g, o = jsonl.split_outputs(df)
    assert g.columns == ["a", "good_freq"] and o.columns == ["a", "good_original"]
    files.write_once(df, str(tmp_path / "o"))
    back = spark.read.json(str(tmp_path / "o"))
    files.rewrite(back.withColumn("b", back.a + 1), str(tmp_path / "o"), backup=True)
    assert spark.read.json(str(tmp_path / "o")).first()["b"] == 2 and (tmp_path / "o.bak").exists()


def test_names_and_paths(spark, tmp_path):
    name = "x/20240102-030405_my-model_20240101-000000_zw_2p2_3p0_freq_pair-scores.jsonl"
    r = spark.createDataFrame([(name,), ("odd",)], "p string").select(*files.score_file_dims("p")).collect()
    assert tuple(r[0]) == ("20240102-030405", "my-model", "20240101-000000_zw_2p2_3p0", "freq") and tuple(r[1]) == (None,) * 4
    for n in ("20240101-000000_a.jsonl", "20240102-000000_a.jsonl", "20240102-000000_b.jsonl", "c.jsonl"):
        (tmp_path / n).touch()
    assert [p[-8:] for p in files.collect_paths(str(tmp_path))] == ["_a.jsonl"[-8:], "_b.jsonl"[-8:]]
    assert len(files.collect_paths(str(tmp_path), timestamp="20240101-000000")) == 1


def test_configuration(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("phenomena:\n  g1:\n    phenomenon: p1\n    configs:\n      - s1\n      - s2\n  g2:\n    configs: [s3]\n")
    rows = [tuple(r) for r in config.task_config(spark, str(tmp_path / "c.yaml")).orderBy("ord").collect()]
    assert rows == [("g1", "p1", "s1", 0), ("g1", "p1", "s2", 1), ("g2", "g2", "s3", 2)]
    assert config._simple_yaml((tmp_path / "c.yaml").read_text()) == config.parse_yaml((tmp_path / "c.yaml").read_text())
    (tmp_path / "q.yaml").write_text('count_triggers: ["many", "a"]\nmass_triggers: ["much"]\n')
    assert config.quantifiers(spark, str(tmp_path / "q.yaml")).count() == 3
    (tmp_path / "f.json").write_text('{"s1": " syntax_semantics ", "s2": "", "s3": 4}')
    static = config.static_field_map(spark, str(tmp_path / "f.json"))
    assert [tuple(r) for r in static.collect()] == [("s1", "syntax/semantics")]
    assert config.static_field_map(spark, str(tmp_path / "none.json")).count() == 0
    cached = spark.createDataFrame([("s1", "new"), ("s9", "x")], "subtask string, field string")
    assert {tuple(r) for r in config.resolve_fields(static, cached).collect()} == {("s1", "new"), ("s9", "x")}
    (tmp_path / "b.tsv").write_text("lemma\tcls\nDog\tcount\nair\tMASS\ndog\tflex\nx\tzzz\n")
    assert {tuple(r) for r in config.count_classes(spark, str(tmp_path / "b.tsv")).collect()} == {("dog", "FLEX"), ("air", "MASS"), ("x", "UNKNOWN")}


def test_lexical_files(spark, tmp_path):
    inv = [{"lemma": "Run", "frames": [{"type": "intr"}, {"type": "odd"}, {"type": "intr_pp", "preposition": "At"}]}, {"lemma": "no", "frames": []}]
    (tmp_path / "i.json").write_text(json.dumps(inv))
    f = config.verb_inventory(spark, str(tmp_path / "i.json"))
    assert {(r["lemma"], r["kind"], r["prep"]) for r in f.collect()} == {("run", "intr", None), ("run", "intr_pp", "at")}
    config.write_verb_inventory(f, str(tmp_path / "out"))
    assert config.verb_inventory(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "g.json").write_text('{"lemmas": {"female": ["Queen"], "male": ["king", "queen"]}}')
    assert {tuple(r) for r in config.lemma_gender(config.gender_lexicon(spark, str(tmp_path / "g.json"))).collect()} == {("queen", "female"), ("king", "male")}
    assert config.gender_lexicon(spark, "/none").count() == 0
    (tmp_path / "w.json").write_text('{"that": ["say"], "wh": {"what": ["know"]}, "meta": {"x": 1}}')
    assert {(r["list_name"], r["lemma"]) for r in config.clause_lists(spark, str(tmp_path / "w.json")).collect()} == {("that", "say"), ("wh.what", "know")}
    t = pa.table({"field": ["b", "", None, "a"]})
    with pa.OSFile(str(tmp_path / "x.arrow"), "wb") as out, pa.ipc.new_stream(out, t.schema) as w:
        w.write_table(t)
    assert config.arrow_field(str(tmp_path / "x.arrow")) == "a" and config.arrow_field("/none") is None
    lex = spark.createDataFrame([("Dog", "n"), ("cat", "n"), ("x-y", "n"), ("go", "v")], "lemma string, pos string")
    assert [r["lemma"] for r in config.lexicon_lemmas(lex, "n").orderBy("ord").collect()] == ["cat", "dog"]


def test_archive(spark, tmp_path):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("b.txt", "1\tThe\tthe\tAT\nbroken line\n1\tdog\tdog\tNN1\n")
        f.writestr("a.txt", "2\tsaid\tSay\tVVD\n")
    with tarfile.open(tmp_path / "c.tar", "w") as tar:
        info = tarfile.TarInfo("m.zip")
        info.size = len(z.getvalue())
        tar.addfile(info, io.BytesIO(z.getvalue()))
    spark.dataSource.register(archive.TokenArchive)
    rows = spark.read.format("token_archive").load(str(tmp_path / "c.tar")).collect()
    assert sorted((r["file"], r["line_no"], r["lemma"], r["pos"]) for r in rows) == [("m.zip/a.txt", 0, "say", "vvd"), ("m.zip/b.txt", 0, "the", "at"), ("m.zip/b.txt", 2, "dog", "nn1")]


PAGE = """<page><title>{}</title><ns>{}</ns>{}<revision><text>==English== ===Noun=== {}</text></revision></page>"""


def test_pages(spark, tmp_path):
    pages = [("queen", 0, "", "[[Category:en:Women]]"), ("king", 0, "", "{{C|en|Men|Family}}"), ("duke", 0, "", "{{topics|en|male rulers}}"),
             ("lord", 0, '<redirect title="x"/>', "[[Category:en:Men]]"), ("talk", 1, "", "[[Category:en:Men]]"), ("rude", 0, "", "[[Category:en:Men]] {{lb|en|vulgar}}"), ("plain", 0, "", "")]
    (tmp_path / "w.xml").write_text("<mediawiki>" + "".join(PAGE.format(*p) for p in pages) + "</mediawiki>")
    got = markup.wiki_pages(spark, str(tmp_path / "w.xml"))
    assert got.count() == 7 and got.where("redirect").count() == 1
    assert {tuple(r) for r in markup.gendered_lemmas(got).collect()} == {("queen", "female"), ("king", "male"), ("duke", "male")}


def test_verb_classes(spark, tmp_path):
    xml = """<VNCLASS ID="x"><MEMBERS><MEMBER name="put"/><MEMBER name="give_up"/></MEMBERS><FRAMES>
      <FRAME><SYNTAX><NP value="Agent"/><VERB/><NP value="Theme"/></SYNTAX></FRAME>
      <FRAME><SYNTAX><NP value="Agent"/><VERB/><PREP value="on|in"/><NP value="Place"/></SYNTAX></FRAME></FRAMES></VNCLASS>"""
    (tmp_path / "v.xml").write_text(xml)
    got = {(r["lemma"], r["kind"], r["prep"], r["particle"]) for r in markup.verb_classes(spark, str(tmp_path / "v.xml")).collect()}
    assert got == {("put", "trans", None, None), ("put", "intr_pp", "on", None), ("give", "trans_particle", None, "up"), ("give", "intr_pp", "on", "up")}


def test_templates(spark):
    rows = [("Somebody ----s something on somebody",), ("Somebody ----s",), ("Somebody ----s somebody something",), ("It is ----ing on something",), ("nothing",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(markup.frame_of_template("t", ["on", "to"])).collect()]
    assert [g and tuple(g) for g in got] == [("ditrans_pp", "on"), ("intr", None), ("ditrans", None), ("intr_pp", "on"), None]


def test_report_sinks(spark, tmp_path, sf):
    from zipfloom.operators.reports import accuracy
    from zipfloom.runtime import table

    acc = accuracy(table(spark, sf, "pair_score"))
    doc = documents.report_document(acc)
    assert doc["total"] == sum(r["total"] for r in doc["subtask"]) and doc["phenomenon"]
    documents.write_document({"x": float("nan"), **doc}, str(tmp_path / "r" / "a.json"))
    assert json.loads((tmp_path / "r" / "a.json").read_text())["x"] is None
    documents.write_csv(acc, str(tmp_path / "csv"))
    assert documents.read_csv(spark, str(tmp_path / "csv")).count() == acc.count()
    wide = documents.pivot_table(acc.where("level = 'phenomenon'"), "level", "phenomenon", ["case_marking"])
    assert documents.fixed_width(wide).startswith("level")
