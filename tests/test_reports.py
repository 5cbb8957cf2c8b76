import pytest

from zipfloom.operators import choice as G
from zipfloom.operators import reports as R

NAN = float("nan")
SCORES = "phenomenon string, subtask string, good_total_nll double, bad_total_nll double, good_text string, bad_text string, good_token_count int, bad_token_count int"


def scores(spark, rows):
    return spark.createDataFrame([(p, s, g, b, "ab", "abcd", n, 2) for p, s, g, b, n in rows], SCORES)


def test_accuracy(spark):
    df = scores(spark, [("p", "s", 1.0, 2.0, 2), ("p", "s", 2.0, 2.0, 2), ("", None, 3.0, 2.0, 0), ("p", "t", 1.0, NAN, 2), ("p", "t", None, 2.0, 2)])
    got = {(r["level"], r["phenomenon"], r["subtask"]): (r["correct"], r["total"]) for r in R.accuracy(df).collect()}
    assert got["overall", None, None] == (1, 4) and got["phenomenon", "unknown", None] == (0, 1) and got["phenomenon_subtask", "p", "t"] == (0, 1)
    per_token = {r["level"]: r["total"] for r in R.accuracy(df, "token").where("level = 'overall'").collect()}
    assert per_token == {"overall": 3}
    assert R.accuracy(df.limit(0)).where("level <> 'overall'").count() == 0


def test_apportionment(spark):
    df = spark.createDataFrame([("a", 3), ("b", 3), ("c", 4)], "key string, n bigint")
    assert {r["key"]: r["quota"] for r in R.apportion(df, 5).collect()} == {"a": 1, "b": 2, "c": 2}
    assert {r["key"]: r["quota"] for r in R.apportion(df, 99).collect()} == {"a": 3, "b": 3, "c": 4}


def test_bins(spark):
    x = [1.0, 2.0, 2.0, 3.5, 4.123456, 5.0, 6.7, 7.1, 8.8, 9.9]
    df = spark.createDataFrame([(v, 1.0) for v in x], "x double, y double")
    edges = R.quantile_edges(df, "x", 4)
    rows = df.withColumn("b", R.bin_of("x", edges)).orderBy("x").collect()
    assert [r["b"] for r in rows] == [0, 0, 0, 1, 1, 2, 2, 3, 3, 3]
    mids = {r["bin"]: r["mid"] for r in R.binned(df, "x", "y", [], q=4, least=1).collect()}
    assert mids == {0: 1.687, 1: 3.4685, 2: 5.781, 3: 8.45}
    assert R.quantile_edges(df.limit(0), "x", 4) == []


def test_spearman(spark):
    df = spark.createDataFrame(list(zip([1.0, 2.0, 2.0, 4.0, 5.0], [3.0, 1.0, 2.0, 9.0, 4.0])), "x double, y double").withColumn("g", R.F.lit("g"))
    r = R.spearman(df, "x", "y", ["g"]).first()
    assert r["rho"] == pytest.approx(0.564288, abs=1e-6) and 0 < R.fisher_p(r["rho"], r["n"]) < 1
    assert R.spearman(df.limit(2), "x", "y", ["g"]).first()["rho"] is None


def test_merged_bins(spark):
    df = spark.createDataFrame([("m", 2.0, 10.0, 1), ("m", 2.0, 20.0, 3)], "label string, mid double, mean double, n bigint")
    assert R.merge_series(df, R.F.col("label")).first()[2:] == (17.5, 4)


def test_zipf_aggregates(spark):
    lex = spark.createDataFrame([("three", 3.0), ("five", 5.0)], "word string, zipf double")
    words = spark.createDataFrame([(1, "r", "none"), (1, "r", "Three"), (1, "r", "five"), (2, "r", "none")], "record_id bigint, role string, word string")
    got = {r["record_id"]: tuple(r)[2:] for r in R.zipf_aggregates(words, lex).collect()}
    assert got == {1: (2, 1, 4.0, 4.0, 3.0), 2: (0, 1, None, None, None)}


def test_fields_and_variants(spark):
    df = spark.createDataFrame([(None, "g", None), (None, "g", "b")], "good_freq string, good_original string, bad_original string")
    assert R.pick_field(df, ["good_freq", "good_original"]) == "good_original" and R.pick_field(df, ["zz"]) is None
    assert R.scorable_variant(df) == ["original"] and R.scorable_variant(df, "both") == ["original"] and R.scorable_variant(df, "freq") == []


def test_choice_follows_the_weights(spark):
    pool = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.5)], "lemma string, zipf double")
    items = spark.range(6000).withColumnRenamed("id", "k")
    n = {r["lemma"]: r["count"] for r in G.pick_weighted(items, pool, ["k"], 3).groupBy("lemma").count().collect()}
    w = {"a": 10.0, "b": 100.0, "c": 10**2.5}
    assert sum(n.values()) == 6000
    for k, x in w.items():
        assert n[k] / 6000 == pytest.approx(x / sum(w.values()), abs=0.03)
    u = {r["lemma"]: r["count"] for r in G.pick_uniform(items, pool, [], ["k"], 3).groupBy("lemma").count().collect()}
    assert all(abs(v - 2000) < 200 for v in u.values())
    assert G.pick_uniform(items, pool.limit(0), [], ["k"], 3).count() == 0


def test_scorer(spark):
    from zipfloom.operators import scoring as K

    class Length:
        def score(self, texts):
            return [(float(len(t)), len(t.split())) for t in texts]

    texts = spark.createDataFrame([("one two",), ("x",), (None,)], "text string")
    assert sorted(map(tuple, K.score_texts(texts, Length, batch=1).collect())) == [("one two", 7.0, 2), ("x", 1.0, 1)]


def test_running_accuracy(spark, sf, tmp_path):
    from zipfloom.runtime import table
    from zipfloom.streaming.accuracy import running_accuracy

    src = table(spark, sf, "pair_score")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = running_accuracy(stream).writeStream.outputMode("update").format("memory").queryName("acc").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select sum(total) from acc").first()[0]
    want = src.where("good_total_nll is not null and bad_total_nll is not null and scored_at is not null").select("score_id").distinct().count()
    assert got == want
