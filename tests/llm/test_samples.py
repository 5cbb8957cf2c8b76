from collections import Counter

import numpy as np
import pandas as pd
import pytest

from zipfloom.llm import balanced as B
from zipfloom.llm import mixing as M

TARGETS = "plan_name string, category string, target_share double, min_rows bigint, sample_size bigint"


def population(spark, sizes):
    rows = [("p", c, i * 1000 + k) for i, (c, n) in enumerate(sizes.items()) for k in range(n)]
    return spark.createDataFrame(rows, "plan_name string, category string, unit bigint").repartition(5)


def test_allocation():
    got = B.allocate(np.array([0.5, 0.3, 0.2]), np.array([0, 0, 30]), np.array([20, 1000, 1000]), 100)
    assert got.sum() == pytest.approx(100) and got[0] == 20 and got[2] >= 30
    assert B.allocate(np.array([0.0]), np.array([5]), np.array([3]), 10).tolist() == [3]


def test_pivot_keeps_means():
    rng = np.random.default_rng(0)
    for a, b in [(0.3, 0.4), (0.7, 0.6), (0.5, 0.5), (0.2, 0.8)]:
        got = np.array([B._pivot(a, b, u) for u in rng.random(20000)])
        assert np.allclose(got.mean(axis=0), [a, b], atol=0.02)
        assert np.allclose(got.sum(axis=1), a + b)


def test_sample_meets_targets(spark):
    sizes = {"hot": 900, "mid": 300, "small": 4}
    t = spark.createDataFrame(
        [("p", "hot", 0.611, 0, 151), ("p", "mid", 0.289, 10, 151), ("p", "small", 0.1, 20, 151), ("p", "none", None, 7, 151), ("q", "x", 0.5, 1, None)],
        TARGETS,
    )
    for seed in (0, 1):
        sample, report, _ = B.cube_sample(population(spark, sizes), t, seed)
        rows = sample.collect()
        assert len(rows) == len({r["unit"] for r in rows}) == 151
        n = Counter(r["category"] for r in rows)
        by = {(r["plan_name"], r["category"]): r for r in report.collect()}
        assert n["small"] == 4 and not by["p", "small"]["met"] and by["p", "hot"]["met"]
        assert by["p", "none"]["drawn"] == 0 and not by["p", "none"]["met"]
        assert all(abs(r["imbalance"]) < 1 for r in by.values())
        assert {r["unit"] for r in B.cube_sample(population(spark, sizes), t, seed).sample.collect()} == {r["unit"] for r in rows}


def test_the_report_judges_the_drawn_rows(spark, monkeypatch):
    """Minima that take another category's rows, minima beyond the size, and a flight that is switched off."""
    rows = [("p", "a", 0.9, 0, 1000), ("p", "b", 0.1, 500, 1000), ("q", "a", 0.5, 800, 1000), ("q", "b", 0.5, 800, 1000), ("r", "a", 0.5, 0, 4000)]
    t = spark.createDataFrame(rows, TARGETS)
    units = population(spark, {"a": 1500, "b": 900})
    every = units.union(units.selectExpr("'q'", "category", "unit")).union(units.selectExpr("'r'", "category", "unit"))
    by = {(r["plan_name"], r["category"]): r for r in B.cube_sample(every, t).report.collect()}
    assert by["p", "a"]["reason"] == "displaced" and by["p", "b"]["met"] and by["p", "a"]["drawn"] == 500
    assert by["q", "a"]["drawn"] == 800 and by["q", "a"]["met"] and by["q", "a"]["planned"] == 1600
    assert by["r", "a"]["reason"] == "short" and by["r", "a"]["drawn"] == 1500
    monkeypatch.setattr(B, "judged", lambda df: JUDGED(df.withColumn("drawn", df["drawn"] * 0)))
    off = B.cube_sample(every, t).report.collect()
    assert not any(r["reason"] == "short" for r in off) and not any(r["met"] for r in off)


JUDGED = B.judged


def test_layout_does_not_matter(spark, monkeypatch):
    """Equal rows and seed give an equal sample over other partitions, batches and orders, also through merging levels."""
    monkeypatch.setattr(B, "CHUNK_RECORDS", 40)
    monkeypatch.setattr(B, "FAN_IN", 3)
    t = spark.createDataFrame([("p", "hot", 0.6, 0, 151), ("p", "mid", 0.4, 10, 151)], TARGETS)
    df = population(spark, {"hot": 900, "mid": 300}).selectExpr("*", "unit % 3 as third", "cast(unit % 7 as string) as week")
    draw = lambda x: {r["unit"] for r in B.cube_sample(x, t, 5, ("third", "week")).sample.collect()}
    one = draw(df)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        assert one == draw(df.repartition(2)) == draw(df.orderBy("unit").coalesce(1)) and len(one) == 151
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert one != {r["unit"] for r in B.cube_sample(df, t, 6, ("third", "week")).sample.collect()}


def test_several_columns_are_balanced_at_once(spark):
    t = spark.createDataFrame([("p", "hot", 0.6, 0, 240), ("p", "mid", 0.4, 0, 240)], TARGETS)
    df = population(spark, {"hot": 900, "mid": 300}).selectExpr("*", "unit % 4 as quarter", "cast(unit % 5 as string) as day")
    worst = []
    for seed in range(4):
        got = B.cube_sample(df, t, seed, ("quarter", "day"))
        worst += [abs(r["imbalance"]) for r in got.balance.collect()]
        assert sum(r["drawn"] for r in got.balance.collect()) == 3 * 240
    assert max(worst) <= 3


def test_flight_keeps_every_constraint_and_the_means():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 3, 40), rng.integers(0, 4, 40)
    m = np.array([np.ones(40), *[a == k for k in range(3)], *[b == k for k in range(4)]], float)
    p = rng.uniform(0.1, 0.9, 40)
    mean = np.zeros(40)
    for s in range(400):
        q = B.cube_flight(p, m, np.random.default_rng(s))
        assert np.allclose(m @ q, m @ p, atol=1e-6) and len(B._open(q)) <= len(m)
        mean += q / 400
    assert np.abs(mean - p).max() < 0.12


def test_inclusion_is_even(spark):
    t = spark.createDataFrame([("p", "a", 1.0, 0, 30)], TARGETS)
    hits = Counter()
    for seed in range(12):
        hits.update(r["unit"] for r in B.cube_sample(population(spark, {"a": 90}), t, seed)[0].collect())
    assert sum(hits.values()) == 360 and max(hits.values()) < 12 and len(hits) > 75


def test_empty_sides(spark):
    t = spark.createDataFrame([("p", "a", 1.0, 5, 30)], TARGETS)
    none = spark.createDataFrame([], "plan_name string, category string, unit bigint, extra int")
    sample, report, _ = B.cube_sample(none, t)
    assert sample.count() == 0 and report.collect()[0]["available"] == 0
    sample, report, _ = B.cube_sample(population(spark, {"a": 3}), t.limit(0))
    assert sample.count() == 0 and report.count() == 0
    nulls = spark.createDataFrame([(None, "a", 1), ("p", None, 2), ("p", "a", None), ("p", "a", 4)], "plan_name string, category string, unit bigint")
    assert [r["unit"] for r in B.cube_sample(nulls, t)[0].collect()] == [4]


def test_rounds_keep_mass_and_means():
    p, size = np.full(1000, 0.37), np.tile([3.0, 50.0, 7.0, 200.0], 250)
    total = np.zeros(1000)
    for s in range(200):
        got = M.pivotal_rounds(p, size, np.zeros(1000, int), np.random.default_rng(s))
        assert abs((got * size).sum() - (p * size).sum()) < 1e-6
        assert ((got > 1e-9) & (got < 1 - 1e-9)).sum() <= 1
        total += got
    assert abs(total.mean() / 200 - 0.37) < 0.01 and np.abs(total / 200 - 0.37).max() < 0.2


def docs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "hot", int(n)) for i, n in enumerate(rng.integers(1, 400, 1500))]
    rows += [(5000 + i, "small", int(n)) for i, n in enumerate(rng.integers(1, 100, 40))]
    rows += [(None, "hot", 5), (9001, None, 5), (9002, "hot", 0), (9003, "unweighted", 9), (9004, "hot", None)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint").repartition(6)


def test_mix_reaches_shares(spark):
    w = spark.createDataFrame([("hot", 3.0, 1), ("small", 1.0, 4), ("absent", 1.0, 9), ("small", 1.0, 4)], "source string, weight double, max_repeat int")
    mix, report = M.mix_sources(docs(spark), w)
    rows = mix.collect()
    by = {r["source"]: r for r in report.collect()}
    assert all(1 <= r["copies"] <= {"hot": 1, "small": 4}[r["source"]] for r in rows)
    assert by["small"]["most_copies"] == 4 and by["absent"]["short"] and by["absent"]["actual_share"] == 0
    assert abs(by["hot"]["taken_tokens"] - by["hot"]["goal_tokens"]) <= 400
    assert by["hot"]["actual_share"] == pytest.approx(0.75, abs=0.03)
    again = {(r["doc_id"], r["copies"]) for r in M.mix_sources(docs(spark), w)[0].collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in rows}


def test_mix_does_not_depend_on_layout_but_on_the_seed(spark, monkeypatch):
    monkeypatch.setattr(M, "CHUNK_DOCS", 100)
    monkeypatch.setattr(M, "FAN_IN", 4)
    w = spark.createDataFrame([("hot", 3.0, 1), ("small", 1.0, 4)], "source string, weight double, max_repeat int")
    draw = lambda df, seed=0: {(r["doc_id"], r["copies"]) for r in M.mix_sources(df, w, 40_000, seed)[0].collect()}
    one = draw(docs(spark))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    try:
        assert one == draw(docs(spark).orderBy("n_tokens").coalesce(1))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert one != draw(docs(spark), 1)
    # the root alone draws: one document of each source
    two = docs(spark).where("doc_id in (0, 5000)")
    assert len({frozenset(r["doc_id"] for r in M.mix_sources(two, w, 150, s)[0].collect()) for s in range(8)}) > 1


def test_repeated_documents_count_once(spark):
    w = spark.createDataFrame([("hot", 1.0, 2)], "source string, weight double, max_repeat int")
    df = docs(spark).where("source = 'hot'")
    twice = df.union(df).union(spark.createDataFrame([(0, "hot", 1)], df.schema))
    rows = M.mix_sources(twice, w)[0].collect()
    assert len(rows) == len({r["doc_id"] for r in rows}) == 1500 and {r["copies"] for r in rows} == {2}


def test_total_beyond_the_caps(spark):
    w = spark.createDataFrame([("hot", 1.0, 2), ("small", 1.0, 2)], "source string, weight double, max_repeat int")
    mix, report = M.mix_sources(docs(spark), w, total_tokens=1e6)
    by = {r["source"]: r for r in report.collect()}
    assert by["small"]["short"] and by["small"]["taken_tokens"] == 2 * by["small"]["tokens"]


def test_mix_of_nothing(spark):
    w = spark.createDataFrame([("hot", None, None), (None, 1.0, 1)], "source string, weight double, max_repeat int")
    mix, report = M.mix_sources(docs(spark).limit(0), w)
    assert mix.count() == 0 and report.count() == 1
    mix, report = M.mix_sources(docs(spark), w.limit(0))
    assert mix.count() == 0 and report.count() == 0


def test_plan_of_sources():
    s = pd.DataFrame({"source": ["a", "b"], "weight": [1.0, 1.0], "max_repeat": [1, 3], "tokens": [1000, 100], "docs": [10, 1]})
    assert M.plan_sources(s, None)["copies"].tolist() == [0.3, 3.0]
