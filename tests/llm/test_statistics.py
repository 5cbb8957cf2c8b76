import math
from collections import Counter, defaultdict
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from compare import connect, differences
from zipfloom.llm import percentiles as P
from zipfloom.llm import queries
from zipfloom.llm import terms as T

ROWS = [["a", "b", "a"], None, [], ["b", None, "c"], ["x" * 5000], ["a"], ["é", ""]]


@pytest.mark.parametrize("heavy", [None, [], ["a", "zzz"], ["a", "b", "c", "é", ""]])
def test_terms_are_exact_whatever_is_heavy(spark, heavy):
    df = spark.createDataFrame([(r, 1) for r in ROWS * 7], "terms array<string>, n int").repartition(3)
    got = {r["term"]: (r["n_occurrences"], r["n_records"]) for r in T.term_frequencies(df, "terms", heavy).collect()}
    n, d = Counter(), Counter()
    for r in ROWS * 7:
        words = [w for w in r or [] if w is not None]
        n.update(words)
        d.update(set(words))
    assert got == {w: (n[w], d[w]) for w in n}


def test_terms_of_nothing(spark):
    assert T.term_frequencies(spark.createDataFrame([], "terms array<string>"), "terms").count() == 0


def test_marks(spark):
    df = spark.createDataFrame([(2,), (3,), (20,), (21,)], "n bigint")
    from pyspark.sql import functions as F

    got = [r[0] for r in df.select(T.mark("n", F.lit(1000))).collect()]
    assert got == ["rare", None, None, "common"]


@given(st.lists(st.floats(allow_nan=False), min_size=2, max_size=20))
def test_bits_keep_the_order(xs):
    x = np.array(xs)
    k = P.ordered_bits(x)
    assert (np.argsort(k, kind="stable") == np.argsort(x, kind="stable")).all()
    assert (P.from_bits(k) == x).all()


def brute(rows, q):
    by = defaultdict(list)
    for g, x in rows:
        if x is not None and math.isfinite(x):
            by[g].append(x)
    return {(g, p): (len(v), sorted(v)[max(math.ceil(round(p * len(v), 6)), 1) - 1]) for g, v in by.items() for p in q}


def test_percentiles_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [("hot", float(x)) for x in rng.lognormal(3, 2, 4000)]
    rows += [("ties", 1.5)] * 50 + [("ties", -1.5)] * 49 + [(None, -0.0), (None, 0.0), (None, float("inf")), ("one", 5e-324)]
    rows += [("gone", None), ("gone", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    keys = P.radix_keys(df, ["g"], ["x"]).withColumnRenamed("_v0", "k").where("k is not null")
    q = [0.0, 0.5, 0.9, 0.99, 1.0]
    want = brute(rows, q)
    got = {(r["g"], r["q"]): (r["n_values"], r["value"]) for r in P.radix_percentiles(keys, ["g"], q).collect()}
    assert got == want
    near = P.histogram_percentiles(P.radix_histogram(keys, ["g"]), ["g"], q).collect()
    for r in near:
        n, v = want[r["g"], r["q"]]
        assert r["n_values"] == n and abs(r["value"] - v) <= P.SKETCH_ERROR * abs(v) + 1e-300
    assert P.radix_percentiles(keys.limit(0), ["g"], q).count() == 0


def test_days_add_up(spark, sf):
    from zipfloom.llm.queries import p6_merged, p6_percentiles

    exact = {(r["phenomenon"], r["metric"], r["q"]): (r["n_values"], r["value"]) for r in p6_percentiles(spark, sf).collect()}
    merged = p6_merged(spark, sf).collect()
    assert len(merged) == len(exact)
    for r in merged:
        n, v = exact[r["phenomenon"], r["metric"], r["q"]]
        assert r["n_values"] == n and abs(r["value"] - v) <= r["max_relative_error"] * abs(v)


@pytest.mark.parametrize("name", ["p6_percentiles", "p6_kept"])
def test_scores_without_an_arrival(spark, tmp_path, name):
    """A row without a time is passed over beside one that has it, and alone."""
    at = [None, datetime(2026, 1, 2, tzinfo=UTC), datetime(2026, 1, 1, tzinfo=UTC), None]
    cols = {"score_id": [1, 1, 2, 3], "ingested_at": pa.array(at, pa.timestamp("us", "UTC")), "phenomenon": ["a", "a", "a", "only"]}
    pq.write_table(pa.table(cols | {m: [9.0, 1.0, 3.0, 7.0] for m in queries.METRICS}), tmp_path / "pair_score.parquet")
    got = differences(queries.QUERIES[name], queries.ORACLES[name], spark, str(tmp_path), connect(tmp_path))
    assert got == ([], [])
