import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from zipfloom.operators import references as R

T0 = datetime(2024, 1, 1)
REFS = "id bigint, k string, n int, at timestamp, start string"
PARENTS = "k string, n int, start timestamp, end timestamp, id string"


def brute(refs, parents):
    out = []
    for i, k, n, at, _ in refs:
        own = [p for p in parents if k is not None and n is not None and p[0] == k and p[1] == n and p[2] is not None]
        begun = [p for p in own if at is not None and p[2] <= at]
        if any(p[3] is None or p[3] > at for p in begun):
            continue
        out.append((i, at, "absent" if not own else "gone" if begun else "not_yet"))
    return sorted(out, key=str)


def run(spark, refs, parents, **kw):
    r, p = spark.createDataFrame(refs, REFS).repartition(3), spark.createDataFrame(parents, PARENTS).repartition(3)
    got = R.orphan_references(r, p, ["k", "n"], ref_id="id", ref_time="at", start="start", end="end", **kw)
    return sorted(map(tuple, got.collect()), key=str)


def random_tables(seed, n=400):
    rng = random.Random(seed)
    t = lambda: T0 + timedelta(minutes=rng.randint(0, 50))
    key = lambda: (rng.choice(["hot", "hot", "hot", "b", "", None]), rng.choice([1, 2, 3, None]))
    parents = []
    for _ in range(n // 4):
        s = t()
        parents.append((*key(), rng.choice([s, s, s, None]), rng.choice([None, s + timedelta(minutes=rng.randint(0, 20))]), "x"))
    refs = [(i % 350, *key(), rng.choice([t(), t(), None]), "y") for i in range(n)]
    return refs, parents + parents[:5]


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    refs, parents = random_tables(seed)
    assert run(spark, refs, parents) == brute(refs, parents)


def test_hot_ranges_are_split(spark):
    refs, parents = random_tables(9, 600)
    assert run(spark, refs, parents, parents_per_range=10, refs_per_chunk=20) == brute(refs, parents)


def test_empty_sides(spark):
    refs, parents = random_tables(1, 40)
    assert run(spark, [], parents) == []
    assert run(spark, refs, []) == brute(refs, [])


def test_boundaries(spark):
    p = [("a", 1, T0, T0 + timedelta(1), "x")]
    at = [T0 - timedelta(1), T0, T0 + timedelta(hours=23), T0 + timedelta(1)]
    got = run(spark, [(i, "a", 1, t, "") for i, t in enumerate(at)], p)
    assert [(i, why) for i, _, why in got] == [(0, "not_yet"), (3, "gone")]


def test_keys_that_share_the_first_hash():
    h1, h2 = np.array([5, 5, 5, 9]), np.array([1, 2, 3, 1])
    index = R.ParentIndex(h1, h2, np.zeros(4, np.int64), np.full(4, 10))
    why = index.reasons(np.array([5, 5, 5, 5, 9]), np.array([1, 2, 3, 4, 1]), np.array([5, 5, 10, 5, -1]), np.ones(5, bool))
    assert why.tolist() == [0, 0, 2, 1, 3]


def test_queries_agree(spark, sf):
    from zipfloom.plans.problems import p1_found, p1_report

    found = p1_found(spark, sf)
    assert found.count() == found.distinct().count() > 0
    assert {r["reason"] for r in p1_report(spark, sf).collect()} <= {"absent", "gone", "not_yet"}
