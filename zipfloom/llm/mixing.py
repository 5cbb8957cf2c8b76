"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source has the same expected number of copies.  Its whole
part is given; the fractions are rounded by pairing documents and moving token
mass between them at random until one fraction is 0 or 1.  What is left of a
partition goes up a reduction tree, so a source misses its share by less than
one document.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, materialise

EPS = 1e-9
#: Documents of a chunk, on average; chunks that merge at a time.
CHUNK_DOCS, FAN_IN = 100_000, 64


def pivotal_rounds(p: np.ndarray, size: np.ndarray, group: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Round fractions in a tournament: pair neighbours of a group, keep the loser.

    A move shifts ``size``-weighted mass, so each group's expected size stays
    exactly; directions are drawn so that every fraction's mean stays.  One
    fraction per group is left at most.  All pairs of a round move at once.
    """
    p = p.astype(float).copy()
    active = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    active = active[np.argsort(group[active], kind="stable")]
    while True:
        g = group[active]
        head = np.r_[True, g[1:] != g[:-1]] if len(g) else np.empty(0, bool)
        starts = np.flatnonzero(head)
        place = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
        first = np.flatnonzero((place % 2 == 0) & np.r_[~head[1:], False]) if len(g) else np.empty(0, int)
        if not len(first):
            return p
        i, j = active[first], active[first + 1]
        # mass m up on i and down on j, or the other way; up and down are the most that fit
        up = np.minimum((1 - p[i]) * size[i], p[j] * size[j])
        down = np.minimum(p[i] * size[i], (1 - p[j]) * size[j])
        move = np.where(rng.random(len(i)) * (up + down) < down, up, -down)
        p[i] += move / size[i]
        p[j] -= move / size[j]
        for k in (i, j):
            p[k] = np.where(p[k] < EPS, 0.0, np.where(p[k] > 1 - EPS, 1.0, p[k]))
        active = active[(p[active] > EPS) & (p[active] < 1 - EPS)]


_SCHEMA = "doc_id bigint, source string, n_tokens bigint, base bigint, frac double, u bigint, chunk bigint"
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]


def _rounds(seed: int, level: int, last: bool = False):
    """Rounds a group's fractions; ``last``: at the root a source's one open fraction decides itself.

    The draws depend on the seed, the level and the group's chunk alone.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["source", "u", "doc_id"], kind="stable")
        names, chunk = pdf["source"].to_numpy(), int(pdf["chunk"].iloc[0])
        where = [chunk] if not last else [zlib.crc32(names[0].encode("utf-8", "surrogatepass"))]
        rng = np.random.default_rng([seed & 0xFFFFFFFF, level, *where])
        codes = pd.factorize(pdf["source"])[0]
        p = pivotal_rounds(pdf["frac"].to_numpy(float), pdf["n_tokens"].to_numpy(float), codes, rng)
        if last:
            p = np.where((p > EPS) & (p < 1 - EPS), rng.random(len(p)) < p, p)
        got = pdf.assign(base=pdf["base"] + (p >= 1 - EPS), frac=np.where((p <= EPS) | (p >= 1 - EPS), 0.0, p))
        return got[(got["base"] > 0) | (got["frac"] > 0)][_NAMES]

    return run


def plan_sources(sizes: pd.DataFrame, total: float | None) -> pd.DataFrame:
    """Expected tokens and copies per document of each source.

    ``sizes``: ``source, weight, max_repeat, tokens, docs``.  Without a total the
    largest is taken at which every source that has tokens can give its share.
    """
    w = sizes["weight"].fillna(0).clip(lower=0).to_numpy(float)
    cap = sizes["max_repeat"].fillna(0).clip(lower=0).to_numpy(float) * sizes["tokens"].to_numpy(float)
    share = w / w.sum() if w.sum() > 0 else w
    usable = (share > 0) & (cap > 0)
    within = np.where(usable, share, 0)
    within = within / within.sum() if usable.any() else within
    if total is None:
        total = float((cap[usable] / within[usable]).min()) if usable.any() else 0.0
    goal = np.minimum(within * total, cap)
    tokens = sizes["tokens"].to_numpy(float)
    copies = np.divide(goal, tokens, out=np.zeros_like(goal), where=tokens > 0)
    near = np.round(copies)
    copies = np.where(np.abs(copies - near) < EPS, near, copies)
    return sizes.assign(target_share=share, goal_tokens=goal, copies=copies, short=(within * total > cap + 1e-6) | ((share > 0) & (cap <= 0)))


def mix_sources(
    docs: DataFrame, weights: DataFrame, total_tokens: float | None = None, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Copies per document, and the shares that the sources reach.

    ``docs``: ``doc_id, source, n_tokens``.  ``weights``: ``source, weight,
    max_repeat``, relative to the weights' sum; repeated rows count once, of
    differing rows of a source the greatest.  Returns ``doc_id, source, n_tokens,
    copies`` (copies >= 1) and a report per weighted source.

    Defined cases: documents with a null id, a null source or a source without
    a weight, or without tokens (null and empty texts) get no copy; a source
    without tokens can't give its share, is reported ``short`` and the others'
    shares are taken relative to theirs; rows that repeat a doc_id count once,
    of differing ones the one with the most tokens, then the greatest source.
    Equal documents and seed give an equal mix, whatever their partitions,
    batches or order.

    Scale: documents go to chunks by their id's hash, so a source that holds a
    third of all rows spreads over chunks; one open document per source and
    chunk goes up the tree.
    """
    w = (
        weights.where("source is not null")
        .groupBy("source")
        .agg(F.max(F.coalesce("weight", F.lit(0.0))).alias("weight"), F.max(F.coalesce("max_repeat", F.lit(0))).alias("max_repeat"))
    )
    base = docs.where("doc_id is not null and source is not null and n_tokens > 0").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "source", F.col("n_tokens").cast("bigint").alias("n_tokens")
    )
    once = base.groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source")).alias("x"))
    base = materialise(once.select("doc_id", "x.source", "x.n_tokens"), "mix")
    sizes = base.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    # one row per weighted source: as small as the table of weights
    known = w.join(sizes, "source", "left").fillna(0, ["tokens", "docs"]).orderBy("source").toPandas()
    plan = plan_sources(known, total_tokens)
    spark = docs.sparkSession
    cols = ["source", "weight", "max_repeat", "tokens", "docs", "target_share", "goal_tokens", "copies", "short"]
    kinds = ["string", "double", "bigint", "bigint", "bigint", "double", "double", "double", "boolean"]
    rows = [tuple(x.item() if hasattr(x, "item") else x for x in r) for r in plan[cols].itertuples(index=False, name=None)]
    rows = [(r[0], float(r[1]), int(r[2]), int(r[3]), int(r[4]), float(r[5]), float(r[6]), float(r[7]), bool(r[8])) for r in rows]
    goals = spark.createDataFrame(rows, ", ".join(f"{c} {k}" for c, k in zip(cols, kinds)))
    chunks = max(1, -(-int(known["docs"].sum() if len(known) else 0) // CHUNK_DOCS))
    entered = base.join(broadcast_if_small(goals.where("copies > 0").select("source", "copies")), "source").select(
        "doc_id", "source", "n_tokens",
        F.floor("copies").cast("bigint").alias("base"),
        (F.col("copies") - F.floor("copies")).alias("frac"),
        F.xxhash64(F.lit(seed), F.lit("draw"), "doc_id").alias("u"),
        F.pmod(F.xxhash64(F.lit(seed), F.lit("chunk"), "doc_id"), F.lit(chunks)).alias("chunk"),
    )
    level, height, done = entered, 0, []
    while True:
        level = materialise(level.groupBy("chunk").applyInPandas(_rounds(seed, height), _SCHEMA), "mix")
        done.append(level.where(F.col("frac") == 0))
        rest = level.where(F.col("frac") > 0)
        if chunks == 1:
            break
        height += 1
        chunks = -(-chunks // FAN_IN)
        level = rest.withColumn("chunk", F.floor(F.col("chunk") / FAN_IN))
    done.append(rest.groupBy("source").applyInPandas(_rounds(seed, height + 1, last=True), _SCHEMA))
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    mix = whole.where("base > 0").select("doc_id", "source", "n_tokens", F.col("base").alias("copies"))
    got = mix.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("taken_tokens"), F.max("copies").alias("most_copies"), F.count("*").alias("docs_used")
    )
    report = goals.join(got, "source", "left").fillna(0, ["taken_tokens", "most_copies", "docs_used"])
    # a window over the weighted sources, which are as few as the weights' rows
    report = report.withColumn("_all", F.sum("taken_tokens").over(Window.partitionBy(F.lit(0)))).select(
        "source", "weight", "max_repeat", "docs", "tokens", "target_share", "goal_tokens", "taken_tokens",
        F.coalesce(F.try_divide("taken_tokens", "_all"), F.lit(0.0)).alias("actual_share"), "docs_used", "most_copies", "short",
    )
    return mix, report
