"""A sample that matches target proportions, by the cube method.

Inclusion probabilities sum to each category's target.  The flight phase moves
probabilities along the kernel of the balancing matrix, whose rows are the
indicators of categories and of further balancing columns, until they are 0 or
1.  Records with equal indicators (a cell) differ by kernel vectors of two
entries, so a chunk's flight resolves all but one record per cell; unresolved
records merge upward, chunk by chunk; at the root the flight goes on with the
whole matrix, and landing drops constraints, the balancing columns first, then
the categories, and keeps the total.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, materialise

EPS = 1e-9
#: Records of a chunk, on average; chunks whose unresolved records merge at a time.
CHUNK_RECORDS, FAN_IN = 250_000, 64


class Drawn(NamedTuple):
    """A sample, the report of its targets and that of its balancing columns."""

    sample: DataFrame
    report: DataFrame
    balance: DataFrame


def allocate(share: np.ndarray, least: np.ndarray, available: np.ndarray, size: int) -> np.ndarray:
    """Expected rows per category.

    Proportional to ``share``, at least ``least`` and at most ``available``,
    summing to ``size`` where the bounds allow it: the scale is found by
    bisection, so what a short category lacks goes to the others in proportion.
    A category that can't reach its share gives all it has.  Where these least
    rows exceed ``size``, they are kept and the sum is larger.
    """
    low, high = np.minimum(least, available).astype(float), available.astype(float)
    low = np.where(share * size > high, high, low)
    want = min(float(size), high.sum())
    if low.sum() >= want or not (share > 0).any():
        return low
    at = lambda s: np.clip(s * share * size, low, high)
    lo, hi = 0.0, 1.0
    while at(hi).sum() < want and hi < 1e12:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if at(mid).sum() < want else (lo, mid)
    out = at(hi)
    free = (out > low + EPS) & (out < high - EPS)
    if free.any():  # close the last rounding
        out[free] += (want - out.sum()) / free.sum()
    near = np.round(out)
    return np.where(np.abs(out - near) < 1e-6, near, out)


def _pivot(a: float, b: float, u: float) -> tuple[float, float]:
    """Move mass between two probabilities until one is 0 or 1; means are kept."""
    s = a + b
    if s < 1 + EPS:
        s = min(s, 1.0)
        return (0.0, s) if u * s < b else (s, 0.0)
    return (1.0, s - 1) if u * (2 - s) < 1 - b else (s - 1, 1.0)


def _open(p: np.ndarray) -> np.ndarray:
    return np.flatnonzero((p > EPS) & (p < 1 - EPS))


def cell_flight(cells: list, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight along kernel vectors of two records of one cell: one stays open per cell."""
    p, u = p.copy(), rng.random(len(p))
    held: dict = {}
    for i in _open(p):
        j = held.pop(cells[i], None)
        if j is not None:
            p[j], p[i] = _pivot(p[j], p[i], u[i])
            if EPS < p[j] < 1 - EPS:
                held[cells[i]] = j
                continue
        if EPS < p[i] < 1 - EPS:
            held[cells[i]] = i
    return p


def cube_flight(p: np.ndarray, matrix: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight over any balancing matrix (constraints x records).

    Steps along a kernel vector of as many open records as the kernel needs, in
    one of two directions drawn so that each probability's mean stays, until one
    of them is 0 or 1.  Ends when the open records' kernel is empty.
    """
    p = np.clip(p.astype(float), 0.0, 1.0)
    rank = np.linalg.matrix_rank(matrix) if matrix.size else 0
    while len(at := _open(p)):
        at = at[: rank + 1]
        _, s, v = np.linalg.svd(matrix[:, at], full_matrices=True)
        if len(s) == len(at) and s[-1] > 1e-9:
            return p
        move = np.where(np.abs(v[-1]) < 1e-12, 0.0, v[-1])
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(move > 0, (1 - p[at]) / move, np.where(move < 0, -p[at] / move, np.inf)).min()
            down = np.where(move > 0, p[at] / move, np.where(move < 0, (p[at] - 1) / move, np.inf)).min()
        p[at] += (up if rng.random() * (up + down) < down else -down) * move
        p = np.where(p < EPS, 0.0, np.where(p > 1 - EPS, 1.0, p))
    return p


def _cells(pdf: pd.DataFrame, cols: list[str]) -> list[tuple]:
    return list(pdf[cols].astype(object).where(pdf[cols].notna(), None).itertuples(index=False, name=None))


def _indicators(pdf: pd.DataFrame, cols: list[str]) -> np.ndarray:
    """One row for the total and one per value of each column."""
    rows = [np.ones(len(pdf))]
    for c in cols:
        codes, values = pd.factorize(pdf[c], use_na_sentinel=False)
        rows += [(codes == k).astype(float) for k in range(len(values))]
    return np.array(rows)


def _draws(seed: int, plan: str, *where: int) -> np.random.Generator:
    """Draws that depend on the seed and the place in the tree alone, so a task can be repeated."""
    return np.random.default_rng([seed & 0xFFFFFFFF, zlib.crc32(plan.encode("utf-8", "surrogatepass")), *where])


def _merge(seed: int, level: int, cols: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Flight over the unresolved records of neighbouring chunks."""
        pdf = pdf.sort_values([*cols, "u", "unit"])
        rng = _draws(seed, pdf["plan_name"].iloc[0], level, int(pdf["chunk"].iloc[0]))
        p = cell_flight(_cells(pdf, cols), pdf["p"].to_numpy(float), rng)
        return pdf.assign(p=p)[p > EPS]

    return run


def _land(seed: int, balance: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """The last flights and the landing of a plan."""
        cols = ["category", *balance]
        pdf = pdf.sort_values([*cols, "u", "unit"])
        rng = _draws(seed, pdf["plan_name"].iloc[0])
        p = cell_flight(_cells(pdf, cols), pdf["p"].to_numpy(float), rng)
        if balance and len(at := _open(p)) > 1:
            p[at] = cube_flight(p[at], _indicators(pdf.iloc[at], cols), rng)
        # landing: without the balancing columns, then without the categories
        p = cell_flight(pdf["category"].tolist(), p, rng)
        p = cell_flight([""] * len(p), p, rng)
        last = _open(p)  # at most one: its fraction decides
        p[last] = (rng.random(len(last)) < p[last]).astype(float)
        return pdf.assign(p=p)[p > 0.5]

    return run


def _goals(records: DataFrame, targets: DataFrame) -> DataFrame:
    """Available and expected rows of every target."""
    number = lambda c: F.greatest(F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    t = (
        targets.where("plan_name is not null and category is not null")
        .groupBy("plan_name", "category")
        .agg(*[F.max(number(c)).alias(c) for c in ("target_share", "min_rows", "sample_size")])
    )
    counts = records.groupBy("plan_name", "category").agg(F.count("*").alias("available"))

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf["sample_size"] = pdf["sample_size"].max()
        pdf["expected"] = allocate(
            pdf["target_share"].to_numpy(float), pdf["min_rows"].to_numpy(float),
            pdf["available"].to_numpy(float), int(pdf["sample_size"].iloc[0]),
        )
        pdf["planned"] = pdf["expected"].sum()
        return pdf

    # grouped by plan, a group being the plan's targets, not its records
    joined = t.join(counts, ["plan_name", "category"], "left").fillna(0, ["available"])
    cols = "plan_name string, category string, target_share double, min_rows bigint, sample_size bigint, available bigint"
    return joined.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in cols.split(", ")]).groupBy("plan_name").applyInPandas(
        plan, f"{cols}, expected double, planned double"
    )


def judged(report: DataFrame) -> DataFrame:
    """Adds ``wanted``, ``imbalance``, ``met`` and ``reason`` to expected and drawn rows.

    A target is met if the drawn rows reach it, or miss it by the fraction of a
    row while records are left.  reason is ``short`` if every record was drawn
    and they aren't enough, ``minima exceed size`` if the plan's least rows are
    more than its size, else ``displaced``: the others' minima took the rows.
    """
    wanted, drawn = F.col("wanted"), F.col("drawn")
    met = (drawn >= wanted) | ((wanted - drawn < 1) & (drawn < F.col("available")))
    reason = F.when(drawn >= F.col("available"), "short").when(F.col("planned") > F.col("sample_size") + 1e-6, "minima exceed size")
    size = F.col("target_share") * F.col("sample_size")
    return (
        report.withColumn("wanted", F.greatest(size, F.col("min_rows").cast("double")))
        .withColumn("imbalance", drawn - F.col("expected"))
        .withColumn("met", met)
        .withColumn("reason", F.when(~met, reason.otherwise("displaced")))
    )


def cube_sample(records: DataFrame, targets: DataFrame, seed: int = 0, balance: tuple[str, ...] = ()) -> Drawn:
    """Draw a sample per plan and report how far it meets its targets.

    ``records``: ``plan_name, category, unit`` (unit a bigint, one row per unit
    and plan) and the columns named in ``balance``, whose values keep their
    expected share of the sample too, as far as the categories allow; they
    should have few values, as the root's matrix has a row for each.
    ``targets``: ``plan_name, category, target_share, min_rows, sample_size``;
    repeated targets count once, of differing ones of a category the greatest,
    and of a plan's sizes the greatest.

    Result: ``sample`` (plan_name, category, unit), ``report`` of every target
    (see :func:`judged`; ``planned`` is the plan's sum of expected rows) and
    ``balance``: expected and drawn rows of every plan, column and value.

    Defined cases: a null, NaN or negative share or minimum is 0, a null
    sample_size means nothing to draw but minima; records with a null plan,
    category or unit and records of categories without a target aren't drawn;
    null balancing values are a value; an empty side gives no sample and a
    report of zeros.  Equal records and seed give an equal sample, whatever
    their partitions, batches or order.

    Scale: a chunk is named by its units' hashes, so a category that holds a
    third of all rows spreads over chunks; one shuffle of units by chunk and
    cell; at most one record per cell and chunk merges upward.
    """
    extra = list(balance)
    cols = ["category", *extra]
    base = records.select("plan_name", *cols, F.col("unit").cast("bigint").alias("unit")).where(
        "plan_name is not null and category is not null and unit is not null"
    )
    goals = materialise(_goals(base, targets), "goals")
    total = goals.agg(F.sum("available")).first()[0] or 0
    chunks = max(1, -(-total // CHUNK_RECORDS))
    prob = goals.where("expected > 0").select("plan_name", "category", (F.col("expected") / F.col("available")).alias("p"))
    entered = base.join(broadcast_if_small(prob), ["plan_name", "category"]).select(
        "plan_name", *cols, "unit", "p",
        F.xxhash64(F.lit(seed), F.lit("draw"), "plan_name", "unit").alias("u"),
        F.pmod(F.xxhash64(F.lit(seed), F.lit("chunk"), "unit"), F.lit(chunks)).alias("chunk"),
    )
    # a cell's records have one probability: in the order of their draws the first floor(m * p) fly to 1,
    # the next keeps the fraction, the rest fly to 0
    cell = Window.partitionBy("plan_name", *cols, "chunk")
    mass = F.col("_m") * F.col("p")
    whole = F.floor(mass + EPS)
    flown = (
        entered.withColumn("_r", F.row_number().over(cell.orderBy("u", "unit")))
        .withColumn("_m", F.count("*").over(cell))
        .withColumn("p", F.when(F.col("_r") <= whole, 1.0).when(F.col("_r") == whole + 1, mass - whole).otherwise(0.0))
        .where(F.col("p") > EPS)
        .select("plan_name", *cols, "unit", "p", "u", "chunk")
    )
    done = []
    level = materialise(flown, "flight")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in level.schema)
    height = 0
    while True:
        done.append(level.where("p = 1"))
        rest = level.where("p < 1")
        if chunks == 1:
            break
        height += 1
        chunks = -(-chunks // FAN_IN)
        up = rest.withColumn("chunk", F.floor(F.col("chunk") / FAN_IN))
        level = materialise(up.groupBy("plan_name", "chunk").applyInPandas(_merge(seed, height, cols), kind), "merge")
    done.append(rest.groupBy("plan_name").applyInPandas(_land(seed, extra), kind))
    sample = done[0]
    for d in done[1:]:
        sample = sample.unionByName(d)
    drawn = sample.groupBy("plan_name", "category").agg(F.count("*").alias("drawn"))
    report = judged(goals.join(drawn, ["plan_name", "category"], "left").fillna(0, ["drawn"])).select(
        "plan_name", "category", "target_share", "min_rows", "sample_size", "planned", "available", "wanted", "expected", "drawn",
        "imbalance", "met", "reason",
    )
    by = ["plan_name", "indicator", "value"]

    def held(df: DataFrame, n: F.Column) -> DataFrame:
        values = F.array(*[F.struct(F.lit(c).alias("indicator"), F.col(c).cast("string").alias("value")) for c in cols])
        return df.select("plan_name", F.explode(values).alias("x"), n.alias("n")).select("plan_name", "x.*", "n")

    want = held(entered.groupBy("plan_name", *cols).agg(F.sum("p").alias("p")), F.col("p"))
    got = held(sample.groupBy("plan_name", *cols).agg(F.count("*").alias("c")), F.col("c").cast("double"))
    both = want.withColumn("d", F.lit(0.0)).unionByName(got.withColumnRenamed("n", "d").withColumn("n", F.lit(0.0)))
    residual = both.groupBy(*by).agg(F.sum("n").alias("expected"), F.sum("d").cast("bigint").alias("drawn"))
    return Drawn(
        sample.select("plan_name", "category", "unit"), report, residual.withColumn("imbalance", F.col("drawn") - F.col("expected"))
    )
