"""Percentiles per group by radix selection.

Doubles become integers of the same order.  A round histograms one digit of the
integers that share the prefix found so far, and keeps the digit that holds
each target rank; after all rounds the prefix is the value itself.  Histograms
of the leading digits can be stored per day and added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, materialise

#: Bits of a digit; four rounds cover 64 bits.
DIGIT = 16
#: Bits kept by a mergeable histogram: sign, 11 of exponent, the rest of mantissa.  A group has at most
#: 256 bins for each power of two that its values span, however many values there are.
SKETCH_BITS = 20
#: Largest relative error of a percentile that comes from such histograms.
SKETCH_ERROR = 2.0 ** -(SKETCH_BITS - 12)


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Signed integers in the order of the doubles; -0.0 equals 0.0."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, np.int64(-(2**63)) - bits - 1, bits)


def from_bits(k: np.ndarray) -> np.ndarray:
    k = np.asarray(k, np.int64)
    return np.where(k < 0, np.int64(-(2**63)) - k - 1, k).view(np.float64)


def _to_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = list(batch.columns)
        for i, name in enumerate(batch.schema.names):
            if name.startswith("_v"):
                x = out[i].to_numpy(zero_copy_only=False).astype(np.float64)
                ok = np.isfinite(x)
                out[i] = pa.array(ordered_bits(np.where(ok, x, 0.0)), pa.int64(), mask=~ok)
        yield pa.RecordBatch.from_arrays(out, names=batch.schema.names)


def _to_doubles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        last = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(from_bits(last))], names=batch.schema.names)


def _kinds(df: DataFrame, cols: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)


def radix_keys(df: DataFrame, keep: list[str], values: list[str]) -> DataFrame:
    """The columns ``keep`` and, as ``_v0, _v1 ..``, each value's ordered integer.

    Nulls, NaN and infinities become null.
    """
    src = df.select(*keep, *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)])
    ints = ", ".join(f"_v{i} bigint" for i in range(len(values)))
    return src.mapInArrow(_to_keys, f"{_kinds(src, keep)}, {ints}" if keep else ints)


def long_form(keys: DataFrame, groups: list[str], values: list[str]) -> DataFrame:
    """One row per group columns, ``metric`` and integer ``k``; nulls left out."""
    pairs = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(f"_v{i}").alias("k")) for i, v in enumerate(values)])
    return keys.select(*groups, F.explode(pairs).alias("x")).select(*groups, "x.metric", "x.k").where("k is not null")


def _rank(q: float, n: Column) -> Column:
    """The nearest rank: the least r with r >= q * n, from 1."""
    return F.greatest(F.ceil(F.round(F.lit(q) * n, 6)), F.lit(1)).cast("bigint")


def _walk(hist: DataFrame, by: list[str], digit: str) -> DataFrame:
    """Each digit with the number of values below it, within ``by``.

    A window holds the digits of one prefix, of which there are 2^DIGIT at
    most, however many values they stand for.
    """
    w = Window.partitionBy(*by).orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)
    return hist.withColumn("_below", F.coalesce(F.sum("n").over(w), F.lit(0)))


def radix_percentiles(keys: DataFrame, by: list[str], quantiles: list[float]) -> DataFrame:
    """Exact nearest-rank percentiles: ``by, q, n_values, value``.

    ``keys`` has the columns ``by`` and the integer ``k``.  Null groups are
    groups.  Each round shuffles digit counts, at most 2^16 a group and prefix,
    which tasks add up first; a group that holds most values is no larger.
    ``keys`` is read once a round, so callers materialise what is costly.
    Empty input gives no rows; repeated values and ties have a rank each.
    """
    digit = lambda r: F.shiftright("k", 64 - DIGIT * (r + 1))
    found = None
    for r in range(64 // DIGIT):
        if r == 0:
            hist = keys.groupBy(*by, digit(0).alias("_d")).agg(F.count("*").alias("n"))
            walked = _walk(hist, by, "_d")
            total = F.sum("n").over(Window.partitionBy(*by))
            ranks = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), _rank(q, F.col("n_values")).alias("_r")) for q in quantiles]))
            target = walked.withColumn("n_values", total).select("*", ranks.alias("x")).select("*", "x.q", "x._r").drop("x")
        else:
            cond = F.col("a._p") == F.col("b._p")
            for c in by:
                cond = cond & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
            # the digits found so far are few (groups x quantiles): a counted broadcast
            prefix = broadcast_if_small(found.select(*by, F.col("_d").alias("_p")).distinct())
            part = keys.withColumn("_p", digit(r - 1)).withColumn("_d", digit(r))
            within = part.alias("a").join(prefix.alias("b"), cond, "left_semi")
            walked = _walk(within.groupBy(*by, "_p", "_d").agg(F.count("*").alias("n")), [*by, "_p"], "_d")
            f = found.select(*by, F.col("_d").alias("_p"), "q", "_r", "n_values")
            target = walked.alias("a").join(f.alias("b"), cond).select("a.*", "b.q", "b._r", "b.n_values")
        hit = target.where((F.col("_below") < F.col("_r")) & (F.col("_r") <= F.col("_below") + F.col("n")))
        found = materialise(hit.select(*by, "_d", "q", (F.col("_r") - F.col("_below")).alias("_r"), "n_values"), "radix")
    out = found.select(*by, "q", "n_values", F.col("_d").alias("value"))
    return out.mapInArrow(_to_doubles, f"{_kinds(out, [*by, 'q', 'n_values'])}, value double")


def radix_histogram(keys: DataFrame, by: list[str], bits: int = SKETCH_BITS) -> DataFrame:
    """A mergeable summary: ``by, bin, n``; sums of such tables summarise their union."""
    return keys.groupBy(*by, F.shiftright("k", 64 - bits).alias("bin")).agg(F.count("*").alias("n"))


def histogram_percentiles(hist: DataFrame, by: list[str], quantiles: list[float], bits: int = SKETCH_BITS) -> DataFrame:
    """``by, q, n_values, value`` from added histograms.

    The value is the middle of the bin that holds the nearest rank; its
    relative error is at most ``2 ** -(bits - 12)``.
    """
    merged = hist.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    walked = _walk(merged, by, "bin").withColumn("n_values", F.sum("n").over(Window.partitionBy(*by)))
    ranks = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), _rank(q, F.col("n_values")).alias("_r")) for q in quantiles]))
    hit = walked.select("*", ranks.alias("x")).where("_below < x._r and x._r <= _below + n")
    middle = F.shiftleft(F.col("bin"), 64 - bits) + F.lit(1 << (63 - bits))
    out = hit.select(*by, "x.q", "n_values", middle.alias("value"))
    return out.mapInArrow(_to_doubles, f"{_kinds(out, [*by, 'q', 'n_values'])}, value double")
