"""References to records that do not exist at the time of the reference.

Keys are hashed to 128 bits and range-partitioned on the first 64; each range
keeps its parents as sorted arrays, batches of references are probed by binary
search, and only the misses leave the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parents that one range holds on average, at most.
PARENTS_PER_RANGE = 250_000
#: References of one range beyond which they are split into chunks.
REFS_PER_CHUNK = 500_000

ABSENT, GONE, NOT_YET = "absent", "gone", "not_yet"
_FOREVER = np.iinfo(np.int64).max


class ParentIndex:
    """Sorted arrays of the parents of one range.

    A parent is present from ``start`` until ``end``.  Rows are sorted by key
    and start; ``until`` is the running maximum of ``end`` within a key, so one
    binary search tells whether any interval that began covers a time.
    """

    def __init__(self, h1: np.ndarray, h2: np.ndarray, start: np.ndarray, end: np.ndarray):
        order = np.lexsort((start, h2, h1))
        h1, h2, start, end = h1[order], h2[order], start[order], end[order]
        self.first = np.ones(len(h1), bool)
        self.first[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        self.rank = np.cumsum(self.first) - 1
        self.key1, self.key2 = h1[self.first], h2[self.first]
        self.twins = bool(np.any(self.key1[1:] == self.key1[:-1]))
        self.times = np.unique(start)
        ends, code = np.unique(end, return_inverse=True)
        running = np.maximum.accumulate(self.rank * np.int64(len(ends)) + code)
        self.until = ends[running - self.rank * np.int64(len(ends))] if len(ends) else end
        self.place = self.rank * np.int64(len(self.times) + 1) + np.searchsorted(self.times, start)

    def _ranks(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The rank of each key, -1 where there is none."""
        if not len(self.key1):
            return np.full(len(h1), -1, np.int64)
        at = np.searchsorted(self.key1, h1)
        if self.twins:  # two keys share the first hash: walk on to the second
            last = np.searchsorted(self.key1, h1, side="right")
            for k in np.flatnonzero(last - at > 1):
                hit = np.flatnonzero(self.key2[at[k] : last[k]] == h2[k])
                at[k] += hit[0] if len(hit) else 0
        at = np.minimum(at, len(self.key1) - 1)
        return np.where((self.key1[at] == h1) & (self.key2[at] == h2), at, -1)

    def reasons(self, h1: np.ndarray, h2: np.ndarray, t: np.ndarray, known: np.ndarray) -> np.ndarray:
        """0 present, 1 absent, 2 gone, 3 not yet there. ``known``: t isn't null."""
        rank = self._ranks(h1, h2)
        out = np.where(rank < 0, 1, 3).astype(np.int8)
        if not len(self.key1):
            return out
        when = np.searchsorted(self.times, t, side="right") - 1
        pos = np.searchsorted(self.place, rank * np.int64(len(self.times) + 1) + when, side="right") - 1
        safe = np.maximum(pos, 0)
        begun = (rank >= 0) & (pos >= 0) & (self.rank[safe] == rank) & known
        out[begun] = np.where(self.until[safe][begun] > t[begun], 0, 2)
        return out


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = np.array(["", ABSENT, GONE, NOT_YET], dtype=object)
    here, held, index = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        num = {n: col[n].to_numpy(zero_copy_only=False) for n in ("_range", "_chunk", "_ref", "_h1", "_h2")}
        a_known = col["_a"].is_valid().to_numpy(zero_copy_only=False)
        a = col["_a"].fill_null(0).to_numpy(zero_copy_only=False)
        b = col["_b"].fill_null(_FOREVER).to_numpy(zero_copy_only=False)
        group = np.flatnonzero(
            np.r_[True, (np.diff(num["_range"]) != 0) | (np.diff(num["_chunk"]) != 0) | (np.diff(num["_ref"]) != 0)]
        )
        miss_at, miss_why = [], []
        for lo, hi in zip(group, np.r_[group[1:], batch.num_rows]):
            key = (num["_range"][lo], num["_chunk"][lo])
            if key != here:
                here, held, index = key, [], None
            part = slice(lo, hi)
            if num["_ref"][lo] == 0:
                held.append((num["_h1"][part], num["_h2"][part], a[part], b[part]))
                continue
            if index is None:
                empty = np.empty(0, np.int64)
                index = ParentIndex(*(np.concatenate(x) for x in zip(*held))) if held else ParentIndex(*[empty] * 4)
                held = []
            why = index.reasons(num["_h1"][part], num["_h2"][part], a[part], a_known[part])
            bad = np.flatnonzero(why)
            miss_at.append(bad + lo)
            miss_why.append(why[bad])
        if miss_at and len(at := np.concatenate(miss_at)):
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [col["_id"].take(take), col["_at"].take(take), pa.array(names[np.concatenate(miss_why)], pa.string())],
                names=["rec_id", "at", "reason"],
            )


def orphan_references(
    refs: DataFrame,
    parents: DataFrame,
    key: list[str],
    *,
    ref_id: str,
    ref_time: str,
    start: str,
    end: str,
    parents_per_range: int = PARENTS_PER_RANGE,
    refs_per_chunk: int = REFS_PER_CHUNK,
) -> DataFrame:
    """References whose parent isn't present at the time of the reference.

    ``key`` names columns of both sides.  A parent is present at t if one of its
    rows has ``start`` <= t and an ``end`` that is null or > t.  The result is
    ``(rec_id, at, reason)``, one row per reference row that misses, ``reason``
    being ``absent`` (no parent has the key), ``gone`` (all that began have
    ended) or ``not_yet`` (none has begun).

    Defined cases: a reference with a null in its key names no parent and is
    ``absent``; a parent with a null in its key or start is never present (a
    key with only null starts is ``absent``); a reference without a time is
    ``not_yet`` where the key exists; repeated parents count once; repeated
    references give repeated rows.  Empty tables are allowed on either side.
    Other columns of either side are ignored.

    Scale: the parents' rows with one key and end shrink to the earliest start
    before the shuffle; a range that more than ``refs_per_chunk`` references hit
    is split into chunks, each with a copy of the range's parents; references
    stream through a task, which holds one range's parents only.
    """
    spark = refs.sparkSession
    ks = [F.col(k) for k in key]
    null_key = F.greatest(*[k.isNull() for k in ks], F.lit(False))
    h1, h2 = F.xxhash64(*ks), F.xxhash64(F.lit(0x5EED), *reversed(ks))
    p = (
        parents.where(~null_key & F.col(start).isNotNull())
        .select(h1.alias("_h1"), h2.alias("_h2"), F.unix_micros(start).alias("_a"), F.unix_micros(end).alias("_b"))
        .groupBy("_h1", "_h2", "_b")
        .agg(F.min("_a").alias("_a"))
    )
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(width, -(-parents.count() // parents_per_range))
    bits = max(1, (ranges - 1).bit_length())
    rng = F.shiftrightunsigned(F.col("_h1"), 64 - bits).cast("int")
    r = refs.select(
        F.col(ref_id).alias("_id"), F.col(ref_time).alias("_at"), null_key.alias("_null"), h1.alias("_h1"), h2.alias("_h2")
    )
    probe = r.where(~F.col("_null")).withColumn("_range", rng)
    loads = probe.groupBy("_range").count()
    # at most 2^bits rows; only ranges that need chunks are brought to the driver
    hot = [(x["_range"], -(-x["count"] // refs_per_chunk)) for x in loads.where(F.col("count") > refs_per_chunk).collect()]
    if hot:
        split = F.broadcast(spark.createDataFrame(hot, "_range int, _chunks int"))
        p = p.withColumn("_range", rng).join(split, "_range", "left")
        probe = probe.join(split, "_range", "left")
        chunks = F.coalesce("_chunks", F.lit(1))
    else:
        p, chunks = p.withColumn("_range", rng), F.lit(1)
    id_type, at_type = r.schema["_id"].dataType, r.schema["_at"].dataType
    left = p.select(
        "_range",
        F.explode(F.sequence(F.lit(0), chunks - 1)).alias("_chunk"),
        F.lit(0).cast("byte").alias("_ref"),
        "_h1", "_h2", "_a", "_b",
        F.lit(None).cast(id_type).alias("_id"),
        F.lit(None).cast(at_type).alias("_at"),
    )
    right = probe.select(
        "_range",
        F.pmod(F.monotonically_increasing_id(), chunks.cast("bigint")).cast("int").alias("_chunk"),
        F.lit(1).cast("byte").alias("_ref"),
        "_h1", "_h2", F.unix_micros("_at").alias("_a"), F.lit(None).cast("bigint").alias("_b"), "_id", "_at",
    )
    ordered = left.unionByName(right).repartition("_range", "_chunk").sortWithinPartitions("_range", "_chunk", "_ref")
    schema = f"rec_id {id_type.simpleString()}, at {at_type.simpleString()}, reason string"
    missed = ordered.mapInArrow(_probe, schema)
    unkeyed = r.where("_null").select(F.col("_id").alias("rec_id"), F.col("_at").alias("at"), F.lit(ABSENT).alias("reason"))
    return missed.unionByName(unkeyed)
