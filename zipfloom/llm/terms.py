"""Frequency of every distinct term, heavy ones apart from light ones.

A bounded summary of all rows finds the heavy terms; each task counts those in
local arrays, exactly, and sends one row per heavy term; only the light terms
are shuffled as they occur.  The union of both is exact whatever was found
heavy.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms that are broadcast at most, each of at most so many bytes.
HEAVY_TERMS, HEAVY_BYTES = 1_000, 256
#: Counters of the summary that each task keeps.
COUNTERS = 4_000


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frequent items of Misra and Gries, merged batch by batch."""
    held: Counter = Counter()
    for batch in batches:
        flat = batch.column(0).flatten()
        flat = flat.filter(pc.less_equal(pc.binary_length(flat), HEAVY_BYTES))
        for x in flat.value_counts().to_pylist():
            if x["values"] is not None:
                held[x["values"]] += x["counts"]
        if len(held) > COUNTERS:
            cut = sorted(held.values(), reverse=True)[COUNTERS]
            held = Counter({k: v - cut for k, v in held.items() if v > cut})
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["term", "n"]
    )


def heavy_terms(df: DataFrame, terms: str) -> list[str]:
    """The terms that the summary counts most, in order of name; at most HEAVY_TERMS."""
    got = df.select(F.col(terms).alias("t")).mapInArrow(_summary, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    return sorted(r["term"] for r in got.orderBy(F.desc("n"), "term").limit(HEAVY_TERMS).collect())


def _counter(heavy: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(heavy, pa.string())
        n_heavy, d_heavy = np.zeros(len(heavy), np.int64), np.zeros(len(heavy), np.int64)

        def rows(term: pa.Array, n: np.ndarray, d: np.ndarray, is_heavy: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [term, pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(np.full(len(n), is_heavy))],
                names=["term", "n", "d", "heavy"],
            )

        for batch in batches:
            lists = batch.column(0)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            row = np.repeat(np.arange(len(sizes)), sizes)
            there = flat.is_valid().to_numpy(zero_copy_only=False)
            flat, row = flat.filter(pa.array(there)), row[there]
            if not len(flat):
                continue
            coded = flat.dictionary_encode()
            code, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
            n = np.bincount(code, minlength=len(words))
            once = np.unique(row * len(words) + code) % len(words)
            d = np.bincount(once, minlength=len(words))
            where = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False)
            hot = where >= 0
            n_heavy[where[hot]] += n[hot]
            d_heavy[where[hot]] += d[hot]
            light = np.flatnonzero(~hot)
            yield rows(words.take(pa.array(light)), n[light], d[light], False)
        met = np.flatnonzero(n_heavy)
        yield rows(known.take(pa.array(met)), n_heavy[met], d_heavy[met], True)

    return run


def term_frequencies(df: DataFrame, terms: str, heavy: list[str] | None = None) -> DataFrame:
    """``term, n_occurrences, n_records, heavy`` of every term in an array column.

    Each row is a record; a term that a record repeats adds to n_occurrences
    and once to n_records.  Null arrays and null elements hold no term; an
    empty string is a term like others, so callers filter it where it isn't.
    ``heavy`` is found by :func:`heavy_terms` unless given; it changes the
    speed, not the counts.
    """
    heavy = heavy_terms(df, terms) if heavy is None else sorted(set(heavy))
    part = df.select(F.col(terms).alias("t")).mapInArrow(_counter(heavy), "term string, n bigint, d bigint, heavy boolean")
    return part.groupBy("term", "heavy").agg(F.sum("n").alias("n_occurrences"), F.sum("d").alias("n_records"))


def mark(n_records: str, total, rare_below: int = 3, common_above: float = 1 / 50):
    """``rare`` below so many records, ``common`` above that share of ``total``; else null.

    Where both hold, as in tiny tables, the term is ``rare``.
    """
    n = F.col(n_records)
    return F.when(n < rare_below, F.lit("rare")).when(n > total * F.lit(common_above), F.lit("common"))
