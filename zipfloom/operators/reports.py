"""Evaluation reports over pair scores: accuracy, deltas, bins, regimes."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import broadcast_if_small, materialise, same_name

#: Distinct values of a bootstrap chunk, on average.
CHUNK_VALUES = 50_000

# Names that a column of scores or texts may have, in order of preference.
GOOD_TEXT = {"original": ["good_original", "sentence_good", "good", "grammatical"], "freq": ["good_freq", "good_rare"]}
BAD_TEXT = {"original": ["bad_original", "sentence_bad", "bad", "ungrammatical"], "freq": ["bad_freq", "bad_rare"]}


# ---- adapters ----------------------------------------------------------------


def scores_once(scores: DataFrame) -> DataFrame:
    """Each score once: its earliest arrival."""
    cols = scores.columns
    first = scores.groupBy("score_id").agg(F.min_by(F.struct(*cols), "ingested_at").alias("s"))
    return first.select("s.*")


def latest_records(records: DataFrame) -> DataFrame:
    """Each record as last written."""
    cols = records.columns
    return records.groupBy("record_id").agg(F.max_by(F.struct(*cols), "written_at").alias("s")).select("s.*")


def attach_meta(scores: DataFrame, records: DataFrame) -> DataFrame:
    """Scores with ``meta`` of the pair they score, by (dataset, subtask, idx).

    Of several records of a key the last written counts.  Scores without a
    record keep a null ``meta``.
    """
    key = ["dataset", "_sub", "idx"]
    meta = (
        records.withColumn("_sub", same_name("subtask"))
        .groupBy(*key)
        .agg(F.max_by("meta", F.struct("written_at", "record_id")).alias("meta"))
    )
    return scores.withColumn("_sub", same_name("subtask")).join(meta, key, "left").drop("_sub")


def pick_field(df: DataFrame, candidates: list[str]) -> str | None:
    """The first candidate column with a non-null value in any row."""
    have = [c for c in candidates if c in df.columns]
    if not have:
        return None
    n = df.agg(*[F.count(c).alias(c) for c in have]).first()
    return next((c for c in have if n[c]), None)


def sticky_field(df: DataFrame, candidates: list[str], order: list[str]) -> str | None:
    """The first candidate that the first qualifying row has: a row with any of them, in the given order."""
    there = [c for c in candidates if c in df.columns]
    if not there:
        return None
    has = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in there])
    row = df.where(has.isNotNull()).agg(F.min_by(has, F.struct(*order)).alias("field")).first()
    return row["field"]


def by_row(df: DataFrame, meta: DataFrame, keep: list[str], keys: tuple[str, ...] = ("file", "_row")) -> DataFrame:
    """``df`` with what ``meta`` has at the same physical row of the same file, else null.

    Of several rows of ``meta`` at one place the greatest counts.
    """
    once = meta.groupBy(*keys).agg(F.max(F.struct(*keep)).alias("_m"))
    return df.join(once, list(keys), "left").select(*df.columns, *[F.col(f"_m.{c}").alias(c) for c in keep])


def report_filter(
    scores: DataFrame, contains: str | None = None, window_only: bool = False, variant: str | None = None, least: int = 0, top: int | None = None, by: str = "dataset"
) -> DataFrame:
    """Rows of the datasets that a report is about.

    ``contains`` is part of a dataset's name; ``window_only`` keeps those named
    after a frequency window; ``least`` and ``top`` keep groups of at least so
    many rows, and the largest ones (ties by name).
    """
    got = scores
    if contains:
        got = got.where(F.col("dataset").contains(contains))
    if window_only:
        got = got.where(F.col("dataset").rlike(r"zw_\d+p\d+_\d+p\d+"))
    if variant:
        got = got.where(F.col("variant") == variant)
    if least or top is not None:
        sizes = got.groupBy(by).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
        sizes = sizes if top is None else sizes.orderBy(F.desc("_n"), by).limit(top)
        got = got.join(sizes.select(by), by, "left_semi")
    return got


def scorable_variant(df: DataFrame, variant: str = "auto") -> list[str]:
    """Variants with a row that has both texts; auto prefers freq, both gives all."""

    def there(v: str) -> bool:
        g, b = pick_field(df, GOOD_TEXT[v]), pick_field(df, BAD_TEXT[v])
        return bool(g and b and df.where(F.col(g).isNotNull() & F.col(b).isNotNull()).limit(1).count())

    if variant == "both":
        return [v for v in ("original", "freq") if there(v)]
    if variant == "auto":
        return next(([v] for v in ("freq", "original") if there(v)), [])
    v = "freq" if variant == "rare" else variant
    return [variant] if there(v) else []


# ---- accuracy ----------------------------------------------------------------


def unknown(c: str) -> Column:
    return F.when(F.col(c).isNull() | (F.col(c) == ""), F.lit("unknown")).otherwise(F.col(c))


def less(a: Column, b: Column) -> Column:
    """a < b where a comparison with NaN is false."""
    return F.coalesce(~F.isnan(a) & ~F.isnan(b) & (a < b), F.lit(False))


def normalised(scores: DataFrame, by: str = "none") -> DataFrame:
    """``g`` and ``b``, the likelihoods over none, chars or tokens; rows of no length drop out."""
    g, b = F.col("good_total_nll"), F.col("bad_total_nll")
    rows = scores.where(g.isNotNull() & b.isNotNull())
    if by == "none":
        return rows.withColumns({"g": g, "b": b})
    gl, bl = (F.length("good_text"), F.length("bad_text")) if by == "char" else (F.col("good_token_count"), F.col("bad_token_count"))
    return rows.where((gl > 0) & (bl > 0)).withColumns({"g": g / gl, "b": b / bl})


def accuracy(scores: DataFrame, by: str = "none", dims: list[str] | None = None) -> DataFrame:
    """Share of pairs whose good side is likelier: overall, per phenomenon, subtask and both.

    One pass with grouping sets.  Ties and NaN count as wrong; null or empty
    names are ``unknown``.  ``dims`` are further grouping columns of every level.
    """
    dims = dims or []
    rows = normalised(scores, by).select(
        *dims, unknown("phenomenon").alias("phenomenon"), unknown("subtask").alias("subtask"), less(F.col("g"), F.col("b")).cast("bigint").alias("ok")
    )
    p, s, d = F.col("phenomenon"), F.col("subtask"), [F.col(c) for c in dims]
    sets = [d, [*d, p], [*d, s], [*d, p, s]]
    got = rows.groupingSets(sets, *d, p, s).agg(
        F.sum("ok").alias("correct"), F.count("*").alias("total"), F.grouping("phenomenon").alias("_gp"), F.grouping("subtask").alias("_gs")
    )
    level = (
        F.when((F.col("_gp") == 1) & (F.col("_gs") == 1), "overall")
        .when(F.col("_gs") == 1, "phenomenon")
        .when(F.col("_gp") == 1, "subtask")
        .otherwise("phenomenon_subtask")
    )
    return got.select(
        *dims, level.alias("level"), "phenomenon", "subtask", F.round(F.col("correct") / F.col("total"), 6).alias("accuracy"), "correct", "total"
    )


def report_order(acc: DataFrame) -> DataFrame:
    """The report's order, as a rank within each level: accuracy, total, key."""
    w = Window.partitionBy("level").orderBy(F.desc("accuracy"), F.desc("total"), "phenomenon", "subtask")
    console = Window.partitionBy("level").orderBy(F.desc("total"), "phenomenon", "subtask")
    return acc.withColumns({"report_rank": F.row_number().over(w), "console_rank": F.row_number().over(console)})


def latest_runs(runs: DataFrame, group: list[str], ts: str, tie: str) -> DataFrame:
    """The rows of each group's latest run; the first name wins a tie."""
    w = Window.partitionBy(*group).orderBy(F.desc(ts), tie)
    best = runs.select(*group, ts, tie).distinct().withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return runs.join(best, [*group, ts, tie])


# ---- long form and deltas -----------------------------------------------------


def items(scores: DataFrame) -> DataFrame:
    """One row per score and side: ``score_id, side, variant, text, total_nll, ..``.

    Texts that are null or empty give no item; NaN and infinite likelihoods are
    null.
    """
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
    side = lambda s: F.struct(
        F.lit(s).alias("side"),
        F.col(f"{s}_text").alias("text"),
        finite(f"{s}_total_nll").alias("total_nll"),
        F.col(f"{s}_token_count").alias("token_count"),
        F.coalesce(F.col(f"swap_counts.{s[0]}_swaps"), F.lit(0)).alias("k_swaps"),
    )
    keys = ["score_id", "model", "dataset", "phenomenon", "subtask", "idx"]
    variant = F.lower(F.trim("variant"))
    got = scores.select(*keys, variant.alias("variant"), F.explode(F.array(side("good"), side("bad"))).alias("x"))
    return (
        got.select(*keys, "variant", "x.*")
        .where(F.length("text") > 0)
        .withColumn("char_len", F.length("text"))
        .withColumn("nll_per_char", F.col("total_nll") / F.col("char_len"))
    )


def _r(c: Column) -> Column:
    return F.round(c, 6)


def variant_stats(long: DataFrame) -> DataFrame:
    return long.groupBy("variant", "side").agg(
        F.count("*").alias("n_items"),
        _r(F.avg("total_nll")).alias("mean_total_nll"),
        _r(F.median("total_nll")).alias("median_total_nll"),
        _r(F.avg("nll_per_char")).alias("mean_nll_per_char"),
        _r(F.median("nll_per_char")).alias("median_nll_per_char"),
        _r(F.avg("token_count")).alias("mean_tokens"),
    )


def delta_stats(pairs: DataFrame, by: list[str], low: str, high: str) -> DataFrame:
    """``n_pairs, pct_higher, mean_delta, median_delta`` of high - low; rows with a null drop out."""
    d = F.col(high) - F.col(low)
    return (
        pairs.where(F.col(high).isNotNull() & F.col(low).isNotNull())
        .groupBy(*by)
        .agg(
            F.count("*").alias("n_pairs"),
            _r(F.avg((d > 0).cast("double")) * 100).alias("pct_higher"),
            _r(F.avg(d)).alias("mean_delta"),
            _r(F.median(d)).alias("median_delta"),
        )
    )


def wide_pairs(long: DataFrame, field: str, variants: list[str]) -> DataFrame:
    """Long to wide: one row per (model, dataset, subtask, idx), ``<side>_<variant>`` columns.

    Of a cell's items with a value the one with the greatest score_id counts.
    """
    key = ["model", "dataset", "subtask", "idx"]

    def cell(s: str, v: str) -> Column:
        here = (F.col("side") == s) & (F.col("variant") == v) & F.col(field).isNotNull()
        return F.max_by(F.when(here, F.col(field)), F.when(here, F.col("score_id"))).alias(f"{s}_{v}")

    return long.where("idx is not null").groupBy(*key).agg(*[cell(s, v) for s in ("good", "bad") for v in variants])


def subtask_gap(long: DataFrame, typical: str, rare: str, k: int = 8) -> DataFrame:
    """Subtasks by the difference of the rare and the typical mean, the ``k`` largest."""
    of = lambda v: F.avg(F.when(F.col("variant") == v, F.col("total_nll")))
    got = long.where("side = 'good'").groupBy(unknown("subtask").alias("subtask")).agg(of(typical).alias("t"), of(rare).alias("r"))
    got = got.where("t is not null and r is not null").select(
        "subtask", _r(F.col("t")).alias("typical_mean"), _r(F.col("r")).alias("rare_mean"), _r(F.col("r") - F.col("t")).alias("delta")
    )
    return got.orderBy(F.desc("delta"), "subtask").limit(k)


def swap_penalty(wide: DataFrame, typical: str, rare: str, k: str, by: list[str]) -> DataFrame:
    """Mean and median of (rare - typical) / k over rows with swaps."""
    d = (F.col(rare) - F.col(typical)) / F.col(k)
    rows = wide.where((F.col(k) > 0) & F.col(rare).isNotNull() & F.col(typical).isNotNull())
    return rows.groupBy(*by).agg(F.count("*").alias("n_pairs"), _r(F.avg(d)).alias("mean_per_swap"), _r(F.median(d)).alias("median_per_swap"))


def apportion(counts: DataFrame, limit: int) -> DataFrame:
    """Largest remainder: ``limit`` shared over keys in proportion to ``n``.

    Ties of the remainder go by count, then key, both descending; a limit above
    the total gives every key all it has.
    """
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    exact = F.least(F.lit(limit), total) * F.col("n") / total
    got = counts.withColumns({"_all": total, "_exact": exact}).withColumn("_floor", F.floor(F.round("_exact", 9)))
    rest = F.least(F.lit(limit), F.col("_all")) - F.sum("_floor").over(Window.partitionBy(F.lit(0)))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round(F.col("_exact") - F.col("_floor"), 9)), F.desc("n"), F.desc("key"))
    got = got.withColumns({"_rest": rest, "_n": F.row_number().over(order)})
    return got.select("key", "n", (F.col("_floor") + (F.col("_n") <= F.col("_rest")).cast("bigint")).alias("quota"))


def first_k(df: DataFrame, quotas: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first rows of each key, as many as its quota, in the given order.

    The largest quota bounds every key first, so that tasks keep no more than
    that before the shuffle.
    """
    most = quotas.agg(F.max("quota")).first()[0] or 0
    w = Window.partitionBy(key).orderBy(*order)
    ranked = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= int(most))
    q = quotas.select(F.col("key").alias(key), "quota")
    return ranked.join(broadcast_if_small(q), key).where(F.col("_n") <= F.col("quota")).drop("_n", "quota")


# ---- frequencies of swapped words ----------------------------------------------


def swapped_words(records: DataFrame) -> DataFrame:
    """``record_id, role, word`` of every swapped word, before and after."""
    part = lambda a, old, new: F.transform(
        F.coalesce(F.filter(F.col(f"meta.{a}"), lambda s: s.isNotNull()), F.filter(F.array(F.col(f"meta.{a}")[0]), lambda s: F.lit(False))),
        lambda s: F.array(F.struct(F.lit(old).alias("role"), s["old"].alias("word")), F.struct(F.lit(new).alias("role"), s["new"].alias("word"))),
    )
    both = F.flatten(F.concat(part("g_swaps", "good_original", "good_freq"), part("b_swaps", "bad_original", "bad_freq")))
    return records.select("record_id", F.explode(both).alias("x")).select("record_id", "x.role", "x.word").where("word is not null")


def zipf_aggregates(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Per record and role: words in and out of the lexicon, mean, median and least frequency.

    A word that isn't in the lexicon has frequency 0 and counts as unknown.
    """
    lex = lexicon.groupBy(F.lower("word").alias("w")).agg(F.max("zipf").alias("zipf"))
    z = F.coalesce("zipf", F.lit(0.0))
    got = words.join(lex, F.lower(F.trim("word")) == F.col("w"), "left").withColumn("z", z)
    known = F.when(F.col("z") > 0, F.col("z"))
    return got.groupBy("record_id", "role").agg(
        F.count(known).alias("n"),
        F.count_if(F.col("z") <= 0).alias("oov_count"),
        _r(F.avg(known)).alias("mean"),
        _r(F.median(known)).alias("median"),
        F.min(known).alias("min"),
    )


def zipf_lexicon(texts: DataFrame, column: str) -> DataFrame:
    """Words, counts and Zipf frequency (log10 of the rate per billion) of a corpus."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(column), F.lit(r"([\p{L}\p{M}]+)"), F.lit(1))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").cast("double"))
    return counts.select("word", "n", F.round(F.log10(F.lit(1e9) * F.col("n") / total.scalar()), 2).alias("zipf"))


def _aggregate_field(field: str, stat: str) -> Column:
    return F.try_element_at(F.col("meta.zipf_swapped_position_aggregates"), F.regexp_replace(F.col(field), "_rare$", "_freq"))[stat]


def with_zipf(scored: DataFrame, stat: str = "median") -> DataFrame:
    """``good_zipf``, ``bad_zipf`` and ``zipf_mid``, the mean of those that are there."""
    got = scored.withColumns({"good_zipf": _aggregate_field("good_field", stat), "bad_zipf": _aggregate_field("bad_field", stat)})
    mid = F.coalesce((F.col("good_zipf") + F.col("bad_zipf")) / 2, F.col("good_zipf"), F.col("bad_zipf"))
    return got.withColumn("zipf_mid", mid)


def zipf_rollup(records: DataFrame) -> DataFrame:
    """Per variant: means and medians of the records' mean, median and least frequency."""
    got = records.select("record_id", F.explode("meta.zipf_swapped_position_aggregates").alias("variant", "a"))
    stats = {f"{f}_of_{m}_zipf": _r(getattr(F, g)(f"a.{m}")) for m in ("mean", "median", "min") for f, g in (("mean", "avg"), ("median", "median"))}
    return got.groupBy("variant").agg(
        F.count("*").alias("n_items"),
        F.count("a.mean").alias("n_with_iv"),
        *[c.alias(n) for n, c in stats.items()],
        F.coalesce(F.sum("a.n"), F.lit(0)).alias("total_iv_tokens"),
        F.coalesce(F.sum("a.oov_count"), F.lit(0)).alias("total_oov"),
    )


def zipf_deltas(records: DataFrame, low: str, high: str) -> DataFrame:
    """Differences of two variants' aggregates, per metric."""
    agg = F.col("meta.zipf_swapped_position_aggregates")
    metrics = F.explode(
        F.array(*[F.struct(F.lit(m).alias("metric"), F.try_element_at(agg, F.lit(low))[m].alias("lo"), F.try_element_at(agg, F.lit(high))[m].alias("hi")) for m in ("mean", "median", "min")])
    )
    return delta_stats(records.select(metrics.alias("x")).select("x.*"), ["metric"], "lo", "hi")


# ---- regimes -------------------------------------------------------------------


def regime_histogram(rows: DataFrame, bins: int = 20) -> DataFrame:
    """Counts and density of ``zipf_mid`` in equal bins over each regime's range."""
    edges = rows.where("zipf_mid is not null and regime is not null").groupBy("regime").agg(F.min("zipf_mid").alias("lo"), F.max("zipf_mid").alias("hi"), F.count("*").alias("all"))
    joined = rows.where("zipf_mid is not null").join(broadcast_if_small(edges), "regime")
    span = F.col("hi") - F.col("lo")
    b = F.when(span == 0, F.lit(0)).otherwise(F.least(F.floor((F.col("zipf_mid") - F.col("lo")) * bins / span), F.lit(bins - 1)))
    return joined.groupBy("regime", b.cast("int").alias("bin")).agg(
        F.count("*").alias("n"), _r(F.try_divide(F.count("*") * bins, F.first(F.col("all") * span))).alias("density")
    )


def top_share(rows: DataFrame, by: str, item: str, k: int = 20) -> DataFrame:
    """The share of the ``k`` most frequent items in each group's total."""
    counts = rows.where(f"{item} is not null and {by} is not null").groupBy(by, item).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), item)
    ranked = counts.withColumn("_n", F.row_number().over(w))
    return ranked.groupBy(by).agg(
        F.sum("n").alias("total"), _r(F.sum(F.when(F.col("_n") <= k, F.col("n"))) / F.sum("n")).alias("top_share")
    )


def top_k(rows: DataFrame, by: list[str], item: list[str], k: int) -> DataFrame:
    """The ``k`` most frequent items per group; ties by name."""
    counts = rows.groupBy(*by, *item).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), *item)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# ---- bins and correlation --------------------------------------------------------


def quantile_edges(df: DataFrame, x: str, q: int) -> list[float]:
    """Distinct edges of ``q`` quantile bins, interpolated; q + 1 numbers at most."""
    at = [i / q for i in range(q + 1)]
    row = df.where(F.col(x).isNotNull()).agg(F.percentile(x, F.array(*map(F.lit, at)))).first()
    return sorted(set(row[0] or []))


def bin_of(x: str, edges: list[float]) -> Column:
    """The right-closed bin of ``x``, the lowest value included; null outside."""
    c = F.col(x)
    if len(edges) < 2:
        return F.lit(None).cast("int")
    e = F.array(*map(F.lit, edges))
    below = F.aggregate(e, F.lit(0), lambda a, v: a + (v < c).cast("int"))
    return F.when((c < edges[0]) | (c > edges[-1]), None).when(c == edges[0], 0).otherwise(below - 1)


def bin_mid(edges: list[float], b: Column) -> Column:
    """The middle of a bin by its printed edges: three digits, the first moved 0.001 left."""
    printed = [float(np.round(v, 3)) for v in edges]
    if printed:
        printed[0] = float(np.round(printed[0] - 0.001, 3))
    mids = [(lo + hi) / 2 for lo, hi in zip(printed, printed[1:])]
    return F.element_at(F.array(*map(F.lit, mids or [0.0])), b + 1)


def binned(df: DataFrame, x: str, y: str, by: list[str], q: int = 20, least: int = 25) -> DataFrame:
    """Per group and quantile bin (edges over all groups): n, mean, normal 95% interval, mid."""
    edges = quantile_edges(df.where(F.col(y).isNotNull()), x, q)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("bin", bin_of(x, edges)).where("bin is not null")
    half = F.lit(1.96) * F.stddev_samp(y) / F.sqrt(F.count("*"))
    got = rows.groupBy(*by, "bin").agg(
        F.count("*").alias("n"), _r(F.avg(y)).alias("mean"), _r(F.avg(y) - half).alias("ci_low"), _r(F.avg(y) + half).alias("ci_high"), _r(F.avg(x)).alias("mean_x")
    )
    return got.where(F.col("n") >= least).withColumn("mid", _r(bin_mid(edges, F.col("bin"))))


def bootstrap_ci(df: DataFrame, y: str, by: list[str], resamples: int = 600, seed: int = 0) -> DataFrame:
    """Bootstrap 95% interval of each group's mean.

    Each resample weighs a row by a Poisson draw (rows of one value by one draw
    of their number).  Distinct values go to chunks by their hash; a chunk adds
    up its weighted sums, ``resamples`` numbers a group, so neither a hot group
    nor its values meet in one task.  Equal rows and seed give equal intervals.
    """
    counts = df.where(F.col(y).isNotNull() & ~F.isnan(y)).groupBy(*by, F.col(y).cast("double").alias("v")).agg(F.count("*").alias("n"))
    counts = materialise(counts, "bootstrap")
    chunks = max(1, -(-counts.count() // CHUNK_VALUES))
    kinds = ", ".join(f"`{c}` {counts.schema[c].dataType.simpleString()}" for c in by)
    chunked = counts.withColumn("_c", F.pmod(F.xxhash64("v"), F.lit(chunks)))

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        v, n = pdf["v"].to_numpy(float), pdf["n"].to_numpy(np.int64)
        key = zlib.crc32(repr([str(x) for x in pdf[by].iloc[0]]).encode())
        rng = np.random.default_rng([seed & 0xFFFFFFFF, key, int(pdf["_c"].iloc[0])])
        weight, total = np.zeros(resamples), np.zeros(resamples)
        for lo in range(0, len(v), 4096):
            w = rng.poisson(n[lo : lo + 4096], (resamples, len(n[lo : lo + 4096])))
            weight += w.sum(axis=1)
            total += w @ v[lo : lo + 4096]
        out = pd.DataFrame({"_r": np.arange(resamples), "w": weight, "t": total, "n": np.where(np.arange(resamples) == 0, n.sum(), 0), "s": np.where(np.arange(resamples) == 0, n @ v, 0.0)})
        for c in by:
            out[c] = pdf[c].iloc[0]
        return out[[*by, "_r", "w", "t", "n", "s"]]

    sums = chunked.groupBy(*by, "_c").applyInPandas(part, f"{kinds}, _r int, w double, t double, n bigint, s double")
    each = sums.groupBy(*by, "_r").agg(*[F.sum(c).alias(c) for c in ("w", "t", "n", "s")])
    at = F.percentile(F.try_divide("t", "w"), F.array(F.lit(0.025), F.lit(0.975)))  # of the resamples
    return each.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"), at.alias("_ci")).select(
        *by, "n", "mean", F.col("_ci")[0].alias("ci_low"), F.col("_ci")[1].alias("ci_high")
    )


def _ranks(pairs: DataFrame, x: str, by: list[str], out: str) -> DataFrame:
    """Average ranks of distinct values, out of counted pairs."""
    counts = pairs.groupBy(*by, x).agg(F.sum("n").alias("_n"))
    w = Window.partitionBy(*by).orderBy(x).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn(out, F.sum("_n").over(w) - (F.col("_n") - 1) / 2.0).drop("_n")


def average_ranks(df: DataFrame, x: str, by: list[str], out: str) -> DataFrame:
    """Ranks from 1; ties share the mean of theirs.

    Counts per distinct value are ranked and joined back, so one group's rows
    needn't be sorted in one task; the window runs over distinct values.
    """
    return df.join(_ranks(df.groupBy(*by, x).agg(F.count("*").alias("n")), x, by, out), [*by, x])


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Spearman's rho with average ranks, n and p by Fisher's z; null below three rows.

    Rows become counted distinct pairs first, so a value that most rows share
    is one row of the joins; null groups are groups.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    pairs = materialise(rows.groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").alias("n")), "pairs")
    ranked = pairs
    for c, r in (("_x", "_rx"), ("_y", "_ry")):
        own = _ranks(pairs, c, by, r).select(*[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)], F.col(c).alias("_v"), r)
        cond = F.col(c) == F.col("_v")
        for i, b in enumerate(by):
            cond = cond & F.col(b).eqNullSafe(F.col(f"_b{i}"))
        ranked = ranked.join(own, cond).drop("_v", *[f"_b{i}" for i in range(len(by))])
    # the mean of average ranks is known beforehand, so the sums lose no digits
    sizes = ranked.withColumn("_mid", (F.sum("n").over(Window.partitionBy(*by)) + 1) / 2.0)
    dx, dy = F.col("_rx") - F.col("_mid"), F.col("_ry") - F.col("_mid")
    got = sizes.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum(dx * dy * F.col("n")).alias("_xy"), F.sum(dx * dx * F.col("n")).alias("_xx"), F.sum(dy * dy * F.col("n")).alias("_yy")
    )
    rho = F.when(F.col("n") >= 3, F.try_divide(F.col("_xy"), F.sqrt("_xx") * F.sqrt("_yy")))
    return got.select(*by, "n", _r(rho).alias("rho"), _r(_fisher(rho, F.col("n"))).alias("p"))


def _fisher(rho: Column, n: Column) -> Column:
    """Two-sided p by Fisher's z, with a rational approximation of erfc (error below 1.2e-7)."""
    r = F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), rho))
    z = F.abs(F.atanh(r)) * F.sqrt(n - 3) / math.sqrt(2)
    t = 1 / (1 + 0.5 * z)
    # Coefficients of the approximation (Numerical Recipes, erfcc).
    terms = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(terms[-1])
    for c in reversed(terms[:-1]):
        poly = poly * t + c
    return F.when(n >= 4, t * F.exp(-z * z + poly))


def fisher_p(rho: float | None, n: int) -> float | None:
    """Two-sided p of a rank correlation."""
    if rho is None or n < 4:
        return None
    r = max(-0.999999, min(0.999999, rho))
    return math.erfc(abs(math.atanh(r)) * math.sqrt(n - 3) / math.sqrt(2))


def merge_series(rows: DataFrame, label: Column) -> DataFrame:
    """Bins of series that share a label as one, weighted by their rows."""
    return rows.groupBy(label.alias("label"), "mid").agg(
        _r(F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("n")
    )


def length_stats(rows: DataFrame, by: list[str]) -> DataFrame:
    """Token lengths and frequencies of both sides and their differences."""
    got = rows.where("good_token_count is not null and bad_token_count is not null").withColumns(
        {"len_diff": F.col("good_token_count") - F.col("bad_token_count"), "zipf_diff": F.col("good_zipf") - F.col("bad_zipf")}
    )
    cols = {"good_len": "good_token_count", "bad_len": "bad_token_count", "len_diff": "len_diff", "zipf_diff": "zipf_diff"}
    aggs = [_r(f(c)).alias(f"{n}_{k}") for k, c in cols.items() for n, f in (("mean", F.avg), ("median", F.median))]
    return got.groupBy(*by).agg(F.count("*").alias("n"), *aggs)


def length_label(model: Column | str) -> Column:
    """A model's display name: the slug without a trailing tuning mark."""
    return F.regexp_replace(T.model_slug(model), "-instruct$", "")
