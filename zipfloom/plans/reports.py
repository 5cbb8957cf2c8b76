"""Queries of the evaluation reports and the SQL they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import reports as R
from ..runtime import broadcast_if_small, materialise, same_name, same_name_sql, table


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return R.scores_once(table(spark, d, "pair_score"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    return R.latest_records(table(spark, d, "generated_pair"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return R.items(_scores(spark, d))


def _joined(spark: SparkSession, d: str) -> DataFrame:
    got = R.with_zipf(R.attach_meta(_scores(spark, d), _records(spark, d)))
    return got.withColumn("regime", T.regime("zipf_lo", "zipf_hi", "variant"))


def a1_accuracy(spark, d):
    """Accuracy overall, by phenomenon, by subtask and by both."""
    return R.accuracy(_scores(spark, d))


def a1_accuracy_per_token(spark, d):
    return R.accuracy(_scores(spark, d), "token")


def a1_accuracy_per_char(spark, d):
    return R.accuracy(_scores(spark, d), "char")


def o1_report_order(spark, d):
    """The accuracy report with its order as ranks."""
    return R.report_order(R.accuracy(_scores(spark, d)))


def a27_run_summary(spark, d):
    """Overall and per-phenomenon accuracy of each model, dataset and variant."""
    got = R.accuracy(_scores(spark, d).withColumn("variant", F.lower(F.trim("variant"))), dims=["model", "dataset", "variant"])
    return got.where("level in ('overall', 'phenomenon')").drop("subtask")


def w6_latest_run(spark, d):
    """Accuracy of each model's and regime's latest run."""
    rows = _scores(spark, d).withColumn("regime", T.regime("zipf_lo", "zipf_hi", "variant")).where("regime is not null")
    best = R.latest_runs(rows, ["model", "regime"], "run_ts", "dataset")
    return R.accuracy(best, dims=["model", "regime"]).where("level = 'overall'").drop("phenomenon", "subtask", "level")


def a13_mean_delta(spark, d):
    """Mean difference of bad and good likelihood of each model's and regime's latest run."""
    rows = _scores(spark, d).withColumn("regime", T.regime("zipf_lo", "zipf_hi", "variant")).where("regime is not null")
    best = R.latest_runs(rows, ["model", "regime"], "run_ts", "dataset")
    delta = F.col("bad_total_nll") - F.col("good_total_nll")
    ok = ~F.isnan(delta) & (F.abs(delta) < float("inf"))
    return best.where(ok).groupBy("model", "regime").agg(F.count("*").alias("n"), F.round(F.avg(delta), 6).alias("mean_delta"))


def a3_swap_counts(spark, d):
    """Swaps of both sides, as scored and as recorded."""
    n = lambda a: F.coalesce(F.size(F.filter(f"meta.{a}", lambda s: s.isNotNull())), F.lit(0))
    rec = _records(spark, d)
    return rec.groupBy(F.greatest(n("g_swaps"), F.lit(0)).alias("g_swaps"), F.greatest(n("b_swaps"), F.lit(0)).alias("b_swaps")).agg(F.count("*").alias("n_records"))


def a4_variant_stats(spark, d):
    return R.variant_stats(_items(spark, d))


def _wide(spark, d, field="total_nll"):
    return R.wide_pairs(_items(spark, d), field, ["freq", "rare"])


def a5_good_bad(spark, d):
    """How much the bad side costs more than the good one, per variant."""
    it = _items(spark, d)
    w = it.groupBy("score_id", "variant").agg(
        F.max(F.when(F.col("side") == "good", F.col("total_nll"))).alias("good"), F.max(F.when(F.col("side") == "bad", F.col("total_nll"))).alias("bad")
    )
    return R.delta_stats(w, ["variant"], "good", "bad")


def a5_rare_typical(spark, d):
    """How much the rare variant costs more than the frequent one, per side."""
    w = _wide(spark, d)
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_freq").alias("lo"), F.col(f"{s}_rare").alias("hi")) for s in ("good", "bad")]))
    return R.delta_stats(w.select(sides.alias("x")).select("x.*"), ["side"], "lo", "hi")


def j7_wide(spark, d):
    """Long to wide: likelihoods of both sides and variants per pair."""
    return _wide(spark, d).where("good_rare is not null or good_freq is not null")


def a6_subtask_gap(spark, d):
    return R.subtask_gap(_items(spark, d), "freq", "rare")


def a7_swap_penalty(spark, d):
    """The penalty per swap of the bad side over the good one."""
    rows = _scores(spark, d).withColumn("k", F.col("swap_counts.g_swaps")).where(~F.isnan("good_total_nll") & ~F.isnan("bad_total_nll"))
    rows = rows.where((F.abs("good_total_nll") < float("inf")) & (F.abs("bad_total_nll") < float("inf")))
    return R.swap_penalty(rows, "good_total_nll", "bad_total_nll", "k", ["model"])


def a8_zipf_rollup(spark, d):
    return R.zipf_rollup(_records(spark, d))


def a8_rare_typical(spark, d):
    return R.zipf_deltas(_records(spark, d), "good_original", "good_freq")


def a8_good_bad(spark, d):
    return R.zipf_deltas(_records(spark, d), "good_freq", "bad_freq")


def a20_grammar_points(spark, d):
    """Per pair: sensitivity to grammar of the frequent and the rare variant and its change."""
    w = _wide(spark, d).where("good_freq is not null and bad_freq is not null and good_rare is not null and bad_rare is not null")
    g = w.withColumns({"g_freq": F.col("bad_freq") - F.col("good_freq"), "g_rare": F.col("bad_rare") - F.col("good_rare")})
    return g.select("model", "dataset", "subtask", "idx", *[F.round(c, 6).alias(c) for c in ("g_freq", "g_rare")], F.round(F.col("g_rare") - F.col("g_freq"), 6).alias("delta_g"))


def a23_apportion(spark, d):
    """A limit of 500 shared over subtasks by largest remainder."""
    counts = table(spark, d, "source_pair").groupBy(same_name("subtask").alias("key")).agg(F.count("*").alias("n")).where("key is not null")
    return R.apportion(counts, 500)


def w5_first_k(spark, d):
    """The first rows of each subtask up to its quota."""
    src = table(spark, d, "source_pair").withColumn("key", same_name("subtask")).where("key is not null")
    once = src.groupBy("key", "idx").agg(F.min("sentence_good").alias("sentence_good"))
    return R.first_k(once, R.apportion(once.groupBy("key").agg(F.count("*").alias("n")), 300), "key", ["idx"])


def a2_zipf_aggregates(spark, d):
    """Frequencies of swapped words by record and role, out of the lexicon."""
    return R.zipf_aggregates(R.swapped_words(_records(spark, d)), table(spark, d, "zipf_lexicon"))


def s15_lexicon(spark, d):
    """A frequency lexicon of the documents."""
    return R.zipf_lexicon(table(spark, d, "documents"), "text")


def j2_scores_with_meta(spark, d):
    """Scores joined to the meta of their pair."""
    got = _joined(spark, d)
    return got.select("score_id", "regime", F.round("good_zipf", 6).alias("good_zipf"), F.round("bad_zipf", 6).alias("bad_zipf"), F.round("zipf_mid", 6).alias("zipf_mid"))


def a9_histogram(spark, d):
    return R.regime_histogram(_joined(spark, d))


def a9_top_lemmas(spark, d):
    """The share of the 20 most frequent replacement lemmas per regime."""
    rows = _joined(spark, d).select("regime", F.explode(F.concat(*[F.coalesce(F.col(f"meta.{a}.lemma"), F.array().cast("array<string>")) for a in ("g_swaps", "b_swaps")])).alias("lemma"))
    return R.top_share(rows.where("lemma <> ''"), "regime", "lemma")


def a9_token_length(spark, d):
    rows = _joined(spark, d).where("regime is not null and good_token_count is not null and bad_token_count is not null")
    return rows.groupBy("model", "regime").agg(F.round(F.avg("good_token_count"), 6).alias("good_avg"), F.round(F.avg("bad_token_count"), 6).alias("bad_avg"), F.count("*").alias("n"))


def a9_imbalance(spark, d):
    rows = _joined(spark, d).where("regime is not null and good_zipf is not null and bad_zipf is not null").withColumn("x", F.col("good_zipf") - F.col("bad_zipf"))
    return rows.groupBy("regime").agg(F.round(F.avg("x"), 6).alias("mean_diff"), F.round(F.avg(F.abs("x")), 6).alias("mean_abs_diff"), F.count("*").alias("n"))


def a9_success(spark, d):
    fail = F.col("meta.swap_failed_reason")
    return _joined(spark, d).where("regime is not null").groupBy("regime").agg(F.count("*").alias("n"), F.round(1 - F.count(F.nullif(fail, F.lit(""))) / F.count("*"), 6).alias("success_rate"))


def a9_reasons(spark, d):
    """The three most frequent reasons of failure per regime."""
    rows = _joined(spark, d).select("regime", F.col("meta.swap_failed_reason").alias("reason")).where("regime is not null and reason <> ''")
    return R.top_k(rows, ["regime"], ["reason"], 3)


def a14_length_stats(spark, d):
    rows = _joined(spark, d).withColumn("variant", F.lower(F.trim("variant"))).where("regime is not null")
    return R.length_stats(rows, ["variant", "dataset", "regime"])


def _plain(spark, d):
    ok = ~F.isnan("good_total_nll") & (F.abs("good_total_nll") < float("inf"))
    return _joined(spark, d).where(ok).withColumn("y", F.col("good_total_nll"))


def a10_zipf_bins(spark, d):
    """Likelihood by quantile bin of the swapped words' frequency, per model."""
    return R.binned(materialise(_plain(spark, d).select("model", "good_zipf", "y"), "bins"), "good_zipf", "y", ["model"]).drop("ci_low", "ci_high", "mean_x")


def a11_bootstrap(spark, d):
    """Bootstrap interval of the mean likelihood per model."""
    got = R.bootstrap_ci(_scores(spark, d).where(F.abs("good_total_nll") < float("inf")), "good_total_nll", ["model"])
    return got.select("model", "n", *[F.round(c, 6).alias(c) for c in ("mean", "ci_low", "ci_high")])


def a12_spearman(spark, d):
    """Rank correlation of frequency and likelihood per model."""
    return R.spearman(_plain(spark, d), "good_zipf", "y", ["model"])


def w4_average_rank(spark, d):
    rows = _scores(spark, d).where("good_token_count is not null").select("score_id", "model", "good_token_count")
    return R.average_ranks(rows, "good_token_count", ["model"], "avg_rank")


def a18_merged_series(spark, d):
    """Token length by bin, models of one label merged."""
    rows = materialise(_plain(spark, d).where("good_token_count > 0").select("model", "good_zipf", F.col("good_token_count").cast("double").alias("y")), "bins")
    return R.merge_series(R.binned(rows, "good_zipf", "y", ["model"], least=1), R.length_label("model"))


def a19_mean_curve(spark, d):
    """Mean penalty by tenth of the rare side's frequency, with mean x."""
    rows = materialise(_plain(spark, d).where(~F.isnan("bad_total_nll")).select("good_zipf", (F.col("bad_total_nll") - F.col("good_total_nll")).alias("y")).where("y < double('infinity')"), "bins")
    return R.binned(rows, "good_zipf", "y", [], q=10, least=20).select("bin", "n", "mean", "mean_x")


def f18_regimes(spark, d):
    """Regime of every window that occurs."""
    return table(spark, d, "pair_score").select("dataset", "zipf_lo", "zipf_hi").where(F.col("zipf_lo").isNotNull() & ~F.isnan("zipf_lo")).distinct().withColumn("regime", T.regime("zipf_lo", "zipf_hi"))


def o6_model_order(spark, d):
    """Models by the size in their name."""
    return table(spark, d, "pair_score").select("model").distinct().withColumn("size", T.model_size("model")).withColumn("label", R.length_label("model"))


def p4_skipped(spark, d):
    """Rows with and without both likelihoods per variant."""
    both = F.col("good_total_nll").isNotNull() & F.col("bad_total_nll").isNotNull()
    return _scores(spark, d).groupBy(F.lower(F.trim("variant")).alias("variant")).agg(F.count_if(both).alias("scored"), F.count_if(~both).alias("skipped"))


def p26_fields(spark, d):
    return _scores(spark, d).groupBy(T.normal_field("field").alias("field")).agg(F.count("*").alias("n"))


def j1_field_map(spark, d):
    """A record's field, from its subtask's map where it has none of its own."""
    src = table(spark, d, "source_pair").select(same_name("subtask").alias("sub"), T.normal_field("field").alias("f"))
    fields = src.where("f is not null").groupBy("sub").agg(F.min("f").alias("mapped"))
    own = _records(spark, d).select("record_id", same_name("subtask").alias("sub"), T.normal_field("field").alias("own"))
    return own.join(fields, "sub", "left").select("record_id", F.coalesce("own", "mapped").alias("field"))


def p25_collapsed(spark, d):
    """Pairs whose sides came out equal: both nulled, with the reason."""
    rec = _records(spark, d)
    same = F.col("good_freq") == F.col("bad_freq")
    return rec.select(
        "record_id", F.when(~same, F.col("good_freq")).alias("good_freq"), F.when(~same, F.col("bad_freq")).alias("bad_freq"),
        F.when(same, F.lit("pair_collapsed")).otherwise(F.col("meta.swap_failed_reason")).alias("reason"),
    ).where("reason is not null")


def p28_quality(spark, d):
    """Counts of equal sides, missing texts, missing end marks and merged possessives."""
    g, b = F.col("good_freq"), F.col("bad_freq")
    has = lambda c: F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
    open_ = lambda c: F.trim(c).rlike(r"[^.!?]$")
    merged = lambda c: F.trim(c).rlike(r"\b\w+s'(?!s)\w")
    n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    both = has(g) & has(b)
    return _records(spark, d).agg(
        F.count("*").alias("records"), n(~both).alias("missing"), n(both & (g == b)).alias("same"),
        (n(both & open_(g)) + n(both & open_(b))).alias("no_end"), (n(both & merged(g)) + n(both & merged(b))).alias("merged"),
    )


def a26_issue_counts(spark, d):
    """The eight (phenomenon, subtask) with most missing texts."""
    rows = _records(spark, d).where("coalesce(trim(good_freq), '') = '' or coalesce(trim(bad_freq), '') = ''")
    got = rows.select(R.unknown("phenomenon").alias("phenomenon"), same_name("subtask").alias("subtask"), F.lit(1).alias("one"))
    return R.top_k(got, ["one"], ["phenomenon", "subtask"], 8).drop("one")


def a28_reasons(spark, d):
    """Single reasons out of the joined ones, distinct per record."""
    rows = _records(spark, d).where("meta.swap_failed_reason <> ''").select("record_id", F.explode(F.array_distinct(F.split("meta.swap_failed_reason", "\\|"))).alias("reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


def p7_merged_swaps(spark, d):
    """Slim swaps of both sides as one array, ordered by place and part of speech (shown as text)."""
    slim = lambda a: F.filter(F.col(f"meta.{a}"), lambda s: s["old"].isNotNull() & s["new"].isNotNull())
    none = F.array().cast("array<struct<i:int,old:string,new:string,tag:string,lemma:string,pos:string>>")
    both = F.array_sort(F.transform(F.concat(F.coalesce(slim("g_swaps"), none), F.coalesce(slim("b_swaps"), none)), lambda s: F.struct(s["i"], s["pos"], s["old"], s["new"], s["tag"], s["lemma"])))
    text = F.array_join(F.transform(both, lambda s: F.concat_ws("/", s["i"].cast("string"), s["pos"], s["old"], s["new"])), " ")
    return _records(spark, d).select("record_id", text.alias("swaps")).where("swaps <> ''")


def d2_task_list(spark, d):
    """The flattened configuration, each subtask once, in its order."""
    rows = table(spark, d, "task_config").groupBy("grp", "phenomenon", same_name("subtask").alias("subtask")).agg(F.min("ord").alias("ord"))
    return rows


def p23_phenomenon(spark, d):
    """Pairs of a group or phenomenon, whatever its case."""
    want = ["clitic_order", "word_order"]
    cfg = d2_task_list(spark, d).where(F.lower("grp").isin(want) | F.lower("phenomenon").isin(want)).select("subtask")
    src = table(spark, d, "source_pair").withColumn("subtask", same_name("subtask"))
    return src.join(broadcast_if_small(cfg), "subtask", "left_semi").groupBy("subtask").agg(F.count("*").alias("n"))


def s24_run_dims(spark, d):
    """Dimensions out of file names."""
    from ..sources.files import dataset_dims

    return table(spark, d, "raw_line").select("file_name").distinct().select("file_name", *dataset_dims("file_name"))


QUERIES = {
    f.__name__: f
    for f in (
        a1_accuracy, a1_accuracy_per_token, a1_accuracy_per_char, o1_report_order, a27_run_summary, w6_latest_run, a13_mean_delta,
        a3_swap_counts, a4_variant_stats, a5_good_bad, a5_rare_typical, j7_wide, a6_subtask_gap, a7_swap_penalty, a8_zipf_rollup,
        a8_rare_typical, a8_good_bad, a20_grammar_points, a23_apportion, w5_first_k, a2_zipf_aggregates, s15_lexicon, j2_scores_with_meta,
        a9_histogram, a9_top_lemmas, a9_token_length, a9_imbalance, a9_success, a9_reasons, a14_length_stats, a10_zipf_bins, a11_bootstrap,
        a12_spearman, w4_average_rank, a18_merged_series, a19_mean_curve, f18_regimes, o6_model_order, p4_skipped, p26_fields, j1_field_map,
        p25_collapsed, p28_quality, a26_issue_counts, a28_reasons, p7_merged_swaps, d2_task_list, p23_phenomenon, s24_run_dims,
    )
}
# names as the report's operator ids, kept apart from the numbered problems
QUERIES = {("op_" + n if n[0] == "p" else n): f for n, f in QUERIES.items()}

# ---- SQL -----------------------------------------------------------------------

_S = "scores AS (SELECT * FROM pair_score QUALIFY row_number() OVER (PARTITION BY score_id ORDER BY ingested_at) = 1)"
_REC = "records AS (SELECT * FROM generated_pair QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY written_at DESC) = 1)"
_UNK = lambda c: f"coalesce(nullif({c}, ''), 'unknown')"
_OK = "(NOT isnan(g) AND NOT isnan(b) AND g < b)"
_REGIME = """CASE WHEN lower(trim(variant)) = 'original' THEN 'original'
  WHEN (zipf_lo = 4.0 AND zipf_hi = 5.2) OR (zipf_lo = 3.6 AND zipf_hi = 5.0) THEN 'head'
  WHEN zipf_lo = 2.2 AND zipf_hi = 3.0 THEN 'tail' WHEN zipf_lo = 1.2 AND zipf_hi = 2.0 THEN 'xtail'
  WHEN zipf_lo = zipf_hi AND zipf_lo BETWEEN 3.6 AND 5.2 THEN 'head' WHEN zipf_lo = zipf_hi AND zipf_lo BETWEEN 2.2 AND 3.0 THEN 'tail'
  WHEN zipf_lo = zipf_hi AND zipf_lo BETWEEN 1.2 AND 2.0 THEN 'xtail' END"""
_VAR = "lower(trim(variant))"
_SUB = same_name_sql
_FIN = lambda c: f"(isfinite({c}))"


def _acc(g: str, b: str, where: str, dims: str = "", source: str = "scores") -> str:
    d = f"{dims}, " if dims else ""
    sets = ", ".join(f"({', '.join(x for x in (dims, k) if x)})" for k in ("", "phenomenon", "subtask", "phenomenon, subtask"))
    return f"""rows AS (SELECT {d}{_UNK('phenomenon')} AS phenomenon, {_UNK('subtask')} AS subtask, {g} AS g, {b} AS b FROM {source}
      WHERE good_total_nll IS NOT NULL AND bad_total_nll IS NOT NULL {where}),
    acc AS (SELECT {d}CASE WHEN grouping(phenomenon) = 1 AND grouping(subtask) = 1 THEN 'overall' WHEN grouping(subtask) = 1 THEN 'phenomenon'
        WHEN grouping(phenomenon) = 1 THEN 'subtask' ELSE 'phenomenon_subtask' END AS level, phenomenon, subtask,
        round(count(*) FILTER ({_OK}) / count(*), 6) AS accuracy, count(*) FILTER ({_OK}) AS correct, count(*) AS total
      FROM rows GROUP BY GROUPING SETS ({sets}))"""


_ITEMS = f"""items AS (SELECT *, length(text) AS char_len, total_nll / length(text) AS nll_per_char FROM (
  SELECT score_id, model, dataset, phenomenon, subtask, idx, {_VAR} AS variant, 'good' AS side, good_text AS text,
     CASE WHEN isfinite(good_total_nll) THEN good_total_nll END AS total_nll, good_token_count AS token_count, coalesce(swap_counts.g_swaps, 0) AS k_swaps FROM scores
  UNION ALL SELECT score_id, model, dataset, phenomenon, subtask, idx, {_VAR}, 'bad', bad_text,
     CASE WHEN isfinite(bad_total_nll) THEN bad_total_nll END, bad_token_count, coalesce(swap_counts.b_swaps, 0) FROM scores) WHERE length(text) > 0)"""
_CELL = lambda s, v: f"arg_max(total_nll, score_id) FILTER (side = '{s}' AND variant = '{v}' AND total_nll IS NOT NULL) AS {s}_{v}"
_WIDE = f"""wide AS (SELECT model, dataset, subtask, idx, {', '.join(_CELL(s, v) for s in ('good', 'bad') for v in ('freq', 'rare'))}
  FROM items WHERE idx IS NOT NULL GROUP BY ALL)"""
_DELTA = lambda lo, hi: f"""count(*) AS n_pairs, round(avg(({hi} - {lo} > 0)::INT) * 100, 6) AS pct_higher, round(avg({hi} - {lo}), 6) AS mean_delta, round(median({hi} - {lo}), 6) AS median_delta"""
_JOINED = f"""meta AS (SELECT dataset AS md, {_SUB('subtask')} AS ms, idx AS mi, arg_max(struct_pack(m := meta), (written_at, record_id)).m AS meta FROM records GROUP BY ALL),
joined AS (SELECT s.*, m.meta, {_REGIME} AS regime,
   m.meta.zipf_swapped_position_aggregates[regexp_replace(good_field, '_rare$', '_freq')].median AS good_zipf,
   m.meta.zipf_swapped_position_aggregates[regexp_replace(bad_field, '_rare$', '_freq')].median AS bad_zipf
   FROM scores s LEFT JOIN meta m ON s.dataset = m.md AND {_SUB('s.subtask')} = m.ms AND s.idx = m.mi)"""
_MID = "coalesce((good_zipf + bad_zipf) / 2, good_zipf, bad_zipf)"
_LATEST = """latest AS (SELECT * FROM (SELECT *, {r} AS regime FROM scores) WHERE regime IS NOT NULL),
best AS (SELECT DISTINCT model, regime, run_ts, dataset FROM latest),
first AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY model, regime ORDER BY run_ts DESC, dataset) = 1),
runs AS (SELECT l.* FROM latest l JOIN first f USING (model, regime, run_ts, dataset))""".replace("{r}", _REGIME)
_AGG = "meta.zipf_swapped_position_aggregates"


def _bins(x: str, y: str, by: str, q: int, least: int, source: str) -> str:
    b = f"{by}, " if by else ""
    ats = ", ".join(str(i / q) for i in range(q + 1))
    return f"""pts AS ({source}),
    edges AS (SELECT list_sort(list_distinct(quantile_cont({x}, [{ats}]))) AS e FROM pts WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
    el AS (SELECT unnest(e) AS v, generate_subscripts(e, 1) AS k FROM edges),
    b AS (SELECT p.*, (SELECT greatest(count(*) - 1, 0) FROM el WHERE el.v < p.{x}) AS bin FROM pts p WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
    printed AS (SELECT k, CASE WHEN k = 1 THEN round_even(round_even(v, 3) - 0.001, 3) ELSE round_even(v, 3) END AS v FROM el),
    mids AS (SELECT a.k - 1 AS bin, round((a.v + z.v) / 2, 6) AS mid FROM printed a JOIN printed z ON z.k = a.k + 1),
    binned AS (SELECT {b}bin, count(*) AS n, round(avg({y}), 6) AS mean, round(avg({x}), 6) AS mean_x FROM b GROUP BY {b}bin HAVING count(*) >= {least})"""


_HAS = lambda c: f"coalesce(length(trim({c})) > 0, false)"
_NF = lambda c: f"CASE WHEN trim({c}) = '' THEN NULL WHEN trim({c}) = 'syntax_semantics' THEN 'syntax/semantics' ELSE trim({c}) END"
_APPORTION = """tot AS (SELECT sum(n) AS al FROM counts),
ex AS (SELECT key, n, least({limit}, al) AS lim, least({limit}, al) * n / al AS e FROM counts, tot),
fl AS (SELECT *, floor(round(e, 9)) AS f FROM ex),
rk AS (SELECT *, row_number() OVER (ORDER BY round(e - f, 9) DESC, n DESC, key DESC) AS r, lim - sum(f) OVER () AS rest FROM fl),
quota AS (SELECT key, n, (f + (r <= rest)::INT)::BIGINT AS quota FROM rk)"""

ORACLES = {
    "a1_accuracy": f"WITH {_S}, {_acc('good_total_nll', 'bad_total_nll', '')} SELECT * FROM acc",
    "a1_accuracy_per_token": f"WITH {_S}, {_acc('good_total_nll / good_token_count', 'bad_total_nll / bad_token_count', 'AND good_token_count > 0 AND bad_token_count > 0')} SELECT * FROM acc",
    "a1_accuracy_per_char": f"WITH {_S}, {_acc('good_total_nll / length(good_text)', 'bad_total_nll / length(bad_text)', 'AND length(good_text) > 0 AND length(bad_text) > 0')} SELECT * FROM acc",
    "o1_report_order": f"""WITH {_S}, {_acc('good_total_nll', 'bad_total_nll', '')} SELECT *,
        row_number() OVER (PARTITION BY level ORDER BY accuracy DESC, total DESC, phenomenon NULLS FIRST, subtask NULLS FIRST) AS report_rank,
        row_number() OVER (PARTITION BY level ORDER BY total DESC, phenomenon NULLS FIRST, subtask NULLS FIRST) AS console_rank FROM acc""",
    "a27_run_summary": f"""WITH {_S}, v AS (SELECT * REPLACE ({_VAR} AS variant) FROM scores), {_acc('good_total_nll', 'bad_total_nll', '', 'model, dataset, variant', 'v')}
        SELECT model, dataset, variant, level, phenomenon, accuracy, correct, total FROM acc WHERE level IN ('overall', 'phenomenon')""",
    "w6_latest_run": f"""WITH {_S}, {_LATEST}, {_acc('good_total_nll', 'bad_total_nll', '', 'model, regime', 'runs')}
        SELECT model, regime, accuracy, correct, total FROM acc WHERE level = 'overall'""",
    "a13_mean_delta": f"""WITH {_S}, {_LATEST} SELECT model, regime, count(*) AS n, round(avg(bad_total_nll - good_total_nll), 6) AS mean_delta FROM runs
        WHERE isfinite(bad_total_nll - good_total_nll) GROUP BY ALL""",
    "a3_swap_counts": f"""WITH {_REC} SELECT coalesce(len(list_filter(meta.g_swaps, lambda s: s IS NOT NULL)), 0)::INT AS g_swaps,
        coalesce(len(list_filter(meta.b_swaps, lambda s: s IS NOT NULL)), 0)::INT AS b_swaps, count(*) AS n_records FROM records GROUP BY ALL""",
    "a4_variant_stats": f"""WITH {_S}, {_ITEMS} SELECT variant, side, count(*) AS n_items, round(avg(total_nll), 6) AS mean_total_nll, round(median(total_nll), 6) AS median_total_nll,
        round(avg(nll_per_char), 6) AS mean_nll_per_char, round(median(nll_per_char), 6) AS median_nll_per_char, round(avg(token_count), 6) AS mean_tokens FROM items GROUP BY ALL""",
    "a5_good_bad": f"""WITH {_S}, {_ITEMS}, w AS (SELECT score_id, variant, max(total_nll) FILTER (side = 'good') AS good, max(total_nll) FILTER (side = 'bad') AS bad FROM items GROUP BY ALL)
        SELECT variant, {_DELTA('good', 'bad')} FROM w WHERE good IS NOT NULL AND bad IS NOT NULL GROUP BY variant""",
    "a5_rare_typical": f"""WITH {_S}, {_ITEMS}, {_WIDE}, x AS (SELECT 'good' AS side, good_freq AS lo, good_rare AS hi FROM wide UNION ALL SELECT 'bad', bad_freq, bad_rare FROM wide)
        SELECT side, {_DELTA('lo', 'hi')} FROM x WHERE lo IS NOT NULL AND hi IS NOT NULL GROUP BY side""",
    "j7_wide": f"WITH {_S}, {_ITEMS}, {_WIDE} SELECT * FROM wide WHERE good_rare IS NOT NULL OR good_freq IS NOT NULL",
    "a6_subtask_gap": f"""WITH {_S}, {_ITEMS}, g AS (SELECT {_UNK('subtask')} AS subtask, avg(total_nll) FILTER (variant = 'freq') AS t, avg(total_nll) FILTER (variant = 'rare') AS r
        FROM items WHERE side = 'good' GROUP BY ALL)
        SELECT subtask, round(t, 6) AS typical_mean, round(r, 6) AS rare_mean, round(r - t, 6) AS delta FROM g WHERE t IS NOT NULL AND r IS NOT NULL ORDER BY delta DESC, subtask LIMIT 8""",
    "a7_swap_penalty": f"""WITH {_S} SELECT model, count(*) AS n_pairs, round(avg((bad_total_nll - good_total_nll) / swap_counts.g_swaps), 6) AS mean_per_swap,
        round(median((bad_total_nll - good_total_nll) / swap_counts.g_swaps), 6) AS median_per_swap FROM scores
        WHERE swap_counts.g_swaps > 0 AND isfinite(good_total_nll) AND isfinite(bad_total_nll) GROUP BY model""",
    "a8_zipf_rollup": f"""WITH {_REC}, e AS (SELECT unnest(map_keys({_AGG})) AS variant, unnest(map_values({_AGG})) AS a FROM records)
        SELECT variant, count(*) AS n_items, count(a.mean) AS n_with_iv, {', '.join(f'round({g}(a.{m}), 6) AS {n}_of_{m}_zipf' for m in ('mean', 'median', 'min') for n, g in (('mean', 'avg'), ('median', 'median')))},
        coalesce(sum(a.n), 0)::BIGINT AS total_iv_tokens, coalesce(sum(a.oov_count), 0)::BIGINT AS total_oov FROM e GROUP BY variant""",
    **{
        name: f"""WITH {_REC}, x AS ({' UNION ALL '.join(f"SELECT '{m}' AS metric, {_AGG}['{lo}'].{m} AS lo, {_AGG}['{hi}'].{m} AS hi FROM records" for m in ('mean', 'median', 'min'))})
        SELECT metric, {_DELTA('lo', 'hi')} FROM x WHERE lo IS NOT NULL AND hi IS NOT NULL GROUP BY metric"""
        for name, lo, hi in (("a8_rare_typical", "good_original", "good_freq"), ("a8_good_bad", "good_freq", "bad_freq"))
    },
    "a20_grammar_points": f"""WITH {_S}, {_ITEMS}, {_WIDE} SELECT model, dataset, subtask, idx, round(bad_freq - good_freq, 6) AS g_freq, round(bad_rare - good_rare, 6) AS g_rare,
        round(bad_rare - good_rare - (bad_freq - good_freq), 6) AS delta_g FROM wide WHERE good_freq IS NOT NULL AND bad_freq IS NOT NULL AND good_rare IS NOT NULL AND bad_rare IS NOT NULL""",
    "a23_apportion": f"WITH counts AS (SELECT {_SUB('subtask')} AS key, count(*) AS n FROM source_pair WHERE subtask IS NOT NULL GROUP BY ALL), {_APPORTION.format(limit=500)} SELECT * FROM quota",
    "w5_first_k": f"""WITH once AS (SELECT {_SUB('subtask')} AS key, idx, min(sentence_good) AS sentence_good FROM source_pair WHERE subtask IS NOT NULL GROUP BY ALL),
        counts AS (SELECT key, count(*) AS n FROM once GROUP BY key), {_APPORTION.format(limit=300)}
        SELECT o.* FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx NULLS FIRST) AS k FROM once) o JOIN quota q ON o.key = q.key AND o.k <= q.quota""".replace("SELECT o.* FROM (", "SELECT o.key, o.idx, o.sentence_good FROM ("),
    "a2_zipf_aggregates": f"""WITH {_REC}, sw AS (SELECT record_id, unnest(meta.g_swaps) AS s, 'good' AS side FROM records UNION ALL SELECT record_id, unnest(meta.b_swaps), 'bad' FROM records),
        w AS (SELECT record_id, side || '_original' AS role, s.old AS word FROM sw WHERE s IS NOT NULL UNION ALL SELECT record_id, side || '_freq', s.new FROM sw WHERE s IS NOT NULL),
        lex AS (SELECT lower(word) AS w, max(zipf) AS zipf FROM zipf_lexicon GROUP BY ALL),
        z AS (SELECT record_id, role, coalesce(zipf, 0.0) AS z FROM w LEFT JOIN lex ON lower(trim(w.word)) = lex.w WHERE w.word IS NOT NULL)
        SELECT record_id, role, count(*) FILTER (z > 0) AS n, count(*) FILTER (z <= 0) AS oov_count, round(avg(z) FILTER (z > 0), 6) AS mean,
        round(median(z) FILTER (z > 0), 6) AS median, min(z) FILTER (z > 0) AS min FROM z GROUP BY ALL""",
    "s15_lexicon": r"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}]+')) AS word FROM documents), c AS (SELECT word, count(*) AS n FROM w GROUP BY word)
        SELECT word, n, round(log10(1e9 * n / (SELECT sum(n) FROM c)), 2) AS zipf FROM c""",
    "j2_scores_with_meta": f"WITH {_S}, {_REC}, {_JOINED} SELECT score_id, regime, round(good_zipf, 6) AS good_zipf, round(bad_zipf, 6) AS bad_zipf, round({_MID}, 6) AS zipf_mid FROM joined",
    "a9_histogram": f"""WITH {_S}, {_REC}, {_JOINED}, m AS (SELECT regime, {_MID} AS z FROM joined WHERE regime IS NOT NULL AND {_MID} IS NOT NULL),
        e AS (SELECT regime, min(z) AS lo, max(z) AS hi, count(*) AS al FROM m GROUP BY regime),
        b AS (SELECT m.regime, CASE WHEN hi = lo THEN 0 ELSE least(floor((z - lo) * 20 / (hi - lo)), 19) END::INT AS bin, al, hi - lo AS span FROM m JOIN e USING (regime))
        SELECT regime, bin, count(*) AS n, round(count(*) * 20 / nullif(any_value(al * span), 0), 6) AS density FROM b GROUP BY ALL""",
    "a9_top_lemmas": f"""WITH {_S}, {_REC}, {_JOINED}, s AS (SELECT regime, unnest(meta.g_swaps) AS s FROM joined UNION ALL SELECT regime, unnest(meta.b_swaps) FROM joined),
        c AS (SELECT regime, s.lemma AS lemma, count(*) AS n FROM s WHERE s.lemma <> '' AND regime IS NOT NULL GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY n DESC, lemma) AS k FROM c)
        SELECT regime, sum(n)::BIGINT AS total, round(sum(n) FILTER (k <= 20) / sum(n), 6) AS top_share FROM r GROUP BY regime""",
    "a9_token_length": f"""WITH {_S}, {_REC}, {_JOINED} SELECT model, regime, round(avg(good_token_count), 6) AS good_avg, round(avg(bad_token_count), 6) AS bad_avg, count(*) AS n
        FROM joined WHERE regime IS NOT NULL AND good_token_count IS NOT NULL AND bad_token_count IS NOT NULL GROUP BY ALL""",
    "a9_imbalance": f"""WITH {_S}, {_REC}, {_JOINED} SELECT regime, round(avg(good_zipf - bad_zipf), 6) AS mean_diff, round(avg(abs(good_zipf - bad_zipf)), 6) AS mean_abs_diff, count(*) AS n
        FROM joined WHERE regime IS NOT NULL AND good_zipf IS NOT NULL AND bad_zipf IS NOT NULL GROUP BY ALL""",
    "a9_success": f"""WITH {_S}, {_REC}, {_JOINED} SELECT regime, count(*) AS n, round(1 - count(nullif(meta.swap_failed_reason, '')) / count(*), 6) AS success_rate FROM joined WHERE regime IS NOT NULL GROUP BY ALL""",
    "a9_reasons": f"""WITH {_S}, {_REC}, {_JOINED}, c AS (SELECT regime, meta.swap_failed_reason AS reason, count(*) AS n FROM joined WHERE regime IS NOT NULL AND meta.swap_failed_reason <> '' GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY regime ORDER BY n DESC, reason) AS rank FROM c QUALIFY rank <= 3""",
    "a14_length_stats": f"""WITH {_S}, {_REC}, {_JOINED} SELECT {_VAR} AS variant, dataset, regime, count(*) AS n,
        {', '.join(f'round({g}({c}), 6) AS {n}_{k}' for k, c in (('good_len', 'good_token_count'), ('bad_len', 'bad_token_count'), ('len_diff', 'good_token_count - bad_token_count'), ('zipf_diff', 'good_zipf - bad_zipf')) for n, g in (('mean', 'avg'), ('median', 'median')))}
        FROM joined WHERE regime IS NOT NULL AND good_token_count IS NOT NULL AND bad_token_count IS NOT NULL GROUP BY {_VAR}, dataset, regime""",
    "a10_zipf_bins": f"""WITH {_S}, {_REC}, {_JOINED}, {_bins('good_zipf', 'y', 'model', 20, 25, 'SELECT model, good_zipf, good_total_nll AS y FROM joined WHERE isfinite(good_total_nll)')}
        SELECT model, bin, n, mean, mid FROM binned JOIN mids USING (bin)""",
    "a18_merged_series": f"""WITH {_S}, {_REC}, {_JOINED}, {_bins('good_zipf', 'y', 'model', 20, 1, 'SELECT model, good_zipf, good_token_count::DOUBLE AS y FROM joined WHERE isfinite(good_total_nll) AND good_token_count > 0')},
        l AS (SELECT regexp_replace(model, '-instruct$', '') AS label, mid, mean, n FROM binned JOIN mids USING (bin))
        SELECT label, mid, round(sum(mean * n) / sum(n), 6) AS mean, sum(n)::BIGINT AS n FROM l GROUP BY ALL""",
    "a19_mean_curve": f"""WITH {_S}, {_REC}, {_JOINED}, {_bins('good_zipf', 'y', '', 10, 20, 'SELECT good_zipf, bad_total_nll - good_total_nll AS y FROM joined WHERE isfinite(good_total_nll) AND NOT isnan(bad_total_nll) AND bad_total_nll - good_total_nll < CAST(chr(105) || chr(110) || chr(102) AS DOUBLE)')}
        SELECT * FROM binned""",
    "a12_spearman": f"""WITH {_S}, {_REC}, {_JOINED}, r AS (SELECT model, good_zipf AS x, good_total_nll AS y FROM joined WHERE isfinite(good_total_nll) AND good_zipf IS NOT NULL AND NOT isnan(good_zipf)),
        k AS (SELECT model, rank() OVER (PARTITION BY model ORDER BY x) + (count(*) OVER (PARTITION BY model, x) - 1) / 2 AS rx,
                     rank() OVER (PARTITION BY model ORDER BY y) + (count(*) OVER (PARTITION BY model, y) - 1) / 2 AS ry FROM r)
        , c AS (SELECT model, count(*) AS n, CASE WHEN count(*) >= 3 THEN corr(rx, ry) END AS rho FROM k GROUP BY model),
        z AS (SELECT *, abs(atanh(greatest(-0.999999, least(0.999999, rho)))) * sqrt(greatest(n - 3, 0)) / sqrt(2) AS z FROM c), t AS (SELECT *, 1 / (1 + 0.5 * z) AS t FROM z)
        SELECT model, n, round(rho, 6) AS rho, round(CASE WHEN n >= 4 THEN t * exp(-z * z - 1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806
          + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277))))))))) END, 6) AS p FROM t""",
    "w4_average_rank": f"""WITH {_S} SELECT score_id, model, good_token_count, rank() OVER (PARTITION BY model ORDER BY good_token_count)
        + (count(*) OVER (PARTITION BY model, good_token_count) - 1) / 2 AS avg_rank FROM scores WHERE good_token_count IS NOT NULL""",
    "f18_regimes": f"SELECT DISTINCT dataset, zipf_lo, zipf_hi, {_REGIME.replace(_REGIME.splitlines()[0], 'CASE')} AS regime FROM pair_score WHERE NOT isnan(zipf_lo)",
    "o6_model_order": r"SELECT DISTINCT model, nullif(regexp_extract(model, '(?i)(\d+(?:\.\d+)?)b', 1), '')::DOUBLE AS size, regexp_replace(model, '-instruct$', '') AS label FROM pair_score",
    "op_p4_skipped": f"""WITH {_S} SELECT {_VAR} AS variant, count(*) FILTER (good_total_nll IS NOT NULL AND bad_total_nll IS NOT NULL) AS scored,
        count(*) FILTER (good_total_nll IS NULL OR bad_total_nll IS NULL) AS skipped FROM scores GROUP BY {_VAR}""",
    "op_p26_fields": f"WITH {_S} SELECT {_NF('field')} AS field, count(*) AS n FROM scores GROUP BY {_NF('field')}",
    "j1_field_map": f"""WITH {_REC}, f AS (SELECT {_SUB('subtask')} AS sub, min({_NF('field')}) AS mapped FROM source_pair WHERE {_NF('field')} IS NOT NULL GROUP BY {_SUB('subtask')})
        SELECT record_id, coalesce({_NF('field')}, mapped) AS field FROM records LEFT JOIN f ON {_SUB('subtask')} = f.sub""",
    "op_p25_collapsed": f"""WITH {_REC} SELECT record_id, CASE WHEN good_freq <> bad_freq THEN good_freq END AS good_freq, CASE WHEN good_freq <> bad_freq THEN bad_freq END AS bad_freq,
        CASE WHEN good_freq = bad_freq THEN 'pair_collapsed' ELSE meta.swap_failed_reason END AS reason FROM records
        WHERE good_freq = bad_freq OR meta.swap_failed_reason IS NOT NULL""",
    "op_p28_quality": rf"""WITH {_REC}, h AS (SELECT *, {_HAS('good_freq')} AND {_HAS('bad_freq')} AS both_there FROM records)
        SELECT count(*) AS records, count(*) FILTER (NOT both_there) AS missing, count(*) FILTER (both_there AND good_freq = bad_freq) AS same,
        count(*) FILTER (both_there AND regexp_matches(trim(good_freq), '[^.!?]$')) + count(*) FILTER (both_there AND regexp_matches(trim(bad_freq), '[^.!?]$')) AS no_end,
        count(*) FILTER (both_there AND regexp_matches(trim(good_freq), '\b\w+s''[0-9A-Za-rt-z_]')) + count(*) FILTER (both_there AND regexp_matches(trim(bad_freq), '\b\w+s''[0-9A-Za-rt-z_]')) AS merged FROM h""",
    "a26_issue_counts": f"""WITH {_REC}, c AS (SELECT {_UNK('phenomenon')} AS phenomenon, {_SUB('subtask')} AS subtask, count(*) AS n FROM records
        WHERE coalesce(trim(good_freq), '') = '' OR coalesce(trim(bad_freq), '') = '' GROUP BY {_UNK('phenomenon')}, {_SUB('subtask')})
        SELECT *, row_number() OVER (ORDER BY n DESC, phenomenon, subtask) AS rank FROM c QUALIFY rank <= 8""",
    "a28_reasons": f"""WITH {_REC}, e AS (SELECT record_id, unnest(list_distinct(string_split(meta.swap_failed_reason, '|'))) AS reason FROM records WHERE meta.swap_failed_reason <> '')
        SELECT reason, count(*) AS n FROM e GROUP BY reason""",
    "op_p7_merged_swaps": f"""WITH {_REC}, s AS (SELECT record_id, unnest(meta.g_swaps) AS s FROM records UNION ALL SELECT record_id, unnest(meta.b_swaps) FROM records)
        SELECT record_id, string_agg(concat_ws('/', s.i::VARCHAR, s.pos, s.old, s.new), ' ' ORDER BY s.i NULLS FIRST, s.pos NULLS FIRST, s.old, s.new, s.tag NULLS FIRST, s.lemma NULLS FIRST) AS swaps
        FROM s WHERE s.old IS NOT NULL AND s.new IS NOT NULL GROUP BY record_id""",
    "d2_task_list": f"SELECT grp, phenomenon, {_SUB('subtask')} AS subtask, min(ord) AS ord FROM task_config GROUP BY ALL",
    "op_p23_phenomenon": f"""WITH c AS (SELECT DISTINCT {_SUB('subtask')} AS s FROM task_config WHERE lower(grp) IN ('clitic_order', 'word_order') OR lower(phenomenon) IN ('clitic_order', 'word_order'))
        SELECT {_SUB('subtask')} AS subtask, count(*) AS n FROM source_pair WHERE {_SUB('subtask')} IN (SELECT s FROM c) GROUP BY {_SUB('subtask')}""",
    "s24_run_dims": r"""WITH f AS (SELECT DISTINCT file_name FROM raw_line) SELECT file_name, nullif(regexp_extract(file_name, '^(\d{8}-\d{6})_', 1), '') AS run_ts,
        nullif(regexp_extract(file_name, 'zw_(\d+p\d+_\d+p\d+)', 1), '') AS zipf_window,
        replace(nullif(regexp_extract(file_name, 'zw_(\d+p\d+)_\d+p\d+', 1), ''), 'p', '.')::DOUBLE AS zipf_lo,
        replace(nullif(regexp_extract(file_name, 'zw_\d+p\d+_(\d+p\d+)', 1), ''), 'p', '.')::DOUBLE AS zipf_hi FROM f""",
}
