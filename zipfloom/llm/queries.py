"""Queries of the training-data operators and the SQL that some must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, latest, materialise, same_name, same_name_sql, table
from . import balanced, encoding, language, mixing, percentiles, terms

# ---- 3: sample matching target proportions ----------------------------------


def _sample(spark: SparkSession, d: str) -> balanced.Drawn:
    config = table(spark, d, "task_config").select(same_name("subtask").alias("_sub"), "phenomenon")
    config = config.where("_sub is not null").groupBy("_sub").agg(F.min("phenomenon").alias("_phen"))
    rows = table(spark, d, "generated_pair").select(
        "record_id", same_name("subtask").alias("_sub"), "dataset", "written_at",
        (F.col("good_freq").isNotNull() & F.col("bad_freq").isNotNull()).alias("_whole"),
    )
    recs = latest(rows, "record_id", ["written_at"], ["_sub", "dataset", "_whole"]).where("_whole and record_id is not null")
    # read by the counts and by the flight
    known = materialise(recs.join(broadcast_if_small(config), "_sub").select("record_id", "_sub", "_phen", "dataset"), "units")
    plans = F.array(
        F.struct(F.lit("by_subtask").alias("plan_name"), F.col("_sub").alias("category")),
        F.struct(F.lit("by_phenomenon").alias("plan_name"), F.col("_phen").alias("category")),
    )
    units = known.select(F.col("record_id").alias("unit"), F.col("_phen").alias("phenomenon"), "dataset", F.explode(plans).alias("x"))
    units = units.select("x.*", "phenomenon", "dataset", "unit")
    key = F.when(F.col("plan_name") == "by_subtask", same_name("category")).otherwise(F.col("category"))
    targets = table(spark, d, "sample_target").withColumn("_given", F.col("category")).withColumn("category", key)
    drawn = balanced.cube_sample(units, targets, balance=("phenomenon", "dataset"))
    given = targets.select("plan_name", "category", "_given").distinct()
    report = drawn.report.join(broadcast_if_small(given), ["plan_name", "category"])
    return drawn._replace(report=report.withColumn("category", F.col("_given")).drop("_given"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Targets that the drawn sample misses though every record of the category is in it."""
    return _sample(spark, d).report.where("reason = 'short'").select("plan_name", "category")


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    """The sample of every plan, balanced on category, phenomenon and dataset."""
    return _sample(spark, d).sample.withColumnRenamed("unit", "record_id")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Target, expected and drawn rows of every category, the imbalance and why a target is missed."""
    return _sample(spark, d).report


def p3_balance(spark: SparkSession, d: str) -> DataFrame:
    """Residual imbalance of every balancing column and value."""
    return _sample(spark, d).balance


def p3_targets(spark: SparkSession, d: str) -> DataFrame:
    """The report without the drawn number, which chance rounds: is it within a row of the expected one?"""
    got = _sample(spark, d).report.withColumn("within_a_row", F.abs("imbalance") < 1)
    return got.select(
        "plan_name", "category", "available", *[F.round(c, 4).alias(c) for c in ("wanted", "expected")], "within_a_row",
        F.when(F.col("reason") == "short", "short").when(F.col("wanted") - F.col("expected") >= 1, "displaced").otherwise("").alias("reason"),
    )


# ---- 5: frequency of every term ----------------------------------------------


def _terms(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<struct<old:string,new:string>>")
    part = lambda c: F.coalesce(F.transform(F.col(c), lambda s: F.struct(s["old"].alias("old"), s["new"].alias("new"))), none)
    both = F.concat(part("meta.g_swaps"), part("meta.b_swaps"))
    words = F.flatten(F.transform(both, lambda s: F.array(s["old"], s["new"])))
    clean = F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"^\s+|\s+$", "")))
    rows = table(spark, d, "generated_pair").select(
        "record_id", "written_at", F.filter(clean, lambda w: w.isNotNull() & (w != "")).alias("terms")
    )
    return latest(rows, "record_id", ["written_at"], ["terms"])


def p5_terms(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and records of every term, rare and common ones marked."""
    recs = materialise(_terms(spark, d), "terms")  # read by the summary, the counts and the total
    total = recs.where(F.size("terms") > 0).agg(F.count("*"))
    counts = terms.term_frequencies(recs, "terms")
    return counts.select("term", "n_occurrences", "n_records", terms.mark("n_records", total.scalar()).alias("mark"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms that are too rare or too common."""
    return p5_terms(spark, d).where("mark is not null").select("term", "mark")


# ---- 6: percentiles ------------------------------------------------------------

QUANTILES = [0.5, 0.9, 0.99]
METRICS = ["good_total_nll", "bad_total_nll"]


def _phenomenon() -> F.Column:
    name = F.regexp_replace(same_name("phenomenon"), r"\s+", "_")
    return F.when(name.isNull() | (name == ""), F.lit("unknown")).otherwise(name)


def _score_keys(spark: SparkSession, d: str) -> DataFrame:
    """Each score once (its earliest arrival), with the values' ordered integers; rows without a time never arrived."""
    arrived = table(spark, d, "pair_score").where("ingested_at is not null")
    rows = arrived.select("score_id", "ingested_at", _phenomenon().alias("phenomenon"), *METRICS)
    keys = percentiles.radix_keys(rows, ["score_id", "ingested_at", "phenomenon"], METRICS)
    first = keys.groupBy("score_id").agg(
        F.min(F.struct("ingested_at", "phenomenon", "_v0", "_v1")).alias("x")
    )
    return first.select("x.phenomenon", F.to_date("x.ingested_at").alias("day"), "x._v0", "x._v1")


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact median, 90th and 99th percentile per phenomenon and metric."""
    keys = materialise(percentiles.long_form(_score_keys(spark, d), ["phenomenon"], METRICS), "radix-keys")
    return percentiles.radix_percentiles(keys, ["phenomenon", "metric"], QUANTILES)


def _days(spark: SparkSession, d: str) -> DataFrame:
    keys = percentiles.long_form(_score_keys(spark, d), ["phenomenon", "day"], METRICS)
    return percentiles.radix_histogram(keys, ["phenomenon", "metric", "day"])


def p6_days(spark: SparkSession, d: str) -> DataFrame:
    """The mergeable histogram of every day of arrival."""
    return _days(spark, d)


def p6_merged(spark: SparkSession, d: str) -> DataFrame:
    """The percentiles again, put together from the days' histograms."""
    got = percentiles.histogram_percentiles(_days(spark, d).drop("day"), ["phenomenon", "metric"], QUANTILES)
    return got.withColumn("max_relative_error", F.lit(percentiles.SKETCH_ERROR))


def p6_kept(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles against those put together from days: is the stated error kept?"""
    exact, merged = p6_percentiles(spark, d), p6_merged(spark, d)
    m = merged.select("phenomenon", "metric", "q", F.col("n_values").alias("n_merged"), F.col("value").alias("m"), "max_relative_error")
    off = F.abs(F.col("m") - F.col("value")) <= F.col("max_relative_error") * F.abs("value")
    return exact.join(m, ["phenomenon", "metric", "q"], "left").select("phenomenon", "metric", "q", "n_merged", off.alias("within_error"))


# ---- 7: encoding ------------------------------------------------------------------


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encoding.encode_texts(table(spark, d, "documents"), ["doc_id"])


# ---- 8: mixing --------------------------------------------------------------------


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = materialise(encoding.count_tokens(table(spark, d, "documents"), ["doc_id", "source"]), "tokens")
    return mixing.mix_sources(sized, table(spark, d, "source_weight"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """Copies of every document in the mix."""
    return _mix(spark, d)[0]


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source."""
    return _mix(spark, d)[1]


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    """Per source: is its goal reached to within a document, and no document repeated beyond its cap?"""
    mix, report = _mix(spark, d)
    most = mix.groupBy("source").agg(F.max("n_tokens").alias("_most"))
    off = F.abs(F.col("taken_tokens") - F.col("goal_tokens"))
    return report.join(most, "source", "left").select(
        "source", F.round("target_share", 6).alias("target_share"), "docs",
        (off <= F.coalesce("_most", F.lit(0))).alias("within_a_document"), (F.col("most_copies") <= F.col("max_repeat")).alias("within_repeats"),
    )


# ---- 9: languages -----------------------------------------------------------------


_MODELS: dict[tuple[str, str], language.Model | None] = {}


def _named(spark: SparkSession, d: str, every: bool = True) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    key = spark.sparkContext.applicationId, d
    if key not in _MODELS:  # fitted once an application; of fixed size
        _MODELS.clear()
        _MODELS[key] = language.train(docs)
    return language.name_languages(docs, _MODELS[key], every)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose label is missing, wrong or not all, with their languages."""
    return language.label_cases(_named(spark, d, every=False))


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    """Language, confidence and the label's status of every document."""
    got = _named(spark, d)
    return got.select("doc_id", "label", "label_lang", "lang", "guess", F.round("confidence", 6).alias("confidence"), "status")


def p9_stretches(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch in one language with its confidence."""
    got = _named(spark, d).select("doc_id", F.posexplode("stretches").alias("n", "s"))
    return got.select("doc_id", "n", "s.start", "s.end", "s.lang", "s.guess", F.round("s.confidence", 6).alias("confidence"))


QUERIES = {
    f.__name__: f
    for f in (
        p3_found, p3_sample, p3_report, p3_balance, p3_targets, p5_found, p5_terms, p6_percentiles, p6_days, p6_merged, p6_kept,
        p7_ids, p8_mix, p8_report, p8_kept, p9_found, p9_documents, p9_stretches,
    )
}

_SUB = same_name_sql
_LATEST_PAIRS = """
  SELECT record_id, arg_max(subtask, written_at) AS subtask,
         arg_max(coalesce(good_freq IS NOT NULL AND bad_freq IS NOT NULL, false), written_at) AS whole
  FROM generated_pair GROUP BY record_id"""
_PHEN = f"""coalesce(nullif(regexp_replace({_SUB('phenomenon')}, '\\s+', '_', 'g'), ''), 'unknown')"""
_TERMS = r"""
WITH latest AS (SELECT record_id, arg_max(struct_pack(g := meta.g_swaps, b := meta.b_swaps), written_at) AS m FROM generated_pair GROUP BY record_id),
swaps AS (SELECT record_id, unnest(m.g) AS s FROM latest UNION ALL SELECT record_id, unnest(m.b) FROM latest),
words AS (SELECT record_id, lower(regexp_replace(w, '^\s+|\s+$', '', 'g')) AS term
          FROM (SELECT record_id, s.old AS w FROM swaps UNION ALL SELECT record_id, s.new FROM swaps)),
kept AS (SELECT * FROM words WHERE term <> ''),
counts AS (SELECT term, count(*) AS n_occurrences, count(DISTINCT record_id) AS n_records FROM kept GROUP BY term),
marked AS (SELECT *, CASE WHEN n_records < 3 THEN 'rare'
                          WHEN n_records > (SELECT count(DISTINCT record_id) FROM kept) / 50.0 THEN 'common' END AS mark FROM counts)
"""

_RANKED = f"""
WITH once AS (SELECT score_id, arg_min({_PHEN}, ingested_at) AS phenomenon, arg_min(struct_pack(v := good_total_nll), ingested_at).v AS g,
                     arg_min(struct_pack(v := bad_total_nll), ingested_at).v AS b FROM pair_score GROUP BY score_id),
vals AS (SELECT phenomenon, 'good_total_nll' AS metric, g AS v FROM once UNION ALL SELECT phenomenon, 'bad_total_nll', b FROM once),
ranked AS (SELECT *, row_number() OVER (PARTITION BY phenomenon, metric ORDER BY v) AS r, count(*) OVER (PARTITION BY phenomenon, metric) AS n_values
           FROM vals WHERE isfinite(v))"""
_TARGETS = f"""
WITH RECURSIVE latest AS ({_LATEST_PAIRS}),
config AS (SELECT DISTINCT {_SUB('subtask')} AS sub, phenomenon FROM task_config),
recs AS (SELECT c.sub, c.phenomenon FROM latest l JOIN config c ON {_SUB('l.subtask')} = c.sub WHERE l.whole),
n AS (SELECT 'by_subtask' AS plan_name, sub AS cat, count(*) AS n FROM recs GROUP BY sub
      UNION ALL SELECT 'by_phenomenon', phenomenon, count(*) FROM recs GROUP BY phenomenon),
goal AS (SELECT DISTINCT t.plan_name, t.category, t.target_share, t.min_rows, t.sample_size, coalesce(n.n, 0) AS available FROM sample_target t LEFT JOIN n
  ON n.plan_name = t.plan_name AND n.cat = CASE WHEN t.plan_name = 'by_subtask' THEN {_SUB('t.category')} ELSE t.category END)
"""

ORACLES = {
    "p3_found": _TARGETS
    + """SELECT DISTINCT plan_name, category FROM goal WHERE available < min_rows OR available < target_share * sample_size""",
    "p3_targets": _TARGETS
    + """,
bound AS (SELECT *, CASE WHEN target_share * sample_size > available THEN available ELSE least(min_rows, available) END AS low FROM goal),
plan AS (SELECT plan_name, least(max(sample_size), sum(available)) AS want, sum(low) AS lows FROM bound GROUP BY plan_name),
-- the scale at which the shares within their bounds sum to the size, by halving
scale(plan_name, n, lo, hi) AS (
  SELECT plan_name, 0, 0.0::DOUBLE, 1024.0::DOUBLE FROM plan
  UNION ALL
  SELECT s.plan_name, n + 1, CASE WHEN t.total < p.want THEN (lo + hi) / 2 ELSE lo END, CASE WHEN t.total < p.want THEN hi ELSE (lo + hi) / 2 END
  FROM scale s JOIN plan p USING (plan_name), LATERAL (
    SELECT sum(least(greatest((lo + hi) / 2 * b.target_share * b.sample_size, b.low), b.available)) AS total FROM bound b WHERE b.plan_name = s.plan_name) t
  WHERE n < 80),
done AS (SELECT plan_name, hi FROM scale WHERE n = 80),
planned AS (SELECT b.*, greatest(b.target_share * b.sample_size, b.min_rows) AS wanted,
         CASE WHEN p.lows >= p.want THEN b.low ELSE least(greatest(d.hi * b.target_share * b.sample_size, b.low), b.available) END AS expected
       FROM bound b JOIN plan p USING (plan_name) JOIN done d USING (plan_name))
SELECT plan_name, category, available, round(wanted, 4) AS wanted, round(expected, 4) AS expected, true AS within_a_row,
       CASE WHEN available < wanted THEN 'short' WHEN wanted - expected >= 1 THEN 'displaced' ELSE '' END AS reason FROM planned""",
    "p8_kept": """
WITH w AS (SELECT source, max(weight) AS weight FROM source_weight WHERE source IS NOT NULL GROUP BY source),
n AS (SELECT source, count(DISTINCT doc_id) AS docs FROM documents WHERE text <> '' GROUP BY source)
SELECT w.source, round(w.weight / sum(w.weight) OVER (), 6) AS target_share, coalesce(n.docs, 0) AS docs, true AS within_a_document, true AS within_repeats
FROM w LEFT JOIN n USING (source)""",
    "p5_terms": _TERMS + "SELECT * FROM marked",
    "p5_found": _TERMS + "SELECT term, mark FROM marked WHERE mark IS NOT NULL",
    "p6_percentiles": _RANKED + """
SELECT phenomenon, metric, q.q, n_values, v AS value FROM ranked, (VALUES (0.5::DOUBLE), (0.9), (0.99)) q(q)
WHERE r = greatest(ceil(round(q.q * n_values, 6)), 1)""",
    "p6_kept": _RANKED + """
SELECT DISTINCT phenomenon, metric, q.q, n_values AS n_merged, true AS within_error FROM ranked, (VALUES (0.5::DOUBLE), (0.9), (0.99)) q(q)""",
}
