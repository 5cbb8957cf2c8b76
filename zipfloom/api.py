"""One call per job: generate, score, judge, report, mine, keep an inventory.

Functions take and give DataFrames; nothing runs before a result is asked for,
apart from counts that a plan depends on.  ``out`` parameters write as well.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .operators import collocations as C
from .operators import parsing as P
from .operators import reports as R
from .operators import scoring as K
from .operators import swaps as S
from .operators.lexicon import Lexicon
from .runtime import materialise
from .sources import documents, jsonl

#: Upper frequency bound where none is given.
DEFAULT_HIGH = 3.4
STAGES = ("verb", "noun", "adj")


# ---- generation ------------------------------------------------------------------------


@dataclass
class Window:
    """A frequency window, with bounds per stage where they differ: a stage's own go before the common ones."""

    low: float | None = None
    high: float | None = None
    lows: dict[str, float] = field(default_factory=dict)
    highs: dict[str, float] = field(default_factory=dict)

    def bounds(self, stage: str) -> tuple[float | None, float]:
        high = self.highs.get(stage, self.high)
        return self.lows.get(stage, self.low), DEFAULT_HIGH if high is None else high

    @property
    def name(self) -> str:
        print_ = lambda x: f"{x:.1f}".replace(".", "p")
        low, high = self.bounds("")
        return f"zw_{print_(low)}_{print_(high)}" if low is not None else f"zipf_{print_(high)}"


def windows(values: list[float] | None = None, ranges: list[str] | None = None) -> list[Window]:
    """Single values as upper bounds, ``LOW-HIGH`` ranges; one default window where neither is given."""
    got = [Window(high=v) for v in values or []] + [Window(*T.parse_window(r)) for r in ranges or []]
    return got or [Window()]


def windowed_pool(pool: DataFrame, lexicon: DataFrame, window: Window, relax: bool = False) -> DataFrame:
    """``pool, lemma`` of the lemmas within their stage's window.

    A pool's stage is its name up to the colon; lists of control and raising
    subtasks stay whole.  ``relax`` raises a pool's upper bound step by step
    where too few lemmas are left.
    """
    zipf = lexicon.groupBy(F.lower("word").alias("lemma")).agg(F.max("zipf").alias("zipf"))
    known = pool.join(zipf, "lemma", "left").withColumn("zipf", F.coalesce("zipf", F.lit(0.0)))
    fixed = set(S.CONTROL_POOLS)
    stage = F.element_at(F.split("pool", ":"), 1)
    ok = F.col("pool").isin(list(fixed))
    for s in STAGES:
        ok = ok | ((stage == s) & ~F.col("pool").isin(list(fixed)) & T.in_window("zipf", *window.bounds(s)))
    got = known.where(ok)
    if relax:
        parts = [got.where(F.col("pool").isin(list(fixed)))]
        for s in STAGES:
            low, high = window.bounds(s)
            parts.append(C.relaxed_window(known.where((stage == s) & ~F.col("pool").isin(list(fixed))), "zipf", low, high)[0].select(got.columns))
        got = parts[0]
        for p in parts[1:]:
            got = got.unionByName(p)
    return got.select("pool", "lemma").distinct()


def generate(
    pairs: DataFrame, pool: DataFrame, lexicon: DataFrame, *, over: list[Window] | None = None, parser: Callable[[], P.Parser] = P.RuleParser,
    tags: Lexicon | None = None, swap_target: str | list[str] = "all", phenomena: list[str] | None = None, seed: int = 0, limit: int | None = None,
    match_token_count: bool = False, tokenizer: Callable[[str], list] | None = None, forms: DataFrame | None = None, relax: bool = False,
    dry_run: bool = False, out: str | None = None, timestamp: str | None = None, overwrite: bool = False,
) -> dict[str, DataFrame] | DataFrame:
    """Datasets by name, one per window: the pairs with words of the window.

    ``pairs``: subtask, idx, phenomenon, sentence_good, sentence_bad; ``pool``:
    pool, lemma before any window; ``lexicon``: word, zipf.  ``limit`` is pairs
    per subtask, in order of idx.  ``match_token_count`` keeps forms of as many
    tokens as the old word.  ``dry_run`` gives the plan instead: each dataset
    with its pools' sizes.  ``out`` writes ``<out>/<timestamp>_<name>`` and the
    originals beside, unless they are there.
    """
    from .functions.inflection import token_count

    over = over or windows()
    if phenomena:
        names = [p.lower() for p in phenomena]
        pairs = pairs.where(F.lower("phenomenon").isin(names))
    if limit is not None:
        first = pairs.groupBy("subtask").agg(F.lit(limit).alias("quota")).withColumnRenamed("subtask", "key")
        pairs = R.first_k(pairs, first, "subtask", ["idx"])
    pools = {w.name: windowed_pool(pool, lexicon, w, relax) for w in over}
    if dry_run:
        sizes = [p.groupBy("pool").agg(F.count("*").alias("n_lemmas")).withColumn("dataset", F.lit(n)) for n, p in pools.items()]
        plan = sizes[0]
        for s in sizes[1:]:
            plan = plan.unionByName(s)
        return plan.select("dataset", "pool", "n_lemmas")
    fits = (lambda old, new: token_count(old, tokenizer) == token_count(new, tokenizer)) if match_token_count else None
    stages = tuple(s for s in STAGES if s in S.normal_targets(swap_target))
    got = {}
    for name, p in pools.items():
        made = S.generate(pairs, p, parser, seed=seed, stages=stages, fits=fits, forms=forms, lexicon=tags)
        records = S.as_records(materialise(made, "generated"), lexicon).withColumn("dataset", F.lit(name))
        full = f"{timestamp}_{name}" if timestamp else name
        got[full] = records
        if out:
            generated, originals = jsonl.split_outputs(records)
            mode = "overwrite" if overwrite else "errorifexists"
            jsonl.write_jsonl(generated, f"{out}/{full}.jsonl", mode)
            jsonl.write_jsonl(originals, f"{out}/original.jsonl", "overwrite" if overwrite else "ignore")
    return got


# ---- scoring and judging ------------------------------------------------------------------


def score(
    records: DataFrame, models: dict[str, Callable[[DataFrame], DataFrame]], *, variant: str = "auto", good_field: str | None = None, bad_field: str | None = None,
    limit: int | None = None, dataset: str | None = None, run_ts: str | None = None, out: str | None = None,
) -> DataFrame:
    """Both sides' likelihoods of every pair, per model and variant.

    ``models``: name -> scorer of a ``text`` table (:func:`K.score_texts` with a
    factory, or a plan).  ``variant``: auto (swapped texts, else the originals),
    original, freq or both; fields may be given instead.  Distinct texts are
    scored once per model.
    """
    parts = []
    rows = records if limit is None else records.orderBy("subtask", "idx").limit(limit)
    for v in R.scorable_variant(rows, variant) if not (good_field and bad_field) else [variant]:
        good = good_field or R.pick_field(rows, R.GOOD_TEXT[v])
        bad = bad_field or R.pick_field(rows, R.BAD_TEXT[v])
        if good is None or bad is None:
            continue
        keep = [c for c in ("idx", "phenomenon", "subtask", "field", "dataset") if c in rows.columns]
        own = rows.select(*keep, F.col(good).alias("good_text"), F.col(bad).alias("bad_text"))
        for name, scorer in models.items():
            done = K.score_pairs(own, scorer, "good_text", "bad_text")
            parts.append(done.withColumns({"variant": F.lit(v), "good_field": F.lit(good), "bad_field": F.lit(bad), "model": F.lit(name), "run_ts": F.lit(run_ts)}))
    if not parts:
        raise ValueError("no pair of columns holds texts to score")
    got = parts[0]
    for p in parts[1:]:
        got = got.unionByName(p, allowMissingColumns=True)
    if dataset is not None:
        got = got.withColumn("dataset", F.lit(dataset))
    if out:
        jsonl.write_jsonl(got, out)
    return got


def accuracy(scores: DataFrame, *, normalize_by: str = "none", dims: list[str] | None = None, limit: int | None = None, output: str | None = None) -> DataFrame:
    """Accuracy overall, per phenomenon, subtask and both, in the report's order."""
    rows = scores if limit is None else scores.limit(limit)
    got = R.report_order(R.accuracy(rows, normalize_by, dims))
    if output:
        documents.write_document(documents.report_document(got), output)
    return got


def evaluate(
    datasets: dict[str, DataFrame], models: dict[str, Callable[[DataFrame], DataFrame]], *, normalize_by: str = "none", dataset_contains: str | None = None,
    variant: str = "auto", run_ts: str | None = None, out: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Score every dataset with every model and judge: (scores, accuracy per model, dataset and variant)."""
    chosen = {n: d for n, d in datasets.items() if not dataset_contains or dataset_contains in n}
    parts = [score(d, models, variant=variant, dataset=n, run_ts=run_ts) for n, d in chosen.items()]
    if not parts:
        raise ValueError("no dataset to evaluate")
    scores = parts[0]
    for p in parts[1:]:
        scores = scores.unionByName(p, allowMissingColumns=True)
    scores = materialise(scores, "scores")
    acc = R.accuracy(scores, normalize_by, ["model", "dataset", "variant"])
    if out:
        jsonl.write_jsonl(scores, f"{out}/pair-scores.jsonl", "overwrite")
        jsonl.write_jsonl(acc, f"{out}/accuracy.jsonl", "overwrite")
        documents.write_document({"run_ts": run_ts, "models": sorted(models), "datasets": sorted(chosen), "normalize_by": normalize_by}, f"{out}/manifest.json")
    return scores, acc


# ---- reports --------------------------------------------------------------------------------


def zipf_trend(
    scores: DataFrame, records: DataFrame, *, of: str = "nll", normalize: str = "none", variant: str | None = None, dataset_contains: str | None = None,
    window_only: bool = False, quantile_bins: int = 20, min_bin_n: int = 25,
) -> DataFrame:
    """Likelihood (``of='nll'``) or token length (``of='length'``) by frequency bin and model: the plotted series."""
    rows = R.with_zipf(R.attach_meta(R.report_filter(scores, dataset_contains, window_only, variant), records))
    y = {"nll": {"none": F.col("good_total_nll"), "char": F.col("good_total_nll") / F.nullif(F.length("good_text"), F.lit(0)),
                 "token": F.col("good_total_nll") / F.nullif(F.col("good_token_count"), F.lit(0))}[normalize],
         "length": F.col("good_token_count").cast("double")}[of]
    kept = materialise(rows.select("model", "good_zipf", y.alias("y")).where("good_zipf is not null and y is not null and not isnan(y)"), "trend")
    return R.binned(kept, "good_zipf", "y", ["model"], quantile_bins, min_bin_n)


def regime_diagnostics(scores: DataFrame, records: DataFrame, *, dataset_contains: str | None = None, bins: int = 20) -> dict[str, DataFrame]:
    """The tables behind the regime plots: frequencies, token lengths and swap success per regime."""
    rows = R.with_zipf(R.attach_meta(R.report_filter(scores, dataset_contains), records))
    rows = materialise(rows.withColumn("regime", T.regime("zipf_lo", "zipf_hi")), "regimes")
    return {"frequency": R.regime_histogram(rows, bins), "length": R.length_stats(rows, ["regime"])}


# ---- mining and inventory -----------------------------------------------------------------------


def mine_clause_markers(tokens: DataFrame, *, window: int = 2, min_doc: int = 25, wh: tuple[str, ...] = ("what", "who"), focus: list[str] | None = None) -> DataFrame:
    """Rates of clause markers per verb."""
    return C.marker_rates(C.clause_markers(tokens, window, wh, focus), C.verb_counts(tokens), wh, min_doc)


def clause_whitelists(rates: DataFrame, blocked: list[str] | None = None, **thresholds) -> DataFrame:
    """Verbs by the clauses they embed."""
    return C.clause_lists(rates, blocked or [], **thresholds)


def mine_prepositions(tokens: DataFrame, frames: DataFrame, *, min_doc: int = 5, missing_min_doc: int = 10) -> dict[str, DataFrame]:
    """The inventory's prepositional frames against a corpus: what it attests, and what the inventory lacks."""
    counts = C.verb_prepositions(tokens)
    return {"attested": C.attestation(frames, counts, min_doc), "missing": C.missing_frames(frames, counts, missing_min_doc)}


def build_inventory(*parts: DataFrame, min_verb_share: float | None = None, senses: DataFrame | None = None) -> DataFrame:
    """One inventory out of several sources of ``lemma, kind, prep, particle``, each frame once.

    With senses, verbs that are rarely verbs drop out.
    """
    got = parts[0].select("lemma", "kind", "prep", "particle")
    for p in parts[1:]:
        got = got.unionByName(p.select("lemma", "kind", "prep", "particle"))
    got = got.withColumn("lemma", F.lower(F.trim("lemma"))).where("lemma <> '' and kind is not null").distinct()
    if min_verb_share is not None and senses is not None:
        got = got.join(C.verb_choices(senses, min_verb_share).select("lemma"), "lemma", "left_semi")
    return got


def augment_inventory(frames: DataFrame, counts: DataFrame, kind: str, *, min_doc: int = 25, create: bool = False) -> DataFrame:
    """Add frames that a corpus attests in at least so many documents: ``counts`` has verb, doc_count and prep or particle."""
    item = "particle" if "particle" in counts.columns else "prep"
    seen = counts.where(F.col("doc_count") >= min_doc).select(F.col("verb").alias("lemma"), F.lit(kind).alias("kind"), F.col(item))
    rest = ({"prep", "particle"} - {item}).pop()
    more = seen.withColumn(rest, F.lit(None).cast("string")).select("lemma", "kind", "prep", "particle").distinct()
    return C.augment(frames, more, create)


def prune_inventory(frames: DataFrame, drop: DataFrame) -> DataFrame:
    """The inventory without the listed frames; a lemma without frames is gone."""
    return C.prune(frames, drop)


def quality_check(records: DataFrame, models: dict[str, Callable[[DataFrame], DataFrame]], *, limit: int, strategy: str = "head") -> DataFrame:
    """Scores of a bounded sample: the first records, or as many of each subtask as its share."""
    if strategy == "head":
        rows = records.orderBy("subtask", "idx").limit(limit)
    else:
        counts = records.groupBy(F.col("subtask").alias("key")).agg(F.count("*").alias("n"))
        rows = R.first_k(records, R.apportion(counts, limit), "subtask", ["idx"])
    return score(rows, models)
