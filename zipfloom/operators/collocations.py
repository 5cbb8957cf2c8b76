"""Ordered scans over a tagged token stream: collocations, sentences, verb lists.

A token has ``file, line_no, doc_id, surface, lemma, pos``; ``line_no`` is any type
that orders a file's tokens.  A document run is a
stretch of one doc_id within a file; a doc_id that comes back later is a new
run and counts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Tag prefixes of lexical verbs, and the prepositions that verbs select.
VERB_PREFIXES = ["vv", "vd", "vh", "vb"]
PREPOSITIONS = (
    "about across after against along around at before behind by down for from in into near of off on onto over "
    "through to toward under up with"
).split()

#: Lines of a file that one window group holds while runs are numbered.
LINES_PER_CHUNK = 500_000


def document_runs(tokens: DataFrame, lines_per_chunk: int = LINES_PER_CHUNK) -> DataFrame:
    """Adds ``run``, the number of the token's document run within its file.

    Files are cut into chunks of lines, so a file that holds a third of all
    tokens isn't one window group: changes are summed within a chunk, and the
    chunks' sums and last ids, which are few, carry over.  Tokens may bring the
    numbers of their chunks as ``chunk``, which never falls along line_no, or
    their ``run``, where a source knows it; those are left as they are.
    """
    if "run" in tokens.columns:
        return tokens
    chunk = F.col("chunk") if "chunk" in tokens.columns else F.floor(F.col("line_no") / lines_per_chunk)
    t = tokens.withColumn("_chunk", chunk)
    inside = Window.partitionBy("file", "_chunk").orderBy("line_no")
    t = t.withColumn("_prev", F.lag("doc_id").over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    changed = (~F.col("_first") & ~F.col("doc_id").eqNullSafe(F.col("_prev"))).cast("bigint")
    t = t.withColumn("_local", F.sum(changed).over(inside))
    ends = t.groupBy("file", "_chunk").agg(
        F.max("_local").alias("_changes"), F.min_by("doc_id", "line_no").alias("_head"), F.max_by("doc_id", "line_no").alias("_tail")
    )
    across = Window.partitionBy("file").orderBy("_chunk")
    new = (F.row_number().over(across) > 1) & ~F.col("_head").eqNullSafe(F.lag("_tail").over(across))
    carried = (
        ends.withColumn("_new", F.coalesce(new.cast("bigint"), F.lit(0)))
        .withColumn("_base", F.sum(F.col("_new") + F.col("_changes")).over(across) - F.col("_changes"))
        .select("file", "_chunk", "_base")
    )
    got = t.join(carried, ["file", "_chunk"])
    return got.withColumn("run", F.col("_local") + F.col("_base")).drop("_chunk", "_prev", "_first", "_local", "_base")


def breaks(lemma: Column, pos: Column) -> Column:
    """Markup, punctuation and empty lemmas end a collocation."""
    return lemma.isNull() | (lemma == "") | lemma.startswith("@@") | lemma.startswith("<") | F.coalesce(pos.startswith("y"), F.lit(False))


def is_verb(pos: Column) -> Column:
    return F.coalesce(F.substring(pos, 1, 2).isin(VERB_PREFIXES), F.lit(False))


def _cleaned(tokens: DataFrame) -> DataFrame:
    return tokens.withColumns({"lemma": F.lower(F.trim("lemma")), "pos": F.lower(F.trim("pos"))})


def _counts(hits: DataFrame, key: list[str]) -> DataFrame:
    """Tokens and document runs per key; the first step shrinks hits to runs."""
    per_run = hits.groupBy(*key, "file", "run").agg(F.count("*").alias("n"))
    return per_run.groupBy(*key).agg(F.sum("n").alias("token_count"), F.count("*").alias("doc_count"))


def clause_markers(tokens: DataFrame, window: int = 2, wh: tuple[str, ...] = ("what", "who"), focus: list[str] | None = None) -> DataFrame:
    """``verb, marker, token_count, doc_count`` of verbs followed by a clause marker.

    After a verb the first ``that`` (tag cst) or wh word with at most ``window``
    tokens between them; breaks and other verbs end the search.
    """
    t = document_runs(_cleaned(tokens))
    verb = is_verb(F.col("pos"))
    stop = breaks(F.col("lemma"), F.col("pos"))
    w = Window.partitionBy("file", "run").orderBy("line_no")
    seg = t.withColumns({"_verb": verb & ~stop, "_stop": stop}).withColumn("_seg", F.sum((F.col("_verb") | F.col("_stop")).cast("int")).over(w))
    s = Window.partitionBy("file", "run", "_seg").orderBy("line_no")
    seg = seg.withColumns({"_at": F.row_number().over(s) - 1, "_head": F.first("lemma").over(s), "_ok": F.first("_verb").over(s)})
    marker = F.when((F.col("lemma") == "that") & (F.col("pos") == "cst"), F.lit("that")).when(
        F.col("lemma").isin(list(wh)), F.concat(F.lit("wh:"), F.col("lemma"))
    )
    hits = seg.where(F.col("_ok") & (F.col("_at") >= 1) & (F.col("_at") - 1 <= window)).withColumn("marker", marker).where("marker is not null")
    if focus is not None:
        hits = hits.where(F.col("_head").isin(focus))
    first = hits.groupBy("file", "run", "_seg").agg(F.min_by("marker", "line_no").alias("marker"), F.first("_head").alias("verb"))
    return _counts(first, ["verb", "marker"])


def verb_counts(tokens: DataFrame) -> DataFrame:
    """``verb, token_count, doc_count`` of all lexical verbs."""
    t = document_runs(_cleaned(tokens))
    hits = t.where(is_verb(F.col("pos")) & ~breaks(F.col("lemma"), F.col("pos"))).withColumn("verb", F.col("lemma"))
    return _counts(hits, ["verb"])


def verb_prepositions(tokens: DataFrame, prepositions: list[str] = PREPOSITIONS) -> DataFrame:
    """``verb, prep, token_count, doc_count`` of verbs with a preposition right after them."""
    t = document_runs(_cleaned(tokens))
    w = Window.partitionBy("file", "run").orderBy("line_no")
    before = t.withColumns({"_l": F.lag("lemma").over(w), "_p": F.lag("pos").over(w)})
    prep = F.col("pos").startswith("i") & F.col("lemma").isin(prepositions)
    hits = before.where(prep & is_verb(F.col("_p")) & ~breaks(F.col("_l"), F.col("_p"))).select("file", "run", F.col("_l").alias("verb"), F.col("lemma").alias("prep"))
    return _counts(hits, ["verb", "prep"])


def verb_particles(tokens: DataFrame, particles: list[str] | None = None) -> DataFrame:
    """``verb, particle, token_count, doc_count`` of verbs whose next word is a particle without an object.

    The particle stands before a break or at the end of its document.
    """
    from .parsing import PARTICLES

    t = document_runs(_cleaned(tokens))
    w = Window.partitionBy("file", "run").orderBy("line_no")
    end = breaks(F.col("lemma"), F.col("pos"))
    around = t.withColumns({"_l": F.lag("lemma").over(w), "_p": F.lag("pos").over(w), "_end": F.lead(end).over(w)})
    part = F.col("lemma").isin(sorted(particles or PARTICLES)) & F.coalesce(F.col("_end"), F.lit(True))
    hits = around.where(part & is_verb(F.col("_p")) & ~breaks(F.col("_l"), F.col("_p")))
    return _counts(hits.select("file", "run", F.col("_l").alias("verb"), F.col("lemma").alias("particle")), ["verb", "particle"])


def marker_rates(markers: DataFrame, verbs: DataFrame, wh: tuple[str, ...] = ("what", "who"), min_doc: int = 25) -> DataFrame:
    """Markers per verb as columns, with rates to six digits; verbs with few documents left out."""
    of = lambda cond, c: F.sum(F.when(cond, F.col(c)).otherwise(0))
    that, any_wh = F.col("marker") == "that", F.col("marker").startswith("wh:")
    kinds = {"that": that, "wh_total": any_wh, **{f"wh_{w}": F.col("marker") == f"wh:{w}" for w in wh}}
    wide = markers.groupBy("verb").agg(*[of(cond, f"{c}_count").alias(f"{c}_{k}") for k, cond in kinds.items() for c in ("token", "doc")])
    total = verbs.select("verb", F.col("token_count").alias("token_verb_total"), F.col("doc_count").alias("doc_verb_total"))
    got = total.join(wide, "verb", "left").fillna(0)
    rate = lambda k, c: F.round(F.coalesce(F.try_divide(F.col(f"{c}_{k}").cast("double"), F.col(f"{c}_verb_total")), F.lit(0.0)), 6).alias(f"{c}_rate_{k}")
    rows = got.withColumn("doc_total", F.col("doc_that") + F.col("doc_wh_total")).where(F.col("doc_total") >= min_doc)
    return rows.select("*", *[rate(k, c) for k in kinds for c in ("token", "doc")])


def clause_lists(
    rates: DataFrame, blocked: list[str] | None = None, *, doc_total_min: int = 50, doc_verb_min: int = 50, that_doc: float = 0.02,
    that_token: float = 0.005, wh_total: float = 0.01, wh_what: float = 0.005, wh_who: float = 0.005,
) -> DataFrame:
    """``list_name, lemma``: verbs that embed that-clauses, wh-clauses or both."""
    ok = rates.where(F.col("verb").rlike("^[a-z]+$") & (F.col("doc_total") >= doc_total_min) & (F.col("doc_verb_total") >= doc_verb_min))
    if blocked:
        ok = ok.where(~F.col("verb").isin(blocked))
    that = (F.col("doc_rate_that") >= that_doc) & (F.col("token_rate_that") >= that_token)
    wh = F.col("doc_rate_wh_total") >= wh_total
    tests = {"that": that, "wh_total": wh, "wh.what": F.col("doc_rate_wh_what") >= wh_what, "wh.who": F.col("doc_rate_wh_who") >= wh_who, "both": that & wh}
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]))
    return ok.select(F.explode(names).alias("list_name"), F.col("verb").alias("lemma"))


def sentences(tokens: DataFrame) -> DataFrame:
    """``file, doc_id, run, n, text, lemmas`` of sentences put together again.

    A sentence ends after ``.``, ``!`` or ``?`` tagged as punctuation, or with
    its document.  Punctuation joins the word before it; ``<p>`` is dropped.
    """
    t = document_runs(tokens)
    w = Window.partitionBy("file", "run").orderBy("line_no")
    ends = (F.col("pos").startswith("y") & F.col("surface").isin(".", "!", "?")).cast("int")
    t = t.withColumn("n", F.coalesce(F.sum(ends).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = t.where("surface <> '<p>'").groupBy("file", "run", "n").agg(
        F.first("doc_id").alias("doc_id"),
        F.array_sort(F.collect_list(F.struct("line_no", "surface", F.coalesce(F.col("pos").startswith("y"), F.lit(False)).alias("y")))).alias("p"),
        F.array_sort(F.collect_set(F.lower("lemma"))).alias("lemmas"),
    )
    glue = F.aggregate("p", F.lit(""), lambda a, x: F.concat(a, F.when((a == "") | x["y"], F.lit("")).otherwise(F.lit(" ")), x["surface"]))
    return parts.select("file", "doc_id", "run", "n", glue.alias("text"), "lemmas").where("text <> ''")


# ---- inventories -------------------------------------------------------------------


def attestation(frames: DataFrame, counts: DataFrame, min_doc: int = 5) -> DataFrame:
    """Inventory frames with their corpus counts: ``unattested``, ``low`` or ``ok``."""
    key = ["lemma", "prep"]
    c = counts.select(F.col("verb").alias("lemma"), "prep", "token_count", "doc_count")
    got = frames.join(c, key, "left").fillna(0, ["token_count", "doc_count"])
    status = F.when(F.col("doc_count") == 0, "unattested").when(F.col("doc_count") < min_doc, "low").otherwise("ok")
    return got.withColumn("status", status)


def missing_frames(frames: DataFrame, counts: DataFrame, min_doc: int = 10) -> DataFrame:
    """Attested (verb, prep) that the inventory lacks, with their rank."""
    c = counts.where(F.col("doc_count") >= min_doc)
    got = c.join(frames.select(F.col("lemma").alias("verb"), "prep"), ["verb", "prep"], "left_anti")
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("doc_count"), F.desc("token_count"), "verb", "prep")
    return got.withColumn("rank", F.row_number().over(w))


def prune(frames: DataFrame, drop: DataFrame) -> DataFrame:
    """The inventory without the frames of ``drop`` (lemma, kind, prep, particle)."""
    key = ["lemma", "kind", "prep", "particle"]
    d = drop.select(*[F.lower(F.trim(F.coalesce(c, F.lit("")))).alias(f"_{c}") for c in key])
    cond = [F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))) == F.col(f"_{c}") for c in key]
    return frames.join(d, cond, "left_anti")


def augment(frames: DataFrame, additions: DataFrame, create: bool = False) -> DataFrame:
    """The inventory with the frames that it lacks; new lemmas only if ``create``."""
    key = ["lemma", "kind", "prep", "particle"]
    cond = [frames[c].eqNullSafe(F.col(f"a.{c}")) for c in key]
    a = additions.select(*key).distinct().alias("a")
    if not create:
        a = a.join(frames.select("lemma").distinct(), "lemma", "left_semi").alias("a")
    fresh = a.join(frames, cond, "left_anti").select(*key)
    return frames.select(*key).unionByName(fresh)


def frame_lists(frames: DataFrame) -> DataFrame:
    """One row per lemma with its frames, sorted."""
    return frames.groupBy("lemma").agg(F.array_sort(F.collect_set(F.struct("kind", "prep", "particle"))).alias("frames"))


def lookup_frame(frames: DataFrame) -> DataFrame:
    """One frame per (lemma, kind): the last by ``ord``."""
    return frames.groupBy("lemma", "kind").agg(F.max_by(F.struct("prep", "particle"), "ord").alias("f")).select("lemma", "kind", "f.*")


def lemma_transitivity(frames: DataFrame) -> DataFrame:
    """Per lemma whether it has bare intransitive, transitive-like and ditransitive frames."""
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    kind = F.col("kind")
    return frames.groupBy("lemma").agg(
        any_(kind == "intr").alias("intr"),
        any_(kind.startswith("trans") | kind.startswith("ditrans")).alias("trans_like"),
        any_(kind.startswith("trans")).alias("trans"),
    )


def filter_frames(frames: DataFrame, kind: str, prep: str | None = None, particle: str | None = None, only: str | None = None) -> DataFrame:
    """Frames of a kind that fit a preposition and particle.

    ``only``: ``intr`` keeps lemmas without any transitive-like frame, ``trans``
    those without a bare intransitive one; it is ignored where nothing is left.
    """
    got = frames.where((F.col("kind") == kind) & F.col("lemma").rlike("^[a-z]+$"))
    if prep is not None:
        got = got.where(F.col("prep").isNull() | (F.lower("prep") == prep.lower()))
    if particle is not None:
        got = got.where(F.lower("particle") == particle.lower())
    if only is None:
        return got
    flags = lemma_transitivity(frames)
    ok = ~F.col("trans_like") if only == "intr" else ~F.col("intr")
    return keep_or_all(got.join(flags, "lemma"), ok).drop("intr", "trans_like", "trans")


def veto_transitive(frames: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Drop transitive-like frames of lemmas that a lexicon knows as never transitive.

    ``lexicon``: ``lemma, kind``.  A lemma left without frames takes the
    lexicon's kinds instead.
    """
    known = lemma_transitivity(lexicon).select("lemma", F.col("trans_like").alias("_ok"))
    j = frames.join(known, "lemma", "left")
    like = F.col("kind").startswith("trans") | F.col("kind").startswith("ditrans")
    kept = j.where(F.col("_ok").isNull() | F.col("_ok") | ~like).drop("_ok")
    emptied = frames.select("lemma").distinct().join(kept.select("lemma").distinct(), "lemma", "left_anti")
    fallback = lexicon.join(emptied, "lemma", "left_semi").select("lemma", "kind", *[F.lit(None).cast("string").alias(c) for c in ("prep", "particle")]).distinct()
    return kept.select("lemma", "kind", "prep", "particle").unionByName(fallback)


# ---- pools -------------------------------------------------------------------------


def keep_or_all(df: DataFrame, pred: Column) -> DataFrame:
    """Rows that satisfy ``pred``, or all rows if none does."""
    any_ = df.agg(F.coalesce(F.bool_or(pred), F.lit(False)))
    return df.where(F.coalesce(pred, F.lit(False)) | ~any_.scalar())


def ordered_distinct(df: DataFrame, key: str, order: str) -> DataFrame:
    """Each key once, at its first place."""
    return df.groupBy(key).agg(F.min(order).alias(order))


def union_by_priority(parts: list[DataFrame], key: str) -> DataFrame:
    """Distinct keys of several lists, numbered by list and place: ``key, ord``.

    Each part has ``key`` and ``ord``.
    """
    tagged = [p.select(key, F.struct(F.lit(i).alias("part"), F.col("ord").alias("at")).alias("_p")) for i, p in enumerate(parts)]
    all_ = tagged[0]
    for t in tagged[1:]:
        all_ = all_.unionByName(t)
    got = all_.groupBy(key).agg(F.min("_p").alias("_p"))
    return got.select(key, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_p", key)).alias("ord"))


def relaxed_window(pool: DataFrame, z: str, low: float | None, high: float, need: int = 8, step: float = 0.3, tries: int = 6) -> tuple[DataFrame, float]:
    """Raise the upper bound until enough of the pool survives; returns it with the bound.

    One aggregate counts the survivors of every bound: the first adequate one
    counts, else the first of those that keep most.
    """
    bounds = [high + step * i for i in range(tries + 1)]
    inside = lambda b: (F.col(z) < b) & (F.lit(True) if low is None else F.col(z) >= low)
    n = pool.agg(F.count("*").alias("all"), *[F.count_if(inside(b)).alias(f"n{i}") for i, b in enumerate(bounds)]).first()
    enough = min(need, n["all"])
    counts = [n[f"n{i}"] for i in range(len(bounds))]
    pick = next((i for i, c in enumerate(counts) if c >= enough), counts.index(max(counts)))
    return pool.where(inside(bounds[pick])), bounds[pick]


def normal_pool(lemmas: DataFrame, lexicon: DataFrame, low: float | None, high: float | None) -> DataFrame:
    """Lemmas in lower case, once each in order, without acronyms, within the window."""
    from ..functions.text import in_window, looks_like_acronym

    clean = lemmas.select(F.lower(F.trim("lemma")).alias("lemma"), "ord").where("lemma <> ''").where(~looks_like_acronym("lemma"))
    lex = lexicon.groupBy(F.lower("word").alias("lemma")).agg(F.max("zipf").alias("zipf"))
    got = ordered_distinct(clean, "lemma", "ord").join(lex, "lemma", "left").fillna(0.0, ["zipf"])
    return got.where(in_window("zipf", low, high))


def synset_counts(senses: DataFrame) -> DataFrame:
    """``lemma, v, n, a, r`` and the verbs' share (1 where there are none)."""
    of = lambda p: F.count_if(F.col("pos").isin(p))
    got = senses.groupBy("lemma").agg(of(["v"]).alias("v"), of(["n"]).alias("n"), of(["a", "s"]).alias("a"), of(["r"]).alias("r"))
    total = F.col("v") + F.col("n") + F.col("a") + F.col("r")
    return got.withColumn("verb_share", F.coalesce(F.round(F.try_divide(F.col("v").cast("double"), total), 6), F.lit(1.0)))


def dominant(kind: str, ratio: float = 1.0) -> Column:
    """Predicates over a lemma's senses ``v, n, a, r`` (and what else is named).

    ``noun``: at least as many noun senses as of any other part; of pure nouns
    those with one sense, or two and ``zipf`` >= 4.8, are left out.
    ``noun_strict``: more noun senses than of any part; not all in excluded
    domains (``only_excluded``); a gerund of a verb (``base_is_verb``) needs three.
    ``adjective``: more adjective senses than of any part, two beside a noun
    sense; ``adjective_weak``: without the latter.  ``verb``: few other senses,
    and ``ratio`` verb senses per noun sense and one more.
    """
    v, n, a, r = (F.col(c) for c in "vnar")
    most_a = (a > 0) & (n < a) & (v < a) & (r < a)
    if kind == "noun":
        pure = (v + a + r == 0) & ((n == 1) | ((n <= 2) & (F.col("zipf") >= 4.8)))
        return (n > 0) & (n >= F.greatest(v, a, r)) & ~pure
    if kind == "noun_strict":
        gerund = F.col("lemma").endswith("ing") & (F.length("lemma") > 5) & F.col("base_is_verb") & (n < 3)
        return (n > 0) & ~F.col("only_excluded") & (v < n) & (a < n) & (r < n) & ~gerund & (n / (v + 1) >= 1)
    if kind == "adjective":
        return most_a & ~((n > 0) & (a < 2))
    if kind == "adjective_weak":
        return most_a
    few = (n < 3) & (a < 3) & (r < 3) & ~((n > 0) & (v < 3))
    return (v > 0) & few & (v / (n + 1) >= ratio) & (v / (r + 1) >= 1) & (v / (a + 1) >= 1)


def verb_choices(senses: DataFrame, min_share: float = 1.0) -> DataFrame:
    """Lemmas that are verbs above all: the first of the ratios min_share, 0.6, 0 with any, else all."""
    levels = [min_share, 0.6, 0.0]
    n = senses.agg(*[F.count_if(dominant("verb", x)).alias(f"n{i}") for i, x in enumerate(levels)]).first()
    for i, x in enumerate(levels):
        if n[f"n{i}"]:
            return senses.where(dominant("verb", x))
    return senses


def domain_flags(senses: DataFrame, edges: DataFrame, domains: DataFrame) -> DataFrame:
    """Per lemma, whether one of its synsets, or a synset one step above, is of a domain.

    ``senses``: lemma, synset; ``edges``: synset, above; ``domains``: synset,
    domain (person, location, time, proper).
    """
    own = senses.join(domains, "synset").select("lemma", "domain")
    above = senses.join(edges, "synset").join(domains.withColumnRenamed("synset", "above"), "above").select("lemma", "domain")
    both = own.unionByName(above)
    flags = both.groupBy("lemma").agg(*[F.bool_or(F.col("domain") == d).alias(f"is_{d}") for d in ("person", "location", "time", "proper")])
    return senses.select("lemma").distinct().join(flags, "lemma", "left").fillna(False)


def filter_inflected(frames: DataFrame, lexicon: DataFrame, forms: DataFrame, low: float | None, high: float) -> DataFrame:
    """Frames whose lemma lies in a frequency window and whose past and -ing forms aren't too rare.

    ``lexicon``: word, zipf (words it lacks have 0); ``forms``: lemma, tag,
    form.  The rarer of VBD and VBG must reach ``low - 0.9``, without a lower
    bound ``high - 1.9``; a lemma without either form drops out.
    """
    zipf = lexicon.groupBy(F.lower("word").alias("w")).agg(F.max("zipf").alias("zipf"))
    z = lambda df, c: df.join(zipf, F.lower(c) == F.col("w"), "left").withColumn("_z", F.coalesce("zipf", F.lit(0.0))).drop("w", "zipf")
    verbs = forms.where(F.col("tag").isin("VBD", "VBG") & F.col("form").isNotNull()).select("lemma", "tag", "form").distinct()
    least = z(verbs, "form").groupBy("lemma", "tag").agg(F.max("_z").alias("_z")).groupBy("lemma").agg(F.min("_z").alias("_z"), F.count("*").alias("_n"))
    bound = high - 1.9 if low is None else low - 0.9
    fit = least.where((F.col("_n") == 2) & (F.round("_z", 6) >= round(bound, 6))).select("lemma")
    own = z(frames.select("lemma").distinct(), "lemma").where(T.in_window("_z", low, high)).select("lemma")
    return frames.join(own.join(fit, "lemma", "left_semi"), "lemma", "left_semi")


def noun_pool(lemmas: DataFrame, flags: DataFrame) -> DataFrame:
    """Noun lemmas without places, times and proper names; nothing comes back if none is left.

    ``flags``: lemma, is_location, is_time, is_proper; a lemma without flags stays.
    """
    out = flags.where(F.coalesce("is_location", F.lit(False)) | F.coalesce("is_time", F.lit(False)) | F.coalesce("is_proper", F.lit(False)))
    return lemmas.join(out.select("lemma"), "lemma", "left_anti")


def person_pool(gendered: DataFrame, flags: DataFrame) -> DataFrame:
    """``lemma, ord``: lemmas of known gender first, then other person nouns, each once by name."""
    named = lambda df: df.select(F.lower("lemma").alias("lemma"), F.lower("lemma").alias("ord"))
    return union_by_priority([named(gendered), named(flags.where("is_person"))], "lemma")
