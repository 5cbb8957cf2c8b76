"""Queries of corpus mining, inventories, pools, choice and scoring, with their SQL."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import choice as G
from ..operators import collocations as C
from ..operators import reports as R
from ..operators import scoring as K
from ..operators.lexicon import OWN, Lexicon, own_entries
from ..operators.lexicon import tag_lexicon as lexicon_of
from ..runtime import broadcast_if_small, same_name, same_name_sql, table
from .reports import d2_task_list

_PREPS = C.PREPOSITIONS
#: Words of any script, and the marks that end their runs.
WORDS = r"([\p{L}\p{M}]+|[.,!?;:])"
#: Documents of a source that one window group holds while runs are numbered.
DOCS_PER_CHUNK = 5
_VERBS = ["note", "says", "said", "is", "are", "was", "were"]


def tokens(spark: SparkSession, d: str, told: bool = True) -> DataFrame:
    """Documents as a tagged token stream; tags by a small rule.

    A document is one run, which the stream tells; without ``told`` runs are to
    be found from the documents' order, as in a stream read from files.
    """
    docs = table(spark, d, "documents").where("text is not null")
    words = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("file"), F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(WORDS), F.lit(1))).alias("p", "surface"))
    w = F.col("surface")
    pos = (
        F.when(w.rlike("^[.,!?;:]"), "y").when(w == "that", "cst").when(w.isin(_PREPS), "ii")
        .when(w.endswith("ed") | w.isin(_VERBS), "vvd").otherwise("nn1")
    )
    line = F.struct("doc_id", "p").alias("line_no")  # documents of any length follow each other
    chunk = F.floor(F.col("doc_id") / DOCS_PER_CHUNK).alias("chunk")
    run = F.col("doc_id").alias("run") if told else chunk
    return words.select("file", line, run, F.col("doc_id").cast("string").alias("doc_id"), "surface", w.alias("lemma"), pos.alias("pos"))


def w3_document_runs(spark, d):
    """Runs of documents found in the token stream of every source, and their tokens."""
    got = C.document_runs(tokens(spark, d, told=False))
    return got.groupBy("file", "run").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_tokens")).drop("run")


def w1_clause_markers(spark, d):
    """Verbs followed by that or a wh word, with at most two words between."""
    return C.clause_markers(tokens(spark, d), 2, ("what", "who", "whether", "because"))


def a15_verb_counts(spark, d):
    return C.verb_counts(tokens(spark, d))


def w2_verb_prepositions(spark, d):
    """Verbs with a preposition right after them."""
    return C.verb_prepositions(tokens(spark, d))


_WH = ("what", "who", "whether", "because")


def a16_marker_rates(spark, d):
    t = tokens(spark, d)
    return C.marker_rates(C.clause_markers(t, 2, _WH), C.verb_counts(t), _WH, 2)


def a17_clause_lists(spark, d):
    """Verbs by the clauses they embed."""
    t = tokens(spark, d)
    got = C.marker_rates(C.clause_markers(t, 4, ("because", "who", "what")), C.verb_counts(t), ("what", "who", "because"), 2)
    return C.clause_lists(got, ["says"], doc_total_min=2, doc_verb_min=2)


def w3_sentences(spark, d):
    """Sentences put together from tokens: their number and length per document."""
    got = C.sentences(tokens(spark, d))
    return got.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.length("text")).alias("chars"), F.sum(F.size("lemmas")).alias("lemmas"))


def _swaps(spark, d):
    rec = R.latest_records(table(spark, d, "generated_pair"))
    part = lambda a: rec.select("record_id", F.explode(f"meta.{a}").alias("s")).select("record_id", "s.*")
    return part("g_swaps").unionByName(part("b_swaps"))


def frames(spark, d):
    """An inventory out of the swapped verbs: the tag stands for the frame."""
    v = _swaps(spark, d).where("pos = 'verb' and lemma is not null").select(F.lower("lemma").alias("lemma"), "tag")
    kind = F.when(F.col("tag") == "VBD", "trans").when(F.col("tag") == "VBN", "ditrans").otherwise("intr")
    none = F.lit(None).cast("string")
    got = v.groupBy("lemma", kind.alias("kind")).agg(F.max(F.ascii(F.substring("tag", 3, 1))).alias("ord"))
    return got.select("lemma", "kind", none.alias("prep"), none.alias("particle"), "ord")


def _vp(spark, d):
    """Corpus (verb, prep) counts with the verb's ending taken off."""
    got = C.verb_prepositions(tokens(spark, d))
    return got.withColumn("verb", F.regexp_replace("verb", "ed$", ""))


def j11_augment(spark, d):
    """The inventory with the prepositions that its verbs take in the corpus."""
    add = _vp(spark, d).select(F.col("verb").alias("lemma"), F.lit("intr_pp").alias("kind"), "prep", F.lit(None).cast("string").alias("particle"))
    return C.augment(frames(spark, d), add, create=True)


def j8_attestation(spark, d):
    f = j11_augment(spark, d).select("lemma", F.coalesce("prep", F.lit("at")).alias("prep")).distinct()
    counts = _vp(spark, d).groupBy("verb", "prep").agg(F.sum("token_count").alias("token_count"), F.sum("doc_count").alias("doc_count"))
    return C.attestation(f, counts, 3)


def j9_missing(spark, d):
    """Attested pairs that the inventory lacks, the most attested first."""
    f = frames(spark, d).select("lemma", F.lit("at").alias("prep")).distinct()
    return C.missing_frames(f, C.verb_prepositions(tokens(spark, d)), 2)


def j10_prune(spark, d):
    """The inventory without ditransitive frames of unattested verbs."""
    f = frames(spark, d)
    attested = C.verb_counts(tokens(spark, d)).select(F.regexp_replace("verb", "ed$", "").alias("lemma"))
    drop = f.where("kind = 'ditrans'").join(attested, "lemma", "left_anti")
    return C.prune(f, drop).select("lemma", "kind")


def j6_lookup(spark, d):
    return C.lookup_frame(frames(spark, d))


def j14_transitivity(spark, d):
    return C.lemma_transitivity(frames(spark, d))


def op_p21_filter(spark, d):
    """Intransitive frames of verbs that are never transitive."""
    return C.filter_frames(frames(spark, d), "intr", only="intr").select("lemma", "kind")


def j13_veto(spark, d):
    """Frames against a lexicon that knows half of the verbs, as intransitive."""
    f = frames(spark, d)
    lex = f.where(F.length("lemma") % 2 == 0).select("lemma", F.lit("intr").alias("kind")).distinct()
    return C.veto_transitive(f.select("lemma", "kind", "prep", "particle"), lex).select("lemma", "kind").distinct()


def senses(spark, d):
    pos = F.substring("pos", 1, 1)
    return _swaps(spark, d).where("lemma is not null").select(F.lower("lemma").alias("lemma"), pos.alias("pos"))


def a21_sense_counts(spark, d):
    return C.synset_counts(senses(spark, d))


def op_p14_dominant(spark, d):
    """Lemmas that are mainly adjectives, nouns or verbs."""
    lex = table(spark, d, "zipf_lexicon").groupBy(F.lower("word").alias("lemma")).agg(F.max("zipf").alias("zipf"))
    got = C.synset_counts(senses(spark, d)).join(lex, "lemma", "left").fillna(0.0, ["zipf"])
    kinds = F.array_compact(F.array(*[F.when(C.dominant(k), F.lit(k)) for k in ("noun", "adjective", "adjective_weak", "verb")]))
    return got.select("lemma", F.explode(kinds).alias("kind"))


def op_p12_pool(spark, d):
    """A normalised pool within a frequency window."""
    lex = table(spark, d, "zipf_lexicon")
    return C.normal_pool(lex.select(F.col("word").alias("lemma"), F.col("n").alias("ord")), lex, 2.2, 3.0)


def op_p19_relaxed(spark, d):
    """A pool whose upper bound rises until eight lemmas survive."""
    lex = table(spark, d, "zipf_lexicon").select("word", "zipf").distinct()
    got, bound = C.relaxed_window(lex, "zipf", 1.0, 1.05)
    return got.withColumn("bound", F.round(F.lit(bound), 6))


def op_p13_keep_or_all(spark, d):
    """Filters that hold only if something is left: one does, one doesn't."""
    lex = table(spark, d, "zipf_lexicon").select("word", "zipf").distinct()
    some = C.keep_or_all(lex, F.col("word").startswith("b")).withColumn("filter", F.lit("b"))
    none = C.keep_or_all(lex, F.col("word").startswith("0")).withColumn("filter", F.lit("0"))
    return some.unionByName(none)


def op_p11_shapes(spark, d):
    """Lemma shapes of swapped words: plain, acronym."""
    w = _swaps(spark, d).select(F.lower(F.trim("new")).alias("w")).where("w <> ''").distinct()
    return w.select("w", T.plain_lemma("w").alias("plain"), T.looks_like_acronym("w").alias("acronym"))


def u2_ordered_union(spark, d):
    """Verb lists in order of priority, each verb once."""
    f = frames(spark, d).select("lemma", "kind").distinct()
    part = lambda k: f.where(F.col("kind") == k).select("lemma", F.col("lemma").alias("ord"))
    return C.union_by_priority([part("ditrans"), part("trans"), part("intr")], "lemma")


def j12_members(spark, d):
    """Lemmas of the inventory that the documents have, and that they haven't."""
    words = R.zipf_lexicon(table(spark, d, "documents"), "text").select(F.col("word").alias("lemma"))
    inv = frames(spark, d).select("lemma").distinct()
    return inv.join(words, "lemma", "left_semi").withColumn("there", F.lit(True)).unionByName(inv.join(words, "lemma", "left_anti").withColumn("there", F.lit(False)))


def _pairs(spark, d):
    return table(spark, d, "source_pair").where("idx is not null").select(same_name("subtask").alias("subtask"), "idx").distinct()


def _pool(spark, d):
    lex = table(spark, d, "zipf_lexicon").groupBy(F.lower("word").alias("lemma")).agg(F.max("zipf").alias("zipf"))
    return lex.where(T.in_window("zipf", 2.2, 3.0))


def g3_uniform_choice(spark, d):
    """Three seeded candidates per pair out of a window's pool."""
    return G.pick_uniform(_pairs(spark, d), _pool(spark, d).select("lemma"), [], ["subtask", "idx"], 0, 3)


def g1_weighted_choice(spark, d):
    """A seeded lemma per pair, by frequency."""
    return G.pick_weighted(_pairs(spark, d), _pool(spark, d), ["subtask", "idx"], 0).select("subtask", "idx", "lemma")


def g1_weighted_order(spark, d):
    """Each pair's lemmas in the order of up to 64 weighted draws."""
    got = G.weighted_order(_pairs(spark, d), _pool(spark, d), ["subtask", "idx"], 3)
    return got.select("subtask", "idx", F.array_join("lemmas", "|").alias("lemmas"))


def g2_weighted_permutation(spark, d):
    """Each subtask's order of the whole pool, weighted, without replacement."""
    subs = _pairs(spark, d).select("subtask").distinct().where("subtask is not null")
    got = G.weighted_permutation(subs.withColumn("pool", F.lit("p")), _pool(spark, d).withColumn("pool", F.lit("p")), ["pool"], ["subtask"], 5)
    return got.select("subtask", F.posexplode("lemmas").alias("pos", "lemma"))


def j3_row_join(spark, d):
    """Lines beside what the stream's first file has at the same physical row."""
    raw = table(spark, d, "raw_line").where("line_no is not null").select("file_stream", "file_name", "line_no", F.length("payload").alias("size"))
    lines = raw.select("file_stream", "file_name", "line_no").distinct()
    first = raw.join(raw.groupBy("file_stream").agg(F.min("file_name").alias("file_name")), ["file_stream", "file_name"], "left_semi")
    return R.by_row(lines, first.select("file_stream", "line_no", "size"), ["size"], ("file_stream", "line_no")).withColumn("size", F.coalesce("size", F.lit(-1)))


def op_p20_inflected(spark, d):
    """Frames of verbs whose rarer past or -ing form is frequent enough in the generated sentences.

    The given word list holds base forms only, so the frequencies are the sentences' own.
    """
    v = _swaps(spark, d).where("pos = 'verb' and lemma is not null and new is not null")
    forms = v.select(F.lower("lemma").alias("lemma"), F.when(F.col("tag") == "VB", "VBG").otherwise(F.col("tag")).alias("tag"), F.lower(F.trim("new")).alias("form"))
    return C.filter_inflected(frames(spark, d), R.zipf_lexicon(table(spark, d, "generated_pair").where("good_freq is not null"), "good_freq"), forms, 4.9, 6.5).select("lemma", "kind").distinct()


def op_p22_verbs(spark, d):
    """Lemmas that are verbs above all, by the first share that any reaches."""
    return C.verb_choices(C.synset_counts(senses(spark, d)), 1.0).select("lemma")


def op_p16_nouns(spark, d):
    """Nouns without those that are verbs too, which stand for places, times and names here."""
    own = senses(spark, d).where("pos = 'n'").select("lemma").distinct()
    flags = senses(spark, d).where("pos = 'v'").select("lemma", F.lit(True).alias("is_location"), F.lit(None).cast("boolean").alias("is_time"), F.lit(False).alias("is_proper"))
    return C.noun_pool(own, flags.distinct())


def op_p24_filter(spark, d):
    """Scores of the datasets named after a window, of models with at least a fifth of them."""
    once = R.scores_once(table(spark, d, "pair_score"))
    kept = R.report_filter(once, contains="zw", window_only=True, variant="freq", least=100, by="dataset")
    return kept.groupBy("dataset").agg(F.count("*").alias("n"))


def s2_tolerant(spark, d):
    """Payloads written as a text file and read again line by line: whole objects by field."""
    from ..runtime import shared_dir
    from ..sources import jsonl

    path = f"{shared_dir(spark)}/zipfloom/lines-{uuid.uuid4().hex}"
    table(spark, d, "raw_line").select(F.coalesce("payload", F.lit("")).alias("value")).write.text(path)
    kinds = spark.createDataFrame([], "subtask string, idx bigint").schema
    got = jsonl.read_tolerant(spark, path, kinds)
    return got.groupBy("subtask").agg(F.count("*").alias("n"), F.sum("idx").alias("idx"))


def s3_strict(spark, d):
    """The task list written as JSON lines and read strictly."""
    from ..runtime import shared_dir
    from ..sources import jsonl

    path = f"{shared_dir(spark)}/zipfloom/tasks-{uuid.uuid4().hex}"
    src = table(spark, d, "task_config").select("grp", "phenomenon", "subtask", "ord")
    jsonl.write_jsonl(src, path)
    return jsonl.read_strict(spark, path, src.schema)


def s25_rewrite(spark, d):
    """The same list rewritten in place, then not written again where it is."""
    from ..runtime import shared_dir
    from ..sources import files

    path = f"{shared_dir(spark)}/zipfloom/rewritten-{uuid.uuid4().hex}"
    src = table(spark, d, "task_config").select("subtask", "ord")
    files.write_once(src, path)
    files.rewrite(spark.read.schema(src.schema).json(path).withColumn("ord", F.col("ord") + 1), path)
    files.write_once(src, path)
    return spark.read.schema(src.schema).json(path)


def o5_seeded_sample(spark, d):
    return G.seeded_order(_pairs(spark, d), ["subtask", "idx"], 7, 100)


def g14_windows(spark, d):
    """Pool sizes of every frequency window, single values as upper bounds."""
    lex = table(spark, d, "zipf_lexicon").groupBy(F.lower("word").alias("lemma")).agg(F.max("zipf").alias("zipf"))
    windows = [(3.6, 5.0), (2.2, 3.0), (1.2, 2.0), (None, 3.4)]
    tests = [F.struct(F.lit(lo).cast("double").alias("lo"), F.lit(hi).alias("hi"), T.in_window("zipf", lo, hi).alias("ok")) for lo, hi in windows]
    return lex.select(F.explode(F.array(*tests)).alias("x")).where("x.ok").groupBy("x.lo", "x.hi").agg(F.count("*").alias("n"))


def f15_weights(spark, d):
    return table(spark, d, "zipf_lexicon").distinct().select("word", F.round(T.zipf_weight("zipf", 2.0), 6).alias("weight"))


def f1_casing(spark, d):
    """The case of the old word given to the new one, and the first letter raised."""
    s = _swaps(spark, d).select("old", "new").where("old <> '' and new <> ''").distinct()
    return s.select("old", "new", T.match_casing("old", "new").alias("cased"), T.capitalise_first("new").alias("raised"))


def f3_detokenise(spark, d):
    """Sentences cut into tokens and joined again."""
    s = table(spark, d, "source_pair").select("sentence_good").where("sentence_good is not null").distinct()
    toks = F.regexp_extract_all("sentence_good", F.lit(r"([A-Za-z]+|[^A-Za-z\s])"), F.lit(1))
    return s.select("sentence_good", T.detokenise(T.agree_articles(toks)).alias("text"))


def k1_unigram_nll(spark, d):
    """Likelihood of every source sentence under the documents' unigrams."""
    src = table(spark, d, "source_pair")
    texts = src.select(F.explode(F.array("sentence_good", "sentence_bad")).alias("text")).where("text is not null").distinct()
    return K.unigram_nll(texts, K.unigram_model(table(spark, d, "documents"), "text"))


def k2_pair_scores(spark, d):
    """Pairs scored by the default scorer, sides put together again."""
    pairs = table(spark, d, "source_pair").select(same_name("subtask").alias("subtask"), "idx", "sentence_good", "sentence_bad").distinct()
    return K.score_pairs(pairs, lambda t: K.unigram_nll(t, K.unigram_model(table(spark, d, "documents"), "text")))


def s26_unscored(spark, d):
    """Texts that no model has scored yet, against the scores as a cache."""
    texts = table(spark, d, "source_pair").select(F.col("sentence_good").alias("text")).where("text is not null").distinct()
    cache = table(spark, d, "pair_score").select(F.lit("m").alias("model"), F.sha1("good_text").alias("key")).where("key is not null").distinct()
    return K.uncached(texts, cache, "m").select("text")


QUERIES = {
    f.__name__: f
    for f in (
        w1_clause_markers, w3_document_runs, a15_verb_counts, w2_verb_prepositions, a16_marker_rates, a17_clause_lists, w3_sentences, j11_augment,
        j8_attestation, j9_missing, j10_prune, j6_lookup, j14_transitivity, op_p21_filter, j13_veto, a21_sense_counts, op_p14_dominant,
        op_p12_pool, op_p19_relaxed, op_p13_keep_or_all, op_p11_shapes, u2_ordered_union, j12_members, g3_uniform_choice,
        g1_weighted_choice, g1_weighted_order, g2_weighted_permutation, j3_row_join, op_p20_inflected, op_p22_verbs, op_p16_nouns, op_p24_filter, s2_tolerant, s3_strict, s25_rewrite, o5_seeded_sample, g14_windows, f15_weights, f1_casing, f3_detokenise, k1_unigram_nll, k2_pair_scores, s26_unscored,
    )
}

_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)
_TOK = rf"""w AS (SELECT doc_id, coalesce(source, '') AS file, unnest(x) AS surface, generate_subscripts(x, 1) - 1 AS p
  FROM (SELECT doc_id, source, regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}]+|[.,!?;:]') AS x FROM documents WHERE text IS NOT NULL)),
tok AS (SELECT file, doc_id * 4294967296 + p AS line_no, doc_id, surface AS lemma,
  CASE WHEN regexp_matches(surface, '^[.,!?;:]') THEN 'y' WHEN surface = 'that' THEN 'cst' WHEN surface IN ({_IN(_PREPS)}) THEN 'ii'
       WHEN suffix(surface, 'ed') OR surface IN ({_IN(_VERBS)}) THEN 'vvd' ELSE 'nn1' END AS pos FROM w)"""
_VC = "vc AS (SELECT lemma AS verb, count(*) AS token_count, count(DISTINCT doc_id) AS doc_count FROM tok WHERE pos = 'vvd' GROUP BY lemma)"


def _markers(window: int, wh: tuple[str, ...]) -> str:
    return f"""sg AS (SELECT *, sum((pos IN ('y', 'vvd'))::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS seg FROM tok),
    hd AS (SELECT *, row_number() OVER s - 1 AS k, first_value(lemma) OVER s AS verb, first_value(pos) OVER s AS hp FROM sg WINDOW s AS (PARTITION BY doc_id, seg ORDER BY line_no)),
    mk AS (SELECT doc_id, seg, verb, line_no, CASE WHEN lemma = 'that' AND pos = 'cst' THEN 'that' WHEN lemma IN ({_IN(wh)}) THEN 'wh:' || lemma END AS marker
        FROM hd WHERE hp = 'vvd' AND k >= 1 AND k - 1 <= {window}),
    f1 AS (SELECT doc_id, seg, any_value(verb) AS verb, arg_min(marker, line_no) AS marker FROM mk WHERE marker IS NOT NULL GROUP BY ALL),
    mc AS (SELECT verb, marker, count(*) AS token_count, count(DISTINCT doc_id) AS doc_count FROM f1 GROUP BY ALL)"""


def _rates(wh: tuple[str, ...], least: int) -> str:
    kinds = {"that": "marker = 'that'", "wh_total": "marker LIKE 'wh:%'", **{f"wh_{w}": f"marker = 'wh:{w}'" for w in wh}}
    sums = ", ".join(f"coalesce(sum({c}_count) FILTER ({k}), 0)::BIGINT AS {c}_{n}" for n, k in kinds.items() for c in ("token", "doc"))
    z = ", ".join(f"coalesce({c}_{n}, 0) AS {c}_{n}" for n in kinds for c in ("token", "doc"))
    rate = ", ".join(f"round(coalesce({c}_{n} / nullif({c}_verb_total, 0), 0), 6) AS {c}_rate_{n}" for n in kinds for c in ("token", "doc"))
    return f"""wd AS (SELECT verb, {sums} FROM mc GROUP BY verb),
    jn AS (SELECT vc.verb, vc.token_count AS token_verb_total, vc.doc_count AS doc_verb_total, {z}, coalesce(doc_that, 0) + coalesce(doc_wh_total, 0) AS doc_total FROM vc LEFT JOIN wd USING (verb)),
    rt AS (SELECT *, {rate} FROM jn WHERE doc_total >= {least})"""


_VP = f"""pv AS (SELECT *, lag(lemma) OVER d AS vl, lag(pos) OVER d AS vp FROM tok WINDOW d AS (PARTITION BY doc_id ORDER BY line_no)),
vpc AS (SELECT vl AS verb, lemma AS prep, count(*) AS token_count, count(DISTINCT doc_id) AS doc_count FROM pv WHERE pos = 'ii' AND vp = 'vvd' GROUP BY ALL)"""
_REC = "records AS (SELECT * FROM generated_pair QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY written_at DESC) = 1)"
_SW = f"""{_REC}, sw AS (SELECT s.* FROM (SELECT unnest(meta.g_swaps) AS s FROM records UNION ALL SELECT unnest(meta.b_swaps) FROM records))"""
_FR = f"""{_SW}, fr AS (SELECT DISTINCT lower(lemma) AS lemma, CASE WHEN tag = 'VBD' THEN 'trans' WHEN tag = 'VBN' THEN 'ditrans' ELSE 'intr' END AS kind FROM sw WHERE pos = 'verb' AND lemma IS NOT NULL)"""
_VPE = "vpe AS (SELECT regexp_replace(verb, 'ed$', '') AS verb, prep, sum(token_count)::BIGINT AS token_count, sum(doc_count)::BIGINT AS doc_count FROM vpc GROUP BY ALL)"
_INV = """inv AS (SELECT lemma, kind, NULL::VARCHAR AS prep, NULL::VARCHAR AS particle FROM fr UNION ALL SELECT DISTINCT verb, 'intr_pp', prep, NULL FROM vpe)"""
_SENSE = f"""{_SW}, sc AS (SELECT lower(lemma) AS lemma, count(*) FILTER (pos LIKE 'v%') AS v, count(*) FILTER (pos LIKE 'n%') AS n, count(*) FILTER (pos LIKE 'a%' OR pos LIKE 's%') AS a,
   count(*) FILTER (pos LIKE 'r%') AS r FROM sw WHERE lemma IS NOT NULL GROUP BY lower(lemma))"""
_LEX = "lex AS (SELECT lower(word) AS lemma, max(zipf) AS zipf FROM zipf_lexicon GROUP BY ALL)"
_PAIRS = f"pr AS (SELECT DISTINCT {same_name_sql('subtask')} AS subtask, idx FROM source_pair WHERE idx IS NOT NULL)"
_DRAW = lambda *p: f"('0x' || substr(md5(concat_ws('|', {', '.join(p)})), 1, 13))::BIGINT"
_POOL = f"{_LEX}, pool AS (SELECT lemma, zipf FROM lex WHERE zipf < 3.0 AND zipf >= 2.2)"
_CDF = """iv AS (SELECT lemma, floor(greatest(pow(10.0, zipf), 0.001) * 1048576)::HUGEINT AS w FROM pool),
cdf AS (SELECT lemma, sum(w) OVER (ORDER BY lemma) AS hi, sum(w) OVER (ORDER BY lemma) - w AS lo, sum(w) OVER () AS total FROM iv)"""
_AT = lambda u: f"({u}::HUGEINT * (SELECT any_value(total) FROM cdf)::HUGEINT) // 4503599627370496::HUGEINT"
_LM = r"""uw AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}]+')) AS word FROM documents), uc AS (SELECT word, count(*) AS n FROM uw GROUP BY word),
um AS (SELECT sum(n) AS total, count(*) AS kinds FROM uc)"""
_NLL = r"""tw AS (SELECT text, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}]+')) AS word FROM texts),
sc AS (SELECT text, round(sum(-ln((coalesce(n, 0) + 1) / (total + kinds + 1))), 6) AS total_nll, count(*) AS token_count FROM tw LEFT JOIN uc USING (word), um GROUP BY text)"""

ORACLES = {
    "w1_clause_markers": f"WITH {_TOK}, {_markers(2, _WH)} SELECT * FROM mc",
    "w3_document_runs": f"WITH {_TOK} SELECT file, doc_id::VARCHAR AS doc_id, count(*) AS n_tokens FROM tok GROUP BY ALL",
    "a15_verb_counts": f"WITH {_TOK}, {_VC} SELECT * FROM vc",
    "w2_verb_prepositions": f"WITH {_TOK}, {_VP} SELECT * FROM vpc",
    "a16_marker_rates": f"WITH {_TOK}, {_VC}, {_markers(2, _WH)}, {_rates(_WH, 2)} SELECT * FROM rt",
    "a17_clause_lists": f"""WITH {_TOK}, {_VC}, {_markers(4, ('because', 'who', 'what'))}, {_rates(('what', 'who', 'because'), 2)},
        ok AS (SELECT *, doc_rate_that >= 0.02 AND token_rate_that >= 0.005 AS t, doc_rate_wh_total >= 0.01 AS w FROM rt WHERE verb <> 'says' AND doc_verb_total >= 2)
        SELECT 'that' AS list_name, verb AS lemma FROM ok WHERE t UNION ALL SELECT 'wh_total', verb FROM ok WHERE w UNION ALL SELECT 'both', verb FROM ok WHERE t AND w
        UNION ALL SELECT 'wh.what', verb FROM ok WHERE doc_rate_wh_what >= 0.005 UNION ALL SELECT 'wh.who', verb FROM ok WHERE doc_rate_wh_who >= 0.005""",
    "w3_sentences": f"""WITH {_TOK}, n AS (SELECT *, coalesce(sum((lemma IN ('.', '!', '?'))::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM tok),
        g AS (SELECT doc_id, n, sum(length(lemma)) + count(*) FILTER (pos <> 'y') - (arg_min(pos, line_no) <> 'y')::INT AS chars, count(DISTINCT lemma) AS lemmas FROM n GROUP BY ALL)
        SELECT doc_id::VARCHAR AS doc_id, count(*) AS n_sentences, sum(chars)::BIGINT AS chars, sum(lemmas)::BIGINT AS lemmas FROM g GROUP BY doc_id""",
    "j11_augment": f"WITH {_TOK}, {_VP}, {_VPE}, {_FR}, {_INV} SELECT * FROM inv",
    "j8_attestation": f"""WITH {_TOK}, {_VP}, {_VPE}, {_FR}, {_INV}, f AS (SELECT DISTINCT lemma, coalesce(prep, 'at') AS prep FROM inv)
        SELECT lemma, f.prep, coalesce(token_count, 0) AS token_count, coalesce(doc_count, 0) AS doc_count,
        CASE WHEN coalesce(doc_count, 0) = 0 THEN 'unattested' WHEN doc_count < 3 THEN 'low' ELSE 'ok' END AS status FROM f LEFT JOIN vpe ON f.lemma = vpe.verb AND f.prep = vpe.prep""",
    "j9_missing": f"""WITH {_TOK}, {_VP}, {_FR} SELECT *, row_number() OVER (ORDER BY doc_count DESC, token_count DESC, verb, prep) AS rank FROM vpc
        WHERE doc_count >= 2 AND NOT EXISTS (SELECT 1 FROM fr WHERE fr.lemma = vpc.verb AND vpc.prep = 'at')""",
    "j10_prune": f"""WITH {_TOK}, {_VC}, {_FR} SELECT lemma, kind FROM fr WHERE NOT (kind = 'ditrans' AND lemma NOT IN (SELECT regexp_replace(verb, 'ed$', '') FROM vc))""",
    "j6_lookup": f"WITH {_FR} SELECT DISTINCT lemma, kind, NULL::VARCHAR AS prep, NULL::VARCHAR AS particle FROM fr",
    "j14_transitivity": f"WITH {_FR} SELECT lemma, bool_or(kind = 'intr') AS intr, bool_or(kind IN ('trans', 'ditrans')) AS trans_like, bool_or(kind = 'trans') AS trans FROM fr GROUP BY lemma",
    "op_p21_filter": f"""WITH {_FR}, x AS (SELECT * FROM fr WHERE kind = 'intr' AND regexp_full_match(lemma, '[a-z]+')), k AS (SELECT * FROM x WHERE lemma NOT IN (SELECT lemma FROM fr WHERE kind <> 'intr'))
        SELECT * FROM k UNION ALL SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM k)""",
    "j13_veto": f"""WITH {_FR}, kept AS (SELECT * FROM fr WHERE length(lemma) % 2 = 1 OR kind = 'intr')
        SELECT DISTINCT lemma, kind FROM kept UNION SELECT lemma, 'intr' FROM fr WHERE lemma NOT IN (SELECT lemma FROM kept)""",
    "a21_sense_counts": f"WITH {_SENSE} SELECT *, CASE WHEN v + n + a + r = 0 THEN 1.0 ELSE round(v / (v + n + a + r), 6) END AS verb_share FROM sc",
    "op_p14_dominant": f"""WITH {_SENSE}, {_LEX}, x AS (SELECT sc.*, coalesce(zipf, 0) AS zipf FROM sc LEFT JOIN lex USING (lemma))
        SELECT lemma, 'noun' AS kind FROM x WHERE n > 0 AND n >= greatest(v, a, r) AND NOT (v + a + r = 0 AND (n = 1 OR (n <= 2 AND zipf >= 4.8)))
        UNION ALL SELECT lemma, 'adjective' FROM x WHERE a > 0 AND n < a AND v < a AND r < a AND NOT (n > 0 AND a < 2)
        UNION ALL SELECT lemma, 'adjective_weak' FROM x WHERE a > 0 AND n < a AND v < a AND r < a
        UNION ALL SELECT lemma, 'verb' FROM x WHERE v > 0 AND n < 3 AND a < 3 AND r < 3 AND NOT (n > 0 AND v < 3) AND v / (n + 1) >= 1 AND v / (r + 1) >= 1 AND v / (a + 1) >= 1""",
    "op_p12_pool": f"""WITH {_LEX}, c AS (SELECT lower(trim(word)) AS lemma, min(n) AS ord FROM zipf_lexicon WHERE trim(word) <> '' GROUP BY ALL)
        SELECT lemma, ord, zipf FROM c JOIN lex USING (lemma) WHERE NOT (regexp_matches(lemma, '[0-9]') OR (regexp_matches(lemma, '[a-z]') AND NOT regexp_matches(lemma, '[aeiou]')))
        AND zipf < 3.0 AND zipf >= 2.2""",
    "op_p19_relaxed": """WITH lx AS (SELECT DISTINCT word, zipf FROM zipf_lexicon), b AS (SELECT i, 1.05 + 0.3 * i AS hi FROM range(7) t(i)),
        c AS (SELECT i, hi, (SELECT count(*) FROM lx WHERE zipf < hi AND zipf >= 1.0) AS k FROM b),
        p AS (SELECT coalesce((SELECT min(i) FROM c WHERE k >= least(8, (SELECT count(*) FROM lx))), (SELECT min(i) FROM c WHERE k = (SELECT max(k) FROM c))) AS i)
        SELECT word, zipf, round(hi, 6)::DOUBLE AS bound FROM lx JOIN c ON zipf < hi AND zipf >= 1.0 JOIN p USING (i)""",
    "op_p13_keep_or_all": """WITH lx AS (SELECT DISTINCT word, zipf FROM zipf_lexicon) SELECT *, 'b' AS filter FROM lx WHERE prefix(word, 'b') UNION ALL SELECT *, '0' FROM lx""",
    "op_p11_shapes": f"""WITH {_SW}, x AS (SELECT DISTINCT lower(trim(new)) AS w FROM sw WHERE trim(new) <> '')
        SELECT w, regexp_full_match(w, '[a-z]+') AS plain, regexp_matches(w, '[0-9]') OR (regexp_matches(w, '[a-z]') AND NOT regexp_matches(w, '[aeiou]')) AS acronym FROM x""",
    "u2_ordered_union": f"""WITH {_FR}, p AS (SELECT lemma, min(CASE kind WHEN 'ditrans' THEN 0 WHEN 'trans' THEN 1 ELSE 2 END) AS k FROM fr GROUP BY lemma)
        SELECT lemma, row_number() OVER (ORDER BY k, lemma) AS ord FROM p""",
    "j12_members": f"WITH {_FR}, {_LM} SELECT DISTINCT lemma, lemma IN (SELECT word FROM uc) AS there FROM fr",
    "g3_uniform_choice": f"""WITH {_PAIRS}, {_POOL}, q AS (SELECT lemma, row_number() OVER (ORDER BY lemma) - 1 AS pos, count(*) OVER () AS size FROM pool),
        t AS (SELECT subtask, idx, a::INT AS attempt, {_DRAW("'0'", "coalesce(subtask, '')", "idx::VARCHAR", "a::VARCHAR")} % (SELECT any_value(size) FROM q) AS pos FROM pr, range(3) r(a))
        SELECT subtask, idx, attempt, lemma FROM t JOIN q USING (pos)""",
    "g1_weighted_choice": f"""WITH {_PAIRS}, {_POOL}, {_CDF},
        t AS (SELECT subtask, idx, {_AT(_DRAW("'0'", "coalesce(subtask, '')", "idx::VARCHAR"))} AS u FROM pr)
        SELECT subtask, idx, lemma FROM t JOIN cdf ON lo <= u AND u < hi""",
    "g1_weighted_order": f"""WITH {_PAIRS}, {_POOL}, {_CDF},
        t AS (SELECT subtask, idx, a, {_AT(_DRAW("'3'", "coalesce(subtask, '')", "idx::VARCHAR", "a::VARCHAR"))} AS u FROM pr, range(64) r(a)),
        f AS (SELECT subtask, idx, lemma, min(a) AS a FROM t JOIN cdf ON lo <= u AND u < hi GROUP BY ALL)
        SELECT subtask, idx, string_agg(lemma, '|' ORDER BY a) AS lemmas FROM f GROUP BY ALL""",
    "g2_weighted_permutation": f"""WITH {_PAIRS}, {_POOL}, s AS (SELECT DISTINCT subtask FROM pr WHERE subtask IS NOT NULL),
        k AS (SELECT subtask, lemma, -ln(({_DRAW("'5'", "subtask", "lemma")} + 1) / 4503599627370497.0) / greatest(pow(10.0, zipf), 0.001) AS k FROM s, pool)
        SELECT subtask, (row_number() OVER (PARTITION BY subtask ORDER BY k, lemma) - 1)::INT AS pos, lemma FROM k""",
    "j3_row_join": """WITH f AS (SELECT file_stream, min(file_name) AS file_name FROM raw_line WHERE line_no IS NOT NULL GROUP BY 1),
        m AS (SELECT file_stream, line_no, max(length(payload)) AS size FROM raw_line SEMI JOIN f USING (file_stream, file_name) GROUP BY ALL)
        SELECT file_stream, file_name, line_no, coalesce(size, -1)::INT AS size FROM (SELECT DISTINCT file_stream, file_name, line_no FROM raw_line WHERE line_no IS NOT NULL) LEFT JOIN m USING (file_stream, line_no)""",
    "op_p20_inflected": rf"""WITH {_FR}, gw AS (SELECT unnest(regexp_extract_all(lower(good_freq), '[\p{{L}}\p{{M}}]+')) AS lemma FROM generated_pair),
        lex AS (SELECT lemma, round(log10(1e9 * count(*) / (SELECT count(*) FROM gw)), 2) AS zipf FROM gw GROUP BY lemma),
        fm AS (SELECT DISTINCT lower(lemma) AS lemma, CASE WHEN tag = 'VB' THEN 'VBG' ELSE tag END AS tag, lower(trim(new)) AS form
          FROM sw WHERE pos = 'verb' AND lemma IS NOT NULL AND new IS NOT NULL),
        z AS (SELECT fm.lemma, tag, max(coalesce(zipf, 0)) AS z FROM fm LEFT JOIN lex ON fm.form = lex.lemma WHERE tag IN ('VBD', 'VBG') GROUP BY ALL),
        ok AS (SELECT lemma FROM z GROUP BY lemma HAVING count(*) = 2 AND round(min(z), 6) >= 4.0)
        SELECT DISTINCT fr.lemma, kind FROM fr LEFT JOIN lex USING (lemma) WHERE coalesce(zipf, 0) < 6.5 AND coalesce(zipf, 0) >= 4.9 AND fr.lemma IN (SELECT lemma FROM ok)""",
    "op_p22_verbs": f"""WITH {_SENSE}, x AS (SELECT *, v > 0 AND n < 3 AND a < 3 AND r < 3 AND NOT (n > 0 AND v < 3) AND v / (r + 1) >= 1 AND v / (a + 1) >= 1 AS ok, v / (n + 1) AS share FROM sc),
        l AS (SELECT CASE WHEN bool_or(ok AND share >= 1) THEN 1.0 WHEN bool_or(ok AND share >= 0.6) THEN 0.6 WHEN bool_or(ok) THEN 0.0 END AS least FROM x)
        SELECT lemma FROM x, l WHERE least IS NULL OR (ok AND share >= least)""",
    "op_p16_nouns": f"WITH {_SW} SELECT DISTINCT lower(lemma) AS lemma FROM sw WHERE lemma IS NOT NULL AND prefix(pos, 'n') AND lower(lemma) NOT IN (SELECT lower(lemma) FROM sw WHERE prefix(pos, 'v') AND lemma IS NOT NULL)",
    "op_p24_filter": r"""WITH once AS (SELECT score_id, arg_min(struct_pack(d := dataset, v := variant), ingested_at) AS s FROM pair_score GROUP BY score_id)
        SELECT s.d AS dataset, count(*) AS n FROM once WHERE contains(s.d, 'zw') AND regexp_matches(s.d, 'zw_\d+p\d+_\d+p\d+') AND s.v = 'freq' GROUP BY 1 HAVING count(*) >= 100""",
    "s2_tolerant": """WITH o AS (SELECT payload::JSON AS j FROM raw_line WHERE json_valid(payload)), k AS (SELECT j FROM o WHERE json_type(j) = 'OBJECT')
        SELECT CASE WHEN json_type(j, '$.subtask') <> 'NULL' THEN j ->> '$.subtask' END AS subtask, count(*) AS n, sum(CASE WHEN json_type(j, '$.idx') IN ('BIGINT', 'UBIGINT') THEN (j ->> '$.idx')::BIGINT END)::BIGINT AS idx FROM k GROUP BY 1""",
    "s3_strict": "SELECT grp, phenomenon, subtask, ord FROM task_config",
    "s25_rewrite": "SELECT subtask, (ord + 1)::INT AS ord FROM task_config",
    "f1_casing": r"""WITH x AS (SELECT DISTINCT s.old AS old, s.new AS new FROM (SELECT unnest(meta.g_swaps) AS s FROM (SELECT * FROM generated_pair QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY written_at DESC) = 1)
          UNION ALL SELECT unnest(meta.b_swaps) FROM (SELECT * FROM generated_pair QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY written_at DESC) = 1)) WHERE s.old <> '' AND s.new <> ''),
        y AS (SELECT *, array_to_string(list_transform(regexp_extract_all(old, '\p{L}+|\P{L}+'), lambda w: upper(w[1]) || lower(w[2:])), '') AS told,
                 array_to_string(list_transform(regexp_extract_all(new, '\p{L}+|\P{L}+'), lambda w: upper(w[1]) || lower(w[2:])), '') AS tnew FROM x)
        SELECT old, new, CASE WHEN (regexp_matches(old, '\p{L}') AND old = upper(old)) OR old IN ('ii', 'iii', 'iv') THEN upper(new) WHEN regexp_matches(old, '\p{L}') AND old = told THEN tnew
          WHEN regexp_matches(old, '\p{L}') AND old = lower(old) THEN lower(new) WHEN regexp_matches(old[1], '\p{L}') AND old[1] = upper(old[1]) THEN tnew ELSE lower(new) END AS cased,
          upper(new[1]) || new[2:] AS raised FROM y""",
    "o5_seeded_sample": f"WITH {_PAIRS} SELECT * FROM pr ORDER BY {_DRAW(chr(39) + '7' + chr(39), 'coalesce(subtask, ' + chr(39) * 2 + ')', 'idx::VARCHAR')}, subtask, idx LIMIT 100",
    "g14_windows": f"""WITH {_LEX}, b(lo, hi) AS (VALUES (3.6::DOUBLE, 5.0::DOUBLE), (2.2, 3.0), (1.2, 2.0), (NULL, 3.4)) SELECT lo, hi, count(*) AS n FROM lex JOIN b ON zipf < hi AND (lo IS NULL OR zipf >= lo) GROUP BY ALL""",
    "f15_weights": "SELECT DISTINCT word, n, round(greatest(pow(pow(10.0, zipf), 0.5), 0.001), 6) AS weight FROM zipf_lexicon".replace("word, n, ", "word, "),
    "k1_unigram_nll": f"WITH texts AS (SELECT DISTINCT text FROM (SELECT sentence_good AS text FROM source_pair UNION ALL SELECT sentence_bad FROM source_pair) WHERE text IS NOT NULL), {_LM}, {_NLL} SELECT * FROM sc",
    "k2_pair_scores": f"""WITH texts AS (SELECT DISTINCT text FROM (SELECT sentence_good AS text FROM source_pair UNION ALL SELECT sentence_bad FROM source_pair) WHERE text IS NOT NULL), {_LM}, {_NLL}
        SELECT DISTINCT {same_name_sql('subtask')} AS subtask, idx, sentence_good, sentence_bad, g.total_nll AS good_total_nll, g.token_count AS good_token_count, b.total_nll AS bad_total_nll, b.token_count AS bad_token_count
        FROM source_pair p JOIN sc g ON p.sentence_good = g.text JOIN sc b ON p.sentence_bad = b.text""",
    "s26_unscored": "SELECT DISTINCT sentence_good AS text FROM source_pair WHERE sentence_good IS NOT NULL AND sentence_good NOT IN (SELECT good_text FROM pair_score WHERE good_text IS NOT NULL)",
}


# ---- generation ------------------------------------------------------------------------


def document_frames(spark, d, lexicon=None):
    """``lemma, kind, prep, particle`` that documents attest, each once, in one pass without a shuffle of tokens.

    What :func:`_vp`, :func:`a25_frames` (prepositional frames) and
    :func:`C.verb_particles` find: prepositions right after a verb, the parsed
    sentences' prepositions with and without an object, particles.
    """
    from ..operators import parsing as P
    from ..operators import targets as X

    lexicon = tag_lexicon(spark, d) if lexicon is None else lexicon
    known = lexicon.known
    preps, verbs, marks = set(_PREPS), set(_VERBS), set(".,!?;:")

    def run(parts):
        parser, seen = P.RuleParser(known), set()
        is_verb = lambda w: w not in marks and w != "that" and w not in preps and (w.endswith("ed") or w in verbs)
        for pdf in parts:
            new = set()
            for words, own in zip(pdf["words"], pdf[OWN]):
                own_entries(parser, own)
                text, ends = "", len(words) - 1
                for i, w in enumerate(words):
                    if i and is_verb(words[i - 1]):
                        lemma = words[i - 1].removesuffix("ed")
                        if w in preps:
                            new.add((lemma, "intr_pp", w, None))
                        if w in P.PARTICLES and (i == ends or words[i + 1] in marks):
                            new.add((lemma, "intr_particle", None, w))
                    text += w if not text or w in marks else f" {w}"
                    if w in (".", "!", "?") or i == ends:
                        s = P.Sentence(parser.parse(text))
                        found = ((t, X.corpus_frame(s, t)) for t in s.tokens if t.pos == "VERB")
                        new |= {(t.lemma.lower(), *f, None) for t, f in found if f and f[1]}
                        text = ""
            yield pd.DataFrame(sorted(new - seen, key=str), columns=["lemma", "kind", "prep", "particle"])
            seen |= new

    words = F.regexp_extract_all(F.lower("text"), F.lit(WORDS), F.lit(1)).alias("words")
    docs = lexicon.attach(table(spark, d, "documents").where("text is not null").select("text"), "text").select(words, OWN)
    return docs.mapInPandas(run, "lemma string, kind string, prep string, particle string").distinct()


def swap_frames(spark, d, lexicon=None):
    """The augmented inventory: frames of swapped verbs, and those that documents attest."""
    own = frames(spark, d).select("lemma", "kind", "prep", "particle")
    return own.unionByName(document_frames(spark, d, lexicon)).distinct()


def clause_pools(lists):
    """``pool, lemma`` of :func:`C.clause_lists`: verbs of that-clauses, and those of each wh word besides."""
    that = lists.where("list_name in ('that', 'both')").select("lemma")
    pools = that.withColumn("pool", F.lit("verb:clause"))
    for wh in ("what", "who"):
        own = lists.where(F.col("list_name") == f"wh.{wh}").select("lemma").unionByName(that)
        pools = pools.unionByName(own.withColumn("pool", F.lit(f"verb:clause:{wh}")))
    return pools.select("pool", "lemma").distinct()


def swap_pools(spark, d, low=2.2, high=3.0, persons=None, clauses=None, lexicon=None):
    """Pools of a frequency window: nouns, adjectives, and verbs by frame; and the fixed lists of control subtasks.

    ``persons``: ``lemma, gender`` (null: either) of person nouns, which give
    ``noun:person`` and ``noun:<gender>``; the given tables have none.
    ``clauses``: ``list_name, lemma`` as of :func:`a17_clause_lists`, for
    parsers that tell clausal complements, which the rule parser doesn't.
    """
    from ..operators.swaps import control_pools

    lex = _lexicon(spark, d).where(T.in_window("zipf", low, high))
    part = F.substring("pos", 1, 1)
    kinds = senses(spark, d).select("lemma", part.alias("p")).where("p in ('n', 'a')").distinct()
    words = kinds.select(F.when(F.col("p") == "n", F.lit("noun")).otherwise(F.lit("adj")).alias("pool"), "lemma")
    kind = F.concat(F.lit("verb:"), "kind")
    own = F.when(F.col("particle").isNotNull(), F.array(F.concat(kind, F.lit("+"), "particle"))).otherwise(
        F.array_compact(F.array(kind, F.concat(kind, F.lit(":"), "prep")))
    )
    one = swap_frames(spark, d, lexicon).where(~F.col("lemma").rlike("[ _-]"))
    got = words.unionByName(one.select(F.explode(own).alias("pool"), "lemma"))
    if clauses is not None:
        got = got.unionByName(clause_pools(clauses))
    if persons is not None:
        names = F.array_compact(F.array(F.lit("noun:person"), F.concat(F.lit("noun:"), "gender")))
        got = got.unionByName(persons.select(F.explode(names).alias("pool"), F.lower(F.trim("lemma")).alias("lemma")))
    return got.join(lex.select("lemma"), "lemma", "left_semi").select("pool", "lemma").unionByName(control_pools(spark))


def _lexicon(spark, d):
    return table(spark, d, "zipf_lexicon").groupBy(F.lower("word").alias("lemma")).agg(F.max("zipf").alias("zipf"))


def tag_lexicon(spark, d) -> Lexicon:
    """Surface -> (tag, lemma) of the words that swaps replaced."""
    return lexicon_of(_swaps(spark, d))


def g12_generate(spark, d):
    """Source pairs with nouns, adjectives and verbs swapped out of a window's pools."""
    from ..operators import swaps as S
    from ..operators.parsing import RuleParser

    src = table(spark, d, "source_pair").where("idx is not null and deleted_at is null")
    cfg = d2_task_list(spark, d).select("subtask", "phenomenon")
    once = src.groupBy(same_name("subtask").alias("subtask"), "idx").agg(F.max_by(F.struct("sentence_good", "sentence_bad"), F.struct("loaded_at", "sentence_good")).alias("s"))
    pairs = once.select("subtask", "idx", "s.*").join(broadcast_if_small(cfg), "subtask", "left")
    lexicon = tag_lexicon(spark, d)
    known = lexicon.known
    return S.generate(pairs, swap_pools(spark, d, lexicon=lexicon), lambda: RuleParser(known), lexicon=lexicon)


def t3_targets(spark, d):
    """Frames of the source sentences' verbs, counted."""
    from ..operators import parsing as P
    from ..operators import targets as X

    lexicon = tag_lexicon(spark, d)
    known = lexicon.known

    def run(parts):
        parser = P.RuleParser(known)
        for pdf in parts:
            rows = []
            for text, own in zip(pdf["sentence_good"], pdf[OWN]):
                own_entries(parser, own)
                for v in X.verb_targets(P.Sentence(parser.parse(text))):
                    rows.append((v.lemma, v.kind, v.prep.low if v.prep else None))
            yield pd.DataFrame(rows, columns=["lemma", "kind", "prep"])

    src = table(spark, d, "source_pair").select("sentence_good").where("sentence_good is not null").distinct()
    return lexicon.attach(src, "sentence_good").mapInPandas(run, "lemma string, kind string, prep string").groupBy("lemma", "kind", "prep").agg(F.count("*").alias("n"))


def a25_frames(spark, d):
    """Frames of the documents' verbs: tokens and documents of each (lemma, frame, prep)."""
    from ..operators import parsing as P
    from ..operators import targets as X

    lexicon = tag_lexicon(spark, d)
    known = lexicon.known

    def run(parts):
        parser = P.RuleParser(known)
        for pdf in parts:
            rows = []
            for doc, text, own in zip(pdf["doc_id"], pdf["text"], pdf[OWN]):
                own_entries(parser, own)
                s = P.Sentence(parser.parse(text))
                for t in s.tokens:
                    if t.pos == "VERB" and (got := X.corpus_frame(s, t)):
                        rows.append((doc, t.lemma.lower(), *got))
            yield pd.DataFrame(rows, columns=["doc_id", "lemma", "frame", "prep"])

    sents = C.sentences(tokens(spark, d)).select("doc_id", "text")
    seen = lexicon.attach(sents, "text").mapInPandas(run, "doc_id string, lemma string, frame string, prep string")
    per_doc = seen.groupBy("lemma", "frame", "prep", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("lemma", "frame", "prep").agg(F.sum("n").alias("token_count"), F.count("*").alias("doc_count"))


QUERIES |= {f.__name__: f for f in (g12_generate, t3_targets, a25_frames)}
