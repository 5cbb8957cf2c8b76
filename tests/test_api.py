import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from zipfloom import api
from zipfloom.operators import choice as G
from zipfloom.operators import collocations as C
from zipfloom.operators import reports as R
from zipfloom.operators import scoring as K
from zipfloom.operators import swaps as S
from zipfloom.operators import targets as X
from zipfloom.operators.parsing import RuleParser
from zipfloom.plans import corpus
from zipfloom.runtime import same_name, table
from zipfloom.sources import jsonl


def test_windows():
    w = api.windows([3.4], ["2.2-3.0"])
    assert [x.name for x in w] == ["zipf_3p4", "zw_2p2_3p0"] and api.windows()[0].bounds("noun") == (None, 3.4)
    own = api.Window(2.0, 3.0, highs={"verb": 4.0}, lows={"adj": 1.0})
    assert own.bounds("verb") == (2.0, 4.0) and own.bounds("adj") == (1.0, 3.0)
    assert api.Window(lows={"noun": 1.0}).bounds("noun") == (1.0, 3.4)


@pytest.fixture(scope="module")
def job(spark):
    sf = "/root/testdata/sf0.001"
    src = table(spark, sf, "source_pair").where("idx is not null").groupBy(same_name("subtask").alias("subtask"), "idx").agg(
        F.max("sentence_good").alias("sentence_good"), F.max("sentence_bad").alias("sentence_bad")
    )
    pairs = src.withColumn("phenomenon", F.lit("p")).where("sentence_good is not null and sentence_bad is not null")
    lexicon = table(spark, sf, "zipf_lexicon")
    pool = lexicon.select(F.explode(F.array(F.lit("noun"), F.lit("adj"), F.lit("verb:*"))).alias("pool"), F.lower("word").alias("lemma"))
    tags = corpus.tag_lexicon(spark, sf)
    known = tags.known
    model = K.unigram_model(table(spark, sf, "documents"), "text")
    return pairs, pool, lexicon, tags, lambda: RuleParser(known), {"unigram": lambda t: K.unigram_nll(t, model)}


def test_generate_score_evaluate(spark, job, tmp_path):
    pairs, pool, lexicon, tags, parser, models = job
    over = api.windows(None, ["2.2-3.0", "3.0-4.0"])
    plan = api.generate(pairs, pool, lexicon, over=over, dry_run=True).collect()
    assert {r["dataset"] for r in plan} == {"zw_2p2_3p0", "zw_3p0_4p0"} and all(r["n_lemmas"] > 0 for r in plan)
    out = str(tmp_path / "out")
    got = api.generate(pairs, pool, lexicon, over=over, parser=parser, tags=tags, limit=2, timestamp="20240101-000000", out=out)
    assert set(got) == {"20240101-000000_zw_2p2_3p0", "20240101-000000_zw_3p0_4p0"}
    one = got["20240101-000000_zw_2p2_3p0"].collect()
    assert max(sum(r["subtask"] == s for r in one) for s in {r["subtask"] for r in one}) <= 2
    zipf = {r["w"]: r["z"] for r in lexicon.groupBy(F.lower("word").alias("w")).agg(F.max("zipf").alias("z")).collect()}
    lemmas = {s["lemma"] for r in one for s in r["meta"]["g_swaps"]}
    assert lemmas and all(2.2 <= zipf[x] < 3.0 for x in lemmas)
    written = spark.read.json(f"{out}/20240101-000000_zw_2p2_3p0.jsonl")
    assert "good_freq" in written.columns and "good_original" not in written.columns and spark.read.json(f"{out}/original.jsonl").count() == len(one)
    scores, acc = api.evaluate(got, models, variant="both", run_ts="t", out=out)
    total = {(r["dataset"], r["variant"]): r["total"] for r in acc.where("level = 'overall'").collect()}
    assert len(total) == 4 and all(n > 0 for n in total.values()) and spark.read.json(f"{out}/pair-scores.jsonl").count() == scores.count()
    rows = scores.where("variant = 'freq' and dataset like '%2p2%'").collect()
    right = sum(r["good_total_nll"] < r["bad_total_nll"] for r in rows)
    freq = acc.where("level = 'overall' and variant = 'freq' and dataset like '%2p2%'").first()
    assert (freq["correct"], freq["total"]) == (right, len(rows))
    report = api.accuracy(scores.where("variant = 'freq'"), normalize_by="token", output=str(tmp_path / "acc.json"))
    assert report.count() > 1 and (tmp_path / "acc.json").exists()
    qc = api.quality_check(got["20240101-000000_zw_2p2_3p0"], models, limit=5, strategy="proportional").count()
    assert 0 < qc <= 5


def test_reports_and_mining(spark, sf):
    scores, records = R.scores_once(table(spark, sf, "pair_score")), table(spark, sf, "generated_pair")
    assert api.zipf_trend(scores, records, quantile_bins=4, min_bin_n=5).count() > 0
    assert api.zipf_trend(scores, records, of="length", window_only=True, quantile_bins=4, min_bin_n=5).columns
    assert set(api.regime_diagnostics(scores, records)) == {"frequency", "length"}
    t = corpus.tokens(spark, sf)
    assert api.mine_clause_markers(t, min_doc=1).count() > 0
    frames = corpus.frames(spark, sf).select("lemma", "kind", "prep", "particle")
    inv = api.build_inventory(frames, frames)
    assert inv.count() == inv.distinct().count() == frames.distinct().count()
    counts = spark.createDataFrame([("give", "up", 30), ("give", "in", 2)], "verb string, particle string, doc_count int")
    more = api.augment_inventory(inv, counts, "intr_particle", create=True)
    assert more.where("particle = 'up'").count() == 1 and more.where("particle = 'in'").count() == 0
    assert api.prune_inventory(more, more.where("lemma = 'give'")).where("lemma = 'give'").count() == 0
    assert set(api.mine_prepositions(t, inv)) == {"attested", "missing"}


def test_a_causal_model_as_scorer():
    vocabulary = 7

    def logits(ids, mask):  # a score that depends on the own token and place only
        return np.sin(ids[..., None] * 1.7 + np.arange(vocabulary) * 0.9 + np.arange(ids.shape[1])[None, :, None])

    def by_hand(ids):
        nll = 0.0
        for t in range(len(ids) - 1):
            z = [math.sin(ids[t] * 1.7 + v * 0.9 + t) for v in range(vocabulary)]
            nll += math.log(sum(map(math.exp, z))) - z[ids[t + 1]]
        return nll, max(0, len(ids) - 1)

    texts = ["1 2 3", "", "4", "6 5 4 3 2 1 0", "1 2 3"]
    tokenize = lambda t: [int(x) for x in t.split()]
    for batch in (1, 2, 64):
        got = K.CausalScorer(tokenize, logits, batch=batch).score(texts)
        for (a, n), t in zip(got, texts):
            want = by_hand(tokenize(t))
            assert abs(a - want[0]) < 1e-9 and n == want[1]
    assert K.CausalScorer(tokenize, logits, max_length=3).score(["6 5 4 3"])[0][1] == 2


def test_fields_rows_and_filters(spark):
    df = spark.createDataFrame([(2, "x", None), (1, None, "y"), (0, None, None)], "n int, good string, sentence_good string")
    assert R.sticky_field(df, ["good", "sentence_good"], ["n"]) == "sentence_good" and R.sticky_field(df, ["absent"], ["n"]) is None
    lines = spark.createDataFrame([("f", 0), ("f", 1)], "file string, _row bigint")
    meta = spark.createDataFrame([("f", 1, "m"), ("f", 1, "k"), ("g", 0, "z")], "file string, _row bigint, v string")
    assert [(r["_row"], r["v"]) for r in R.by_row(lines, meta, ["v"]).orderBy("_row").collect()] == [(0, None), (1, "m")]
    s = spark.createDataFrame([("a_zw_1p2_2p0", "freq")] * 3 + [("b", "freq")] + [("c_zw_2p2_3p0", "original")] * 2, "dataset string, variant string")
    n = lambda **k: R.report_filter(s, **k).count()
    assert (n(contains="zw"), n(window_only=True), n(variant="freq"), n(least=2), n(top=1)) == (5, 5, 4, 5, 3)


def test_pools(spark):
    lemmas = spark.createDataFrame([("rome",), ("day",), ("dog",)], "lemma string")
    flags = spark.createDataFrame([("rome", True, None, False, False), ("day", False, True, False, False), ("nurse", False, False, False, True)],
                                  "lemma string, is_location boolean, is_time boolean, is_proper boolean, is_person boolean")
    assert [r["lemma"] for r in C.noun_pool(lemmas, flags).collect()] == ["dog"] and C.noun_pool(lemmas.where("lemma = 'day'"), flags).count() == 0
    gendered = spark.createDataFrame([("Queen",), ("nurse",)], "lemma string")
    got = {r["lemma"]: r["ord"] for r in C.person_pool(gendered, flags).collect()}
    assert got == {"nurse": 1, "queen": 2}


def test_weighted_orders(spark):
    items = spark.range(400).selectExpr("id as k")
    pool = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 0.0), ("d", -9.0)], "lemma string, zipf double")
    rows = G.weighted_order(items, pool, ["k"], 1).collect()
    assert all(sorted(r["lemmas"]) == list("abcd") for r in rows)
    first = [r["lemmas"][0] for r in rows]
    assert 0.83 < first.count("a") / 400 < 0.96
    perm = G.weighted_permutation(items, pool, [], ["k"], 1).collect()
    assert all(sorted(r["lemmas"]) == list("abcd") for r in perm) and 0.83 < sum(r["lemmas"][0] == "a" for r in perm) / 400 < 0.96
    big = spark.createDataFrame([(f"w{i:03d}", 1.0) for i in range(100)], "lemma string, zipf double")
    assert all(len(r["lemmas"]) == len(set(r["lemmas"])) <= 64 for r in G.weighted_order(items, big, ["k"], 1).collect())
    tiny = spark.createDataFrame([("a", 9.0), ("b", -9.0)], "lemma string, zipf double")
    cdf, total = G._intervals(tiny, 1.0)
    assert all(r["hi"] > r["lo"] for r in cdf.collect()) and total > 10**15  # no share is rounded away
    assert G.weighted_order(items, pool.limit(0), ["k"], 1).count() == 0


def test_pairs_by_name(spark, tmp_path):
    (tmp_path / "one.jsonl").write_text('{"sentence_good": "a", "sentence_bad": "b"}\n\n{"sentence_good": "c", "sentence_bad": "d", "field": "f"}\n')
    spark.createDataFrame([(7, "g", "h")], "idx int, sentence_good string, sentence_bad string").write.parquet(str(tmp_path / "two.parquet"))
    got = {(r["subtask"], r["idx"], r["sentence_good"], r["field"]) for r in jsonl.read_pairs(spark, str(tmp_path), ["one", "two"]).collect()}
    assert got == {("one", 0, "a", None), ("one", 2, "c", "f"), ("two", 7, "g", None)}


def test_one_replacement_has_one_gender():
    lex = {"dog": ("NN", "dog"), "saw": ("VBD", "see")}
    parse = RuleParser(lex).parse
    text = "The dog saw himself and the dog saw herself."
    from zipfloom.operators.parsing import Sentence

    s = Sentence(parse(text))
    bound = X.reflexive_subjects(s)
    if len({g for g, _ in bound.values()}) > 1:
        slots, reasons = S.aligned_slots(s, s, {"noun", "noun:male", "noun:female"}, "p", "s", {"noun"})
        assert "noun_swap_failed" in reasons and not slots
    slots, _ = S.aligned_slots(s, s, {"verb:*"}, "p", "s", {"verb"})
    assert {x["g_pool"] for x in slots} == {"verb:*"}
