import random

import pytest

from zipfloom.operators import parsing as P
from zipfloom.operators import swaps as S
from zipfloom.operators import targets as X


def sent(*rows):
    """text/lemma/pos/tag/dep/head"""
    out = []
    for i, r in enumerate(rows):
        text, lemma, pos, tag, dep, head = r.split("/")
        out.append(P.Token(i, text, lemma, pos, tag, dep, int(head), chunk=pos == "NOUN"))
    return P.Sentence(out)


WOMAN = sent("The/the/DET/DT/det/2", "old/old/ADJ/JJ/amod/2", "woman/woman/NOUN/NN/nsubj/3", "saw/see/VERB/VBD/ROOT/3", "herself/herself/PRON/PRP/dobj/3", "././PUNCT/./punct/3")


def test_targets_on_a_given_parse():
    assert X.reflexive_subjects(WOMAN) == {2: ("female", True)}
    assert [t.text for t in X.noun_targets(WOMAN)] == ["woman"]
    assert [t.text for t in X.adjective_targets(WOMAN)] == ["old"]
    v = X.verb_targets(WOMAN)[0]
    assert (v.kind, v.lemma, v.clause) == ("trans", "see", False)


def test_frames():
    s = sent("He/he/PRON/PRP/nsubj/1", "gave/give/VERB/VBD/ROOT/1", "her/she/PRON/PRP/dative/1", "it/it/PRON/PRP/dobj/1")
    assert X.sentence_frame(s, s.tokens[1])[0] == "ditrans" and X.corpus_frame(s, s.tokens[1]) == ("trans", None)
    s = sent("She/she/PRON/PRP/nsubj/1", "sat/sit/VERB/VBD/ROOT/1", "down/down/ADP/RP/prt/1")
    assert X.sentence_frame(s, s.tokens[1])[0] == "intr_particle" and X.corpus_frame(s, s.tokens[1]) == ("intr", None)
    s = sent("It/it/PRON/PRP/nsubj/1", "lay/lie/VERB/VBD/ROOT/1", "near/near/ADP/IN/prep/1", "it/it/PRON/PRP/pobj/2")
    assert X.sentence_frame(s, s.tokens[1])[0] == "intr_pp" and X.corpus_frame(s, s.tokens[1]) == ("intr_pp", "near")
    s = sent("I/i/PRON/PRP/nsubj/1", "know/know/VERB/VBP/ROOT/1", "that/that/SCONJ/IN/mark/4", "he/he/PRON/PRP/nsubj/4", "left/leave/VERB/VBD/ccomp/1")
    v = X.verb_targets(s)[0]
    assert v.clause and v.that and v.wh is None
    s = sent("It/it/PRON/PRP/nsubjpass/2", "was/be/AUX/VBD/auxpass/2", "seen/see/VERB/VBN/ROOT/2")
    assert X.passive_head(s).text == "seen"


def test_rejected_nouns():
    s = sent("A/a/DET/DT/det/1", "lot/lot/NOUN/NN/nsubj/3", "of/of/ADP/IN/prep/1", "ran/run/VERB/VBD/ROOT/3")
    assert X.noun_targets(s) == []
    s = sent("Rome/Rome/NOUN/NN/nsubj/1", "fell/fall/VERB/VBD/ROOT/1")
    assert X.noun_targets(s) == []
    s = sent("Oxen/ox/NOUN/NNS/nsubj/1", "fell/fall/VERB/VBD/ROOT/1")
    assert [t.text for t in X.noun_targets(s)] == ["Oxen"]


def test_control_adjectives_and_forced_frames():
    s = sent("He/he/PRON/PRP/nsubj/1", "is/be/AUX/VBZ/ROOT/1", "eager/eager/ADJ/JJ/acomp/1", "to/to/PART/TO/aux/4", "go/go/VERB/VB/xcomp/2")
    assert [t.text for t in X.control_adjectives(s)] == ["eager"]
    assert X.forced_frame("argument_structure", "causative", "bad", "trans") == ("intr", True)
    assert X.forced_frame("argument_structure", "drop_argument", "bad", "intr_pp") == ("intr_pp", False)
    assert X.forced_frame("x", "causative", "bad", "trans") == ("trans", False)


def model_align(good, bad):
    used, out = set(), []
    for g, (lemma, text) in enumerate(good):
        for test in (lambda b: b[0] == lemma, lambda b: b[1].lower() == text.lower()):
            hit = [k for k, b in enumerate(bad) if k not in used and test(b)]
            if hit:
                used.add(hit[0])
                out.append((g, hit[0]))
                break
    return out


def test_alignment():
    assert P.align([("run", "run"), ("run", "ran")], [("run", "run")]) == [(0, 0)]
    assert P.align([("a", "a"), ("b", "b")], [("c", "c")], zip_rest=True) == [(0, 0)]
    rng = random.Random(0)
    for _ in range(200):
        make = lambda: [(rng.choice("abc"), rng.choice("xyX")) for _ in range(rng.randint(0, 5))]
        good, bad = make(), make()
        assert P.align(good, bad) == model_align(good, bad)


def test_possessives_and_compounds():
    s = sent("the/the/DET/DT/det/1", "horror/horror/NOUN/NN/poss/3", "'s/'s/PART/POS/case/1", "end/end/NOUN/NN/dobj/3")
    words = [t.text for t in s.tokens]
    P.place_noun(s, s.tokens[1], "horrors", words)
    assert words[1:3] == ["horrors", "'"]
    s = sent("ex/ex/NOUN/NN/x/2", "-/-/PUNCT/:/x/2", "wife/wife/NOUN/NN/x/2")
    words = [t.text for t in s.tokens]
    assert P.place_noun(s, s.tokens[2], "king", words) == "ex-wife" and words == ["ex-king", "", ""]


POOL = [("noun", w) for w in ("apple", "table", "city")] + [("adj", w) for w in ("vivid", "odd")] + [("verb:trans", w) for w in ("carry", "lift")]
PAIRS = [
    ("s", 0, "p", "The old dog chased a dog .", "The old dogs chased a dog .", "clash"),
    ("s", 1, "p", None, "x", "clash"), (None, 2, None, "", "", ""), ("s", 3, "p", "Yes .", "No .", ""),
]
LEX = {"dog": ("NN", "dog"), "dogs": ("NNS", "dog"), "old": ("JJ", "old"), "chased": ("VBD", "chase")}


def run(spark, n, **kw):
    pairs = spark.createDataFrame(PAIRS, "subtask string, idx int, phenomenon string, sentence_good string, sentence_bad string, slots string").repartition(n)
    pool = spark.createDataFrame(POOL, "pool string, lemma string")
    return {r["idx"]: r for r in S.generate(pairs, pool, lambda: P.RuleParser(LEX), **kw).collect()}


def test_generation(spark):
    got = run(spark, 2)
    r = got[0]
    assert r["good_freq"] != r["bad_freq"] and len(r["g_swaps"]) == len(r["b_swaps"]) == 4
    by = {}
    for s in [*r["g_swaps"], *r["b_swaps"]]:
        by.setdefault((s["old"].rstrip("s"), s["pos"]), set()).add(s["lemma"])
    assert all(len(v) == 1 for v in by.values())  # one replacement per original lemma
    assert [s["i"] for s in r["g_swaps"]] == sorted(s["i"] for s in r["g_swaps"])
    assert got[1]["swap_failed_reason"] == got[2]["swap_failed_reason"] == "no_swap" and "no_candidates" in got[3]["swap_failed_reason"]
    assert {k: v["good_freq"] for k, v in run(spark, 4).items()} == {k: v["good_freq"] for k, v in got.items()}
    assert all((v["swap_failed_reason"] is None) == (v["good_freq"] is not None) for v in got.values())


def test_stages_and_fits(spark):
    only = run(spark, 1, stages=("noun",))[0]
    assert {s["pos"] for s in only["g_swaps"]} == {"noun"}
    none = run(spark, 1, fits=lambda old, new: False)[0]
    assert none["good_freq"] is None and "noun_no_token_match" in none["swap_failed_reason"]


@pytest.mark.parametrize("d", ["sf0.001"])
def test_generated_records(spark, d):
    from zipfloom.plans.corpus import g12_generate
    from zipfloom.runtime import table

    folder = f"/root/testdata/{d}"
    g = g12_generate(spark, folder).cache()
    rec = S.as_records(g, table(spark, folder, "zipf_lexicon"))
    rows = rec.collect()
    assert len(rows) == g.count()
    for r in rows:
        assert (r["meta"]["swap_failed_reason"] is None) == (r["good_freq"] is not None)
        if r["good_freq"]:
            assert r["good_freq"] != r["bad_freq"] and len(r["meta"]["g_swaps"]) == len(r["meta"]["b_swaps"])
            for role in ("good_freq", "bad_freq"):
                assert r["meta"]["zipf_swapped_position_aggregates"][role] is not None


def test_control_subtasks_draw_each_side_from_its_pool(spark):
    from zipfloom.functions.wordlists import CONTROL_ADJECTIVES, RAISING_ADJECTIVES, TOUGH_ADJECTIVES

    tokens = sent("He/he/PRON/PRP/nsubj/1", "is/be/AUX/VBZ/ROOT/1", "?/?/ADJ/JJ/acomp/1", "to/to/PART/TO/aux/4", "go/go/VERB/VB/xcomp/2").tokens

    class Fixed:
        """A parser of the one shape; sent to the workers by value."""

        def parse(self, text):
            word = text.split()[2]
            return [P.Token(t.i, word if t.text == "?" else t.text, word if t.text == "?" else t.lemma, t.pos, t.tag, t.dep, t.head) for t in tokens]

    rows = [(s, 0, "control_raising", "He is likely to go", "He is eager to go") for s in ("x", "tough_vs_raising_1")]
    pairs = spark.createDataFrame(rows, "subtask string, idx int, phenomenon string, sentence_good string, sentence_bad string")
    got = {r["subtask"]: r for r in S.generate(pairs, S.control_pools(spark), Fixed, stages=("adj",)).collect()}
    assert got["x"]["g_swaps"][0]["lemma"] in RAISING_ADJECTIVES and got["x"]["b_swaps"][0]["lemma"] in CONTROL_ADJECTIVES
    assert got["tough_vs_raising_1"]["g_swaps"][0]["lemma"] in TOUGH_ADJECTIVES


def test_small_helpers(spark):
    assert S.normal_targets("all") == {"noun", "adj", "verb"} and S.normal_targets(["Nouns", "", "x"]) == {"noun"} and S.normal_targets(None) == set()
    lemmas = spark.createDataFrame([("table",), ("water",), ("kindness",)], "lemma string")
    classes = spark.createDataFrame([("water", "MASS")], "lemma string, cls string")
    pick = lambda r: sorted(x["lemma"] for x in S.noun_pools(lemmas, r, classes).collect())
    assert pick("COUNT") == ["table"] and pick("MASS") == ["water"] and len(pick(None)) == 3
    other = [P.Token(t.i, "girl" if t.text == "woman" else t.text, t.lemma, t.pos, t.tag) for t in WOMAN.tokens]
    assert P.tags_preserved(WOMAN.tokens, other) and not P.tags_preserved(WOMAN.tokens, other[:-1])
    assert P.describe(WOMAN)[2][:5] == (2, "woman", "woman", "NOUN", "NN")


def test_pools_of_the_augmented_inventory(spark, sf):
    from zipfloom.plans.corpus import g12_generate, swap_pools

    persons = spark.createDataFrame([(r["lemma"], "female") for r in swap_pools(spark, sf).where("pool = 'noun'").limit(2).collect()], "lemma string, gender string")
    names = {r["pool"] for r in swap_pools(spark, sf, persons=persons).select("pool").distinct().collect()}
    assert {"verb:trans", "verb:intr", "verb:intr_pp", "verb:subject_raising", "adj:tough", "noun:person", "noun:female"} <= names
    got = g12_generate(spark, sf).where("good_original rlike ' (was|were) [a-z]+ed by '").collect()
    assert got and all(any(s["pos"] == "verb" for s in r["g_swaps"]) for r in got)


def test_particles_without_an_object(spark):
    from zipfloom.operators import collocations as C

    words = [("She", "pp"), ("sat", "vvd"), ("down", "rp"), (".", "y"), ("He", "pp"), ("fell", "vvd"), ("down", "ii"), ("it", "pp"), ("and", "cc"), ("gave", "vvd"), ("up", "rp")]
    rows = [("f", i, "1", w, w, p) for i, (w, p) in enumerate(words)]
    t = spark.createDataFrame(rows, "file string, line_no bigint, doc_id string, surface string, lemma string, pos string")
    assert {tuple(r) for r in C.verb_particles(t).collect()} == {("sat", "down", 1, 1), ("gave", "up", 1, 1)}


def test_a_slot_goes_through_its_whole_pool(spark):
    pairs = [("s", i, "p", "The dog chased a dog .", "The dogs chased a dog .") for i in range(40)]
    df = spark.createDataFrame(pairs, "subtask string, idx int, phenomenon string, sentence_good string, sentence_bad string")
    pool = spark.createDataFrame([("noun", f"{a}{b}table") for a in "bcdfghklmn" for b in "bcdfghklmn"] + [("noun", "apple")], "pool string, lemma string")
    run = lambda n, fits: S.generate(df.repartition(n), pool, lambda: P.RuleParser(LEX), stages=("noun",), fits=fits).collect()
    one = run(2, lambda old, new: new.startswith("apple"))
    assert len(one) == 40 and {s["lemma"] for r in one for s in r["g_swaps"]} == {"apple"} and all(r["swap_failed_reason"] is None for r in one)
    half = lambda old, new: new[0] in "bd" and new[1] == "k"
    assert {r["idx"]: r["good_freq"] for r in run(3, half)} == {r["idx"]: r["good_freq"] for r in run(1, half)}


def test_pools_by_preposition_particle_and_clause():
    pools = {"verb:intr_pp", "verb:intr_pp:by", "verb:intr_particle+down", "verb:clause", "verb:clause:who", "verb:trans"}
    slot = lambda s: [x["g_pool"] for x in S.find_slots(s, s, Given(), pools, "p", "s", {"verb"})[0]]
    lay = "It/it/PRON/PRP/nsubj/1 lay/lie/VERB/VBD/ROOT/1 {0}/{0}/ADP/IN/prep/1 it/it/PRON/PRP/pobj/2"
    assert slot(lay.format("by")) == ["verb:intr_pp:by"] and slot(lay.format("near")) == ["verb:intr_pp"]
    sat = "She/she/PRON/PRP/nsubj/1 sat/sit/VERB/VBD/ROOT/1 {0}/{0}/ADP/RP/prt/1"
    assert slot(sat.format("down")) == ["verb:intr_particle+down"]
    both = sat.format("up") + " saw/see/VERB/VBD/conj/1 it/it/PRON/PRP/dobj/3"
    assert slot(both) == ["verb:trans"]  # no pool of sit up; see is swapped all the same
    know = "I/i/PRON/PRP/nsubj/1 know/know/VERB/VBP/ROOT/1 {0}/{0}/PRON/IN/mark/4 he/he/PRON/PRP/nsubj/4 is/be/AUX/VBZ/ccomp/1"
    assert slot(know.format("that")) == ["verb:clause"] and slot(know.format("who")) == ["verb:clause:who"]


class Given:
    """A parser of parses that are written out."""

    def parse(self, text):
        return sent(*text.split()).tokens


def test_pools_of_prepositions_and_clauses(spark, sf):
    from zipfloom.plans.corpus import swap_pools

    lists = spark.createDataFrame([("that", "x"), ("wh.who", "y")], "list_name string, lemma string")
    word = swap_pools(spark, sf).where("pool = 'noun'").first()["lemma"]
    lists = lists.withColumn("lemma", lists["lemma"].substr(1, 0)).selectExpr("list_name", f"concat(lemma, '{word}') lemma")
    got = {r["pool"] for r in swap_pools(spark, sf, clauses=lists).select("pool").distinct().collect()}
    assert {"verb:intr_pp", "verb:intr_pp:by", "verb:clause", "verb:clause:who"} <= got


def test_frames_of_documents_are_those_of_the_operators(spark, sf):
    from zipfloom.operators import collocations as C
    from zipfloom.plans import corpus as X

    want = {(r["verb"], "intr_pp", r["prep"], None) for r in X._vp(spark, sf).collect()}
    want |= {(r["lemma"], r["frame"], r["prep"], None) for r in X.a25_frames(spark, sf).where("prep is not null").collect()}
    want |= {(r["verb"].removesuffix("ed"), "intr_particle", None, r["particle"]) for r in C.verb_particles(X.tokens(spark, sf)).collect()}
    rows = [tuple(r) for r in X.document_frames(spark, sf).collect()]
    assert want and set(rows) == want and len(rows) == len(want)


LEXICON = {w: (t, l) for w, t, l in (x.split("/") for x in (
    "boy/NN/boy book/NN/book girl/NN/girl gave/VBD/give said/VBD/say left/VBD/leave wants/VBZ/want leave/VB/leave sat/VBD/sit picked/VBD/pick saw/VBD/see "
    "teacher/NN/teacher sad/JJ/sad seen/VBN/see table/NN/table knew/VBD/know").split())}  # fmt: skip


def parsed(text):
    return P.Sentence(P.RuleParser(LEXICON).parse(text))


def deps(text):
    s = parsed(text)
    return {(t.text, t.dep, (s.at(t.head) or t).text) for t in s.tokens}


def test_the_rule_parser_tells_arguments():
    assert {("boy", "iobj", "gave"), ("book", "dobj", "gave"), ("girl", "nsubj", "gave")} <= deps("The girl gave the boy a book.")
    assert {("that", "mark", "left"), ("left", "ccomp", "said"), ("boy", "nsubj", "left")} <= deps("The girl said that the boy left.")
    assert {("to", "aux", "leave"), ("leave", "xcomp", "wants")} <= deps("The girl wants to leave.")
    assert {("down", "prt", "sat")} <= deps("The girl sat down.")
    assert {("up", "prt", "picked"), ("book", "dobj", "picked")} <= deps("The girl picked the book up.")
    assert {("eager", "acomp", "is"), ("leave", "xcomp", "eager"), ("to", "aux", "leave")} <= deps("The boy is eager to leave.")
    assert {("saw", "relcl", "boy"), ("left", "ROOT", "left")} <= deps("The boy who saw the girl left.")
    assert {("boy", "nsubjpass", "seen"), ("was", "auxpass", "seen"), ("girl", "pobj", "by")} <= deps("The boy was seen by the girl.")


def test_targets_through_the_rule_parser():
    assert [t.text for t in X.control_adjectives(parsed("The boy is eager to leave."))] == ["eager"]
    kinds = {v.lemma: (v.kind, v.clause, v.particle.low if v.particle else None) for t in (
        "The girl gave the boy a book.", "The girl said that the boy left.", "The teacher sat down.") for v in X.verb_targets(parsed(t))}
    assert kinds == {"give": ("ditrans", False, None), "say": ("intr", True, None), "leave": ("intr", False, None), "sit": ("intr_particle", False, "down")}


def test_reasons_of_rejection():
    s = parsed("A lot of books saw Rome and many sad boys.")
    reasons = {t.text: r for t, r in X.verdicts(s, X.NOUN_RULES)}
    assert reasons["lot"] == "quantifier" and reasons["sad"] == "no_common_noun" and reasons["boys"] is None
    assert {t.text: r for t, r in X.verdicts(s, X.ADJECTIVE_RULES)}["many"] in ("no_modifier", "closed_class")


def test_forced_targets():
    s = parsed("The girl gave the boy a book.")
    got = X.forced_targets(s, [{"i": 2, "lemma": "Hand", "kind": "trans"}, {"i": 2}, {"i": 99}, {"i": None}])
    assert [(v.token.text, v.tag, v.kind, v.lemma) for v in got] == [("gave", "VBD", "trans", "hand")]


def test_forms_of_a_table_go_before_the_rules(spark):
    forms = spark.createDataFrame([("apple", "NN", "appel"), ("apple", "NNS", "appelz"), ("table", "NN", "tabel"), ("city", "NN", None)], "lemma string, tag string, form string")
    got = run(spark, 2, forms=forms, stages=("noun",))[0]
    by = {(s["lemma"], s["tag"]): s["new"] for s in [*got["g_swaps"], *got["b_swaps"]]}
    known = {("apple", "NN"): "appel", ("apple", "NNS"): "appelz", ("table", "NN"): "tabel", ("table", "NNS"): "tables", ("city", "NN"): "city", ("city", "NNS"): "cities"}
    assert by and all(v.lower() == known[k] for k, v in by.items())
    whole = run(spark, 2, forms=forms, stages=("noun",), fits=lambda old, new: new.startswith("appel"))[0]
    assert {s["new"].lower() for s in whole["g_swaps"]} <= {"appel", "appelz"}


def test_a_large_lexicon_travels_with_the_rows(spark, sf):
    from zipfloom.operators import lexicon as L
    from zipfloom.plans import corpus as C

    swaps = C._swaps(spark, sf)
    small, large = L.tag_lexicon(swaps), L.tag_lexicon(swaps, most=3)
    assert large.known is None and len(small.known) == large.table.count() > 3
    rows = lambda x: {tuple(r) for r in C.document_frames(spark, sf, x).collect()}
    assert rows(small) == rows(large)
    pairs = spark.createDataFrame([("s", i, "p", "The silent ladders near the violin avoided the baker.", "The silent ladders near the violin avoids the baker.") for i in range(4)],
                                  "subtask string, idx int, phenomenon string, sentence_good string, sentence_bad string")
    pool = spark.createDataFrame(POOL, "pool string, lemma string")

    def texts(x):
        known = x.known
        return sorted(r["good_freq"] or "" for r in S.generate(pairs, pool, lambda: P.RuleParser(known), lexicon=x).collect())

    assert texts(small) == texts(large) and all(texts(small))
