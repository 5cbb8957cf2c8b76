import random

import pytest

from zipfloom.operators import collocations as C

SCHEMA = "file string, line_no bigint, doc_id string, surface string, lemma string, pos string"


def stream(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def tok(text, file="f", doc="d", start=0):
    return [(file, start + i, doc, *[w.split("/")[0]] * 2, w.split("/")[1]) for i, w in enumerate(text.split())]


def model_runs(rows):
    out, run, prev = {}, {}, {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        f, d = r[0], r[2]
        if f in prev and prev[f] != d:
            run[f] += 1
        run.setdefault(f, 0)
        prev[f] = d
        out[f, r[1]] = run[f]
    return out


def model_markers(rows, window, wh):
    runs = model_runs(rows)
    tokens, docs, verb, gap, last = {}, {}, None, 0, None
    for f, n, _, _, lemma, pos in sorted(rows, key=lambda r: (r[0], r[1])):
        here = (f, runs[f, n])
        if here != last:
            verb, gap, last = None, 0, here
        if not lemma or lemma.startswith(("@@", "<")) or pos.startswith("y"):
            verb = None
        elif pos[:2] in C.VERB_PREFIXES:
            verb, gap = lemma, 0
        elif verb:
            if gap > window:
                verb = None
                continue
            m = "that" if lemma == "that" and pos == "cst" else f"wh:{lemma}" if lemma in wh else None
            if m:
                tokens[verb, m] = tokens.get((verb, m), 0) + 1
                docs.setdefault((verb, m), set()).add(here)
                verb = None
            else:
                gap += 1
    return {(*k, v, len(docs[k])) for k, v in tokens.items()}


def random_rows(seed):
    rng, rows = random.Random(seed), []
    words = ["say/vvd", "know/vv0", "that/cst", "that/dd1", "what/ddq", "who/pnqs", "loud/rr", "dog/nn1", ",/y", "<p>/x", "at/ii"]
    for f in "ab":
        doc = "d0"
        for n in range(120):
            if rng.random() < 0.08:
                doc = f"d{rng.randint(0, 3)}"
            w, p = rng.choice(words).split("/")
            rows.append((f, n, doc, w, w, p))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_scans_equal_a_sequential_model(spark, seed):
    rows = random_rows(seed)
    t = stream(spark, rows)
    for chunk in (7, 10_000):
        got = {(r["file"], r["line_no"]): r["run"] for r in C.document_runs(t, chunk).collect()}
        assert got == model_runs(rows)
    window = seed
    got = {tuple(r) for r in C.clause_markers(t, window).select("verb", "marker", "token_count", "doc_count").collect()}
    assert got == model_markers(rows, window, ("what", "who"))


@pytest.mark.parametrize("text,window,want", [
    ("say/vvd loudly/rr that/cst", 2, [("say", "that")]), ("say/vvd loudly/rr that/cst", 0, []), ("say/vvd ,/y that/cst", 2, []),
    ("say/vvd that/cst_dd1 what/ddq", 2, [("say", "wh:what")]),
])
def test_markers(spark, text, window, want):
    got = C.clause_markers(stream(spark, tok(text)), window).collect()
    assert [(r["verb"], r["marker"]) for r in got] == want


def test_focus_and_prepositions(spark):
    t = stream(spark, tok("look/vvd at/ii say/vvd that/cst look/vvd right/rr at/ii"))
    assert C.clause_markers(t, 2, focus=["look"]).count() == 0
    assert [(r["verb"], r["prep"], r["token_count"]) for r in C.verb_prepositions(t).collect()] == [("look", "at", 1)]


def test_sentences(spark):
    t = stream(spark, tok("I/pp saw/vvd it/pp ./y <p>/x Yes/uh !/y and/cc") + tok("more/rr", doc="e", start=50))
    got = {(r["doc_id"], r["n"]): r["text"] for r in C.sentences(t).collect()}
    assert got == {("d", 0): "I saw it.", ("d", 1): "Yes!", ("d", 2): "and", ("e", 0): "more"}


def test_inventories(spark):
    f = spark.createDataFrame([("run", "intr", None, None), ("run", "trans", None, None), ("sit", "intr", None, None), ("give", "ditrans", None, None)], "lemma string, kind string, prep string, particle string")
    pick = lambda df: sorted((r["lemma"], r["kind"]) for r in df.collect())
    assert pick(C.filter_frames(f, "intr", only="intr")) == [("sit", "intr")]
    assert pick(C.filter_frames(f, "trans", only="trans")) == [("run", "trans")]  # nothing is left, so the restriction is ignored
    assert pick(C.prune(f, f.where("lemma = 'sit'"))) == [("give", "ditrans"), ("run", "intr"), ("run", "trans")]
    new = spark.createDataFrame([("sit", "intr_pp", "on", None), ("fly", "intr", None, None)], "lemma string, kind string, prep string, particle string")
    assert C.augment(f, new).count() == 5 and C.augment(f, new, create=True).count() == 6 and C.augment(f, f).count() == 4
    lex = spark.createDataFrame([("run", "intr"), ("give", "intr")], "lemma string, kind string")
    assert pick(C.veto_transitive(f, lex)) == [("give", "intr"), ("run", "intr"), ("sit", "intr")]
    counts = spark.createDataFrame([("run", "at", 4, 4), ("sit", "on", 9, 5)], "verb string, prep string, token_count bigint, doc_count bigint")
    status = {r["lemma"]: r["status"] for r in C.attestation(spark.createDataFrame([("run", "at"), ("sit", "on"), ("go", "to")], "lemma string, prep string"), counts, 5).collect()}
    assert status == {"run": "low", "sit": "ok", "go": "unattested"}


def test_domains_and_dominance(spark):
    senses = spark.createDataFrame([("nurse", "s1"), ("city", "s2"), ("x", "s3")], "lemma string, synset string")
    edges = spark.createDataFrame([("s1", "person")], "synset string, above string")
    domains = spark.createDataFrame([("person", "person"), ("s2", "location")], "synset string, domain string")
    got = {r["lemma"]: (r["is_person"], r["is_location"]) for r in C.domain_flags(senses, edges, domains).collect()}
    assert got == {"nurse": (True, False), "city": (False, True), "x": (False, False)}
    rows = [("eating", 1, 2, 0, 0, 3.0, False, True), ("dog", 1, 7, 0, 0, 5.0, False, False), ("talk", 4, 6, 0, 0, 5.0, True, False)]
    df = spark.createDataFrame(rows, "lemma string, v int, n int, a int, r int, zipf double, only_excluded boolean, base_is_verb boolean")
    assert [r["lemma"] for r in df.where(C.dominant("noun_strict")).collect()] == ["dog"]
    assert C.verb_choices(df).count() == 3
    pool = spark.createDataFrame([("a", 2.0), ("b", 3.1), ("c", 3.2)], "lemma string, z double")
    got, bound = C.relaxed_window(pool, "z", 1.0, 2.5, need=2)
    assert bound == pytest.approx(3.4) and got.count() == 3


def test_empty_streams(spark):
    t = spark.createDataFrame([], SCHEMA)
    assert C.clause_markers(t).count() == C.verb_prepositions(t).count() == C.sentences(t).count() == 0


def test_texts_beyond_a_hundred_thousand_tokens(spark, tmp_path):
    from compare import connect, differences

    from zipfloom.plans import corpus

    long = " ".join(["it was noted that they say what follows ."] * 15_000)
    docs = [(1, "a", long), (2, "a", "He says that she noted up , who said because . " * 40), (3, "b", "noted by it ."), (4, "a", None)]
    spark.createDataFrame(docs, "doc_id bigint, source string, text string").coalesce(1).write.parquet(str(tmp_path / "x"))
    next((tmp_path / "x").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    for f in (tmp_path / "x").iterdir():
        f.unlink()
    (tmp_path / "x").rmdir()
    con = connect(str(tmp_path))
    for q in ("w1_clause_markers", "a15_verb_counts", "w2_verb_prepositions", "w3_sentences"):
        assert differences(corpus.QUERIES[q], corpus.ORACLES[q], spark, str(tmp_path), con) == ([], []), q
