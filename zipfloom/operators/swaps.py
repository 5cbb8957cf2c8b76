"""The swap engine: pairs of sentences with words replaced out of frequency pools.

Three steps: a map over pairs parses both sides, once, and emits their tokens
and aligned slots; slots draw candidates from their pools by an equi-join on a
seeded place; a map over pairs realises the texts.  Slots that no candidate
fits go through their whole pool in a seeded order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.inflection import adjective_surface, inflect
from ..functions.wordlists import CONTROL_POOLS, control_adjective_pools, raising_verb_pool
from ..runtime import materialise
from . import choice
from . import parsing as P
from . import targets as X
from .lexicon import OWN, Lexicon, own_entries

#: Candidates that each slot draws at first; the first that fits is taken.
TRIES = 8

_SLOT = "struct<stage:string,g_key:string,b_key:string,g_pool:string,b_pool:string,g:int,b:int,g_tag:string,b_tag:string,lemma:string>"
#: Tokens and candidates travel as strings cut at this sign, which costs far less than structs in Python.
CUT = "\x1f"
_TOKENS = "array<string>"
_FOUND = (
    f"subtask string, idx int, phenomenon string, good string, bad string, g_tokens {_TOKENS}, b_tokens {_TOKENS}, "
    f"slots array<{_SLOT}>, reasons array<string>"
)
_SWAP = "struct<i:int,old:string,new:string,tag:string,lemma:string,pos:string>"
_FORMS = "map<string,string>"
_PICKS = "array<string>"
RECORD = (
    "phenomenon string, subtask string, idx int, good_original string, bad_original string, good_freq string, bad_freq string, "
    f"g_swaps array<{_SWAP}>, b_swaps array<{_SWAP}>, swap_failed_reason string"
)


def _pool_of(kind: str, pools: set[str], prep: str | None = None, particle: str | None = None) -> str | None:
    """The pool of a verb frame; intransitives may fall back on transitives.

    The frame's own preposition and particle come first; another preposition's
    verb may follow, as the sentence keeps its own.
    """
    for k in [kind, *(["trans"] if kind == "intr" else [])]:
        if k.endswith("_particle"):
            names = [f"{k}+{particle}"] if particle else []
        else:
            names = [f"{k}:{prep}"] if prep else []
        for name in [*names, k]:
            if f"verb:{name}" in pools:
                return f"verb:{name}"
    return None


def _verb_pool(v: X.VerbTarget, kind: str, pools: set[str]) -> str | None:
    """The pool of a verb target: the one fixed pool where it is given, else by its clause's marker where it embeds one, else by its frame."""
    if "verb:*" in pools:
        return "verb:*"
    if v.clause:
        for name in [*([f"verb:clause:{v.wh}"] if v.wh else []), "verb:clause"]:
            if name in pools:
                return name
    return _pool_of(kind, pools, v.prep.low if v.prep else None, v.particle.low if v.particle else None)


#: What a pair with open slots carries on to its second turn.
_OPEN = f"g_tokens {_TOKENS}, b_tokens {_TOKENS}, slots array<{_SLOT}>, reasons array<string>, picks {_PICKS}, forms array<string>, open array<struct<stage:string,key:string,pool:string>>"


def find_slots(good: str, bad: str, parser: P.Parser, pools: set[str], phenomenon: str, subtask: str, stages: set[str]) -> tuple[list[dict], list[str]]:
    """Aligned slots of a pair and the reasons why a stage has none.

    Indices are those of the one parse, so no stage shifts another's.
    """
    return aligned_slots(P.Sentence(parser.parse(good)), P.Sentence(parser.parse(bad)), pools, phenomenon, subtask, stages)


def aligned_slots(g: P.Sentence, b: P.Sentence, pools: set[str], phenomenon: str, subtask: str, stages: set[str]) -> tuple[list[dict], list[str]]:
    """:func:`find_slots` of parsed sentences."""
    slots, reasons = [], []

    def add(stage: str, pool: str | None, x: P.Token, y: P.Token, gt: str, bt: str, key: str, lemma: str, b_pool: str | None = None) -> bool:
        """``b_pool``: the bad side's own pool, from which it draws a lemma of its own."""
        own = b_pool is not None and b_pool != pool
        if pool not in pools or (own and b_pool not in pools):
            return False
        slots.append({"stage": stage, "g_key": key, "b_key": f"{key}/{b_pool}" if own else key, "g_pool": pool, "b_pool": b_pool if own else pool,
                      "g": x.i, "b": y.i, "g_tag": gt, "b_tag": bt, "lemma": lemma})
        return True

    def stage(name: str, gs: list, bs: list, of: Callable, zip_rest: bool = False) -> None:
        if not gs and not bs:
            reasons.append(f"{name}_no_candidates")
            return
        pairs = P.align([of(x)[:2] for x in gs], [of(x)[:2] for x in bs], zip_rest)
        if not pairs:
            reasons.append(f"{name}_no_matches")
            return
        before = len(slots)
        for i, j in pairs:
            if not add(*of(gs[i])[2](gs[i], bs[j])):
                del slots[before:]  # a stage commits as a whole
                reasons.append(f"{name}_swap_failed")
                return

    control = phenomenon == "control_raising"
    if "verb" in stages and phenomenon != "irregular_forms":
        head = (X.passive_head(g), X.passive_head(b)) if subtask in ("passive_1", "passive_2") else (None, None)
        if all(head):
            x, y = head
            if not add("verb", _pool_of("trans", pools), x, y, x.tag, y.tag, x.lemma.lower(), x.lemma.lower()):
                reasons.append("verb_swap_failed")
        else:

            def verb_slot(x: X.VerbTarget, y: X.VerbTarget) -> tuple:
                if control and x.lemma != y.lemma:  # the verbs that the contrast is about
                    return "verb", raising_verb_pool(subtask), x.token, y.token, x.tag, y.tag, x.lemma, x.lemma, _pool_of("control", pools) or _pool_of("trans", pools)
                kind, _ = X.forced_frame(phenomenon, subtask, "good", x.kind)
                bad_kind, _ = X.forced_frame(phenomenon, subtask, "bad", y.kind)
                if phenomenon == "argument_structure" and bad_kind != kind:
                    return "verb", _verb_pool(x, kind, pools), x.token, y.token, x.tag, y.tag, x.lemma, x.lemma, _verb_pool(y, bad_kind, pools)
                return "verb", _verb_pool(x, kind, pools), x.token, y.token, x.tag, y.tag, x.lemma, x.lemma

            # a particle verb without a pool of its particle stays, and the others of its sentence are swapped
            gs, bs = ([v for v in X.verb_targets(s) if v.particle is None or _verb_pool(v, v.kind, pools)] for s in (g, b))
            stage("verb", gs, bs, lambda v: (v.lemma, v.token.text, verb_slot), zip_rest=True)
    taken = {s["g"] for s in slots}, {s["b"] for s in slots}
    if "noun" in stages:
        bound_g, bound_b = X.reflexive_subjects(g), X.reflexive_subjects(b)

        def noun_slot(x: P.Token, y: P.Token) -> tuple:
            gender, animate = bound_g.get(x.i) or bound_b.get(y.i) or (None, False)
            person = animate or X.is_ex_compound(g, x)
            pool = f"noun:{gender}" if gender and f"noun:{gender}" in pools else "noun:person" if person else "noun"
            return "noun", pool, x, y, X.noun_tag(x), X.noun_tag(y), f"{x.lemma.lower()}/{pool}", x.lemma.lower()

        gs = [t for t in X.noun_targets(g, bound_g) if t.i not in taken[0]]
        bs = [t for t in X.noun_targets(b, bound_b) if t.i not in taken[1]]
        genders: dict[str, set] = {}
        for ts, bound in ((gs, bound_g), (bs, bound_b)):
            for t in ts:
                if t.i in bound and bound[t.i][0]:
                    genders.setdefault(t.lemma.lower(), set()).add(bound[t.i][0])
        if any(len(x) > 1 for x in genders.values()):  # one replacement can't have two genders
            reasons.append("noun_swap_failed")
        else:
            stage("noun", gs, bs, lambda t: (t.lemma.lower(), t.text, noun_slot))
    if "adj" in stages and phenomenon != "irregular_forms":
        good_pool, bad_pool = control_adjective_pools(subtask) if control else ("adj", "adj")
        tag = lambda t: t.tag if t.tag.startswith("JJ") else "JJ"

        def adj_slot(x: P.Token, y: P.Token) -> tuple:
            return "adj", good_pool, x, y, tag(x), tag(y), x.lemma.lower(), x.lemma.lower(), bad_pool

        find = lambda s: X.adjective_targets(s) + (X.control_adjectives(s) if control else [])
        stage("adj", find(g), find(b), lambda t: (t.lemma.lower(), t.text, adj_slot), zip_rest=control)
    return slots, reasons


def _sentence(tokens) -> P.Sentence:
    """Carried tokens, without their heads, which realising doesn't ask for."""
    cut = (t.split(CUT) for t in tokens)
    return P.Sentence([P.Token(i, text, lemma, "", tag) for i, (text, lemma, tag) in enumerate(cut)])


def realise_pair(sides: dict[str, P.Sentence], slots: list, picks: dict[tuple[str, str], list[tuple[str, dict]]], reasons: list[str], fits=None, unresolved: list | None = None) -> tuple:
    """Texts and swaps of both sides: one lemma per (stage, key), the same on both sides.

    ``picks``: candidate lemmas with the forms (tag -> form) that an inflection
    table gives them; rules make the others.  ``fits(old, new)`` may reject a
    form, as for equal numbers of tokens.  ``unresolved`` takes the (stage, key,
    pool) that no candidate fits.
    """
    words = {k: [t.text for t in s.tokens] for k, s in sides.items()}
    swaps: dict[str, list] = {"g": [], "b": []}
    reasons = list(reasons)

    def form(stage: str, lemma: str, forms: dict, tag: str, old: P.Token) -> str | None:
        table = {(lemma, t): f for t, f in forms.items()}
        return adjective_surface(old.lemma.lower(), tag, lemma, table) if stage == "adj" else inflect(lemma, tag, table)

    for stage in ("verb", "noun", "adj"):
        own = [s for s in slots if s["stage"] == stage]
        chosen: dict[str, tuple[str, dict]] = {}
        failed = False
        for key in sorted({s[f"{k}_key"] for s in own for k in "gb"}):
            group = [(s, k) for s in own for k in "gb" if s[f"{k}_key"] == key]
            for lemma, known in picks.get((stage, key), []):
                forms = [(form(stage, lemma, known, s[f"{k}_tag"], sides[k].tokens[s[k]]), sides[k].tokens[s[k]].text) for s, k in group]
                if lemma != group[0][0]["lemma"] and all(f and (fits is None or fits(old, f)) for f, old in forms):
                    chosen[key] = lemma, known
                    break
            if key not in chosen:
                failed = True
                if unresolved is not None:
                    unresolved.append((stage, key, group[0][0][f"{group[0][1]}_pool"]))
        if failed:
            reasons.append(f"{stage}_no_token_match" if fits is not None else f"{stage}_swap_failed")
            continue
        for s in own:
            for k in "gb":
                old, tag = sides[k].tokens[s[k]], s[f"{k}_tag"]
                lemma, known = chosen[s[f"{k}_key"]]
                new = form(stage, lemma, known, tag, old)
                if stage == "noun":
                    was = P.place_noun(sides[k], old, new, words[k])
                else:
                    was = old.text
                    new = P.cased(old.text, new) if stage == "verb" else new
                    words[k][s[k]] = new
                swaps[k].append({"i": s[k], "old": was, "new": new, "tag": tag, "lemma": lemma, "pos": {"adj": "adjective"}.get(stage, stage)})
    if not swaps["g"]:
        return None, None, [], [], "|".join(dict.fromkeys(reasons)) or "no_swap"
    for w in words.values():
        P.agree(w)
    text = {k: P.realise(w) for k, w in words.items()}
    if text["g"] == text["b"]:
        return None, None, [], [], "pair_collapsed"
    order = lambda x: sorted(x, key=lambda s: (s["i"], s["pos"]))
    return text["g"], text["b"], order(swaps["g"]), order(swaps["b"]), None


def generate(
    pairs: DataFrame,
    pool: DataFrame,
    parser: Callable[[], P.Parser],
    *,
    seed: int = 0,
    stages: tuple[str, ...] = ("verb", "noun", "adj"),
    fits: Callable[[str, str], bool] | None = None,
    forms: DataFrame | None = None,
    lexicon: Lexicon | None = None,
) -> DataFrame:
    """Swapped pairs with their traces, one row per (subtask, idx) of ``pairs``.

    ``pairs``: ``subtask, idx, phenomenon, sentence_good, sentence_bad``, each key
    once.  ``pool``: ``pool, lemma``, where pool is ``noun``, ``noun:person``,
    ``noun:<gender>``, ``adj``, ``verb:<kind>``, ``verb:<kind>:<prep>``, ``verb:<kind>+<particle>``,
    ``verb:clause``, ``verb:clause:<wh word>``, ``verb:*`` (all verbs, whatever their frame) or one of :func:`control_pools`.  Equal seeds give equal
    results, in any partitioning.  A pair with a null side is a failure
    (``no_swap``).  A stage fails for want of a word only if no lemma of the
    pool fits.  ``forms``: an inflection table ``lemma, tag, form``, which goes
    before the rules and travels with the candidates.  ``lexicon``: the
    parser's, where it may be too large for each worker.
    """
    pool = pool.select("pool", "lemma").distinct()
    if forms is not None:
        one = forms.where("lemma is not null and tag is not null and form is not null").groupBy("lemma", "tag").agg(F.min("form").alias("form"))
        by_lemma = one.groupBy("lemma").agg(F.map_from_entries(F.collect_list(F.struct("tag", "form"))).alias("forms"))
        pool = pool.join(by_lemma, "lemma", "left")
    else:
        pool = pool.withColumn("forms", F.lit(None).cast(_FORMS))
    pool = materialise(pool.select("pool", "lemma", "forms"), "pool")  # read several times below
    # the names of the pools, not their lemmas: a handful
    names = {r["pool"] for r in pool.select("pool").distinct().collect()}
    wanted = set(stages)

    def slots(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = parser()
        for pdf in parts:
            rows = []
            for r in pdf.itertuples(index=False):
                good, bad = r.sentence_good, r.sentence_bad
                carried: list[list] = [[], []]
                found: tuple[list, list] = [], []
                if good and bad:
                    own_entries(p, getattr(r, "own", None))
                    g, b = P.Sentence(p.parse(good)), P.Sentence(p.parse(bad))
                    carried = [[f"{t.text}{CUT}{t.lemma}{CUT}{t.tag}" for t in s.tokens] for s in (g, b)]
                    found = aligned_slots(g, b, names, r.phenomenon or "", r.subtask or "", wanted)
                rows.append((r.subtask, r.idx, r.phenomenon, good, bad, *carried, *found))
            yield pd.DataFrame(rows, columns=["subtask", "idx", "phenomenon", "good", "bad", "g_tokens", "b_tokens", "slots", "reasons"])

    # parsing costs more than the bytes suggest, so the rows are spread by number, not by size
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = pairs.select("subtask", F.col("idx").cast("int"), "phenomenon", "sentence_good", "sentence_bad")
    if lexicon is not None:
        src = lexicon.attach(src, "sentence_good", "sentence_bad").withColumnRenamed(OWN, "own")
    src = src.repartition(n, "subtask", "idx")
    found = materialise(src.mapInPandas(slots, _FOUND), "slots")  # read by the draws and by the join
    side = lambda k: F.struct(F.col("s.stage").alias("stage"), F.col(f"s.{k}_key").alias("key"), F.col(f"s.{k}_pool").alias("pool"))
    each = found.select("subtask", "idx", F.explode("slots").alias("s")).select("subtask", "idx", F.explode(F.array(side("g"), side("b"))).alias("x"))
    keys = each.select("subtask", "idx", "x.*").distinct()
    drawn = choice.pick_uniform(keys, pool, ["pool"], ["subtask", "idx", "stage", "key"], seed, TRIES)
    one = F.concat_ws(CUT, "stage", "key", F.lpad(F.col("attempt").cast("string"), 3, "0"), "lemma")
    held = F.transform(F.map_entries("forms"), lambda e: F.concat_ws(CUT, "lemma", e["key"], e["value"]))
    picks = drawn.groupBy("subtask", "idx").agg(
        F.array_sort(F.collect_list(one)).alias("picks"),
        (F.array_distinct(F.flatten(F.collect_list(held))) if forms is not None else F.lit(None).cast("array<string>")).alias("forms"),
    )
    cond = [found["subtask"].eqNullSafe(picks["subtask"]), found["idx"].eqNullSafe(picks["idx"])]
    ready = found.join(picks, cond, "left").select(found["*"], picks["picks"], picks["forms"]).repartition(n, "subtask", "idx")

    record = [c.split()[0] for c in RECORD.split(", ") if not c.startswith(("new", "old"))][:10]

    def texts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for r in pdf.itertuples(index=False):
                got, kept = (None, None, [], [], "no_swap"), (None, None, None, None, None, None, [])
                if r.good and r.bad:
                    drawn, unresolved = {}, []
                    picks = list(r.picks) if r.picks is not None else []
                    known: dict[str, dict] = {}
                    for lemma, tag, form in (x.split(CUT) for x in (r.forms if r.forms is not None else [])):
                        known.setdefault(lemma, {})[tag] = form
                    for x in picks:
                        stage, key, _, lemma = x.split(CUT)
                        drawn.setdefault((stage, key), []).append((lemma, known.get(lemma, {})))
                    for x in r.more if r.more is not None else []:
                        drawn.setdefault((x["stage"], x["key"]), []).extend((y["lemma"], _map(y["forms"])) for y in x["lemmas"])
                    sides = {"g": _sentence(r.g_tokens), "b": _sentence(r.b_tokens)}
                    got = realise_pair(sides, list(r.slots), drawn, list(r.reasons), fits, unresolved)
                    if unresolved and r.more is None:
                        kept = list(r.g_tokens), list(r.b_tokens), list(r.slots), list(r.reasons), picks, None if r.forms is None else list(r.forms), unresolved
                rows.append((r.phenomenon, r.subtask, r.idx, r.good, r.bad, *got, *kept))
            yield pd.DataFrame(rows, columns=[*record, "g_tokens", "b_tokens", "slots", "reasons", "picks", "forms", "open"])

    rest = f"array<struct<stage:string,key:string,lemmas:array<struct<lemma:string,forms:{_FORMS}>>>>"
    first = materialise(ready.withColumn("more", F.lit(None).cast(rest)).mapInPandas(texts, f"{RECORD}, {_OPEN}"), "swapped")
    unresolved = first.where(F.size("open") > 0)
    if unresolved.isEmpty():
        return first.select(*record)
    keys = unresolved.select("subtask", "idx", F.explode("open").alias("o")).select("subtask", "idx", "o.*")
    whole = choice.whole_pool(keys, pool, ["pool"], ["subtask", "idx", "stage", "key"], seed)
    own = [F.col("subtask").alias("_subtask"), F.col("idx").alias("_idx")]
    more = whole.groupBy(*own).agg(F.collect_list(F.struct("stage", "key", "lemmas")).alias("more"))
    cond = F.col("subtask").eqNullSafe(F.col("_subtask")) & F.col("idx").eqNullSafe(F.col("_idx"))
    again = unresolved.join(more, cond).select(
        "subtask", "idx", "phenomenon", F.col("good_original").alias("good"), F.col("bad_original").alias("bad"),
        "g_tokens", "b_tokens", "slots", "reasons", "picks", "forms", "more",
    )
    done = again.repartition(n, "subtask", "idx").mapInPandas(texts, f"{RECORD}, {_OPEN}")
    return first.where(F.size("open") == 0).select(*record).unionByName(done.select(*record))


def _map(value) -> dict:
    """A map as Arrow gives it to pandas: a dict, pairs or None."""
    return {} if value is None else dict(value)


def control_pools(spark) -> DataFrame:
    """``pool, lemma`` of the lists that control and raising subtasks draw from."""
    rows = [(k, w) for k, words in CONTROL_POOLS.items() for w in words]
    return spark.createDataFrame(rows, "pool string, lemma string")


def normal_targets(spec: str | list[str] | None) -> set[str]:
    """Stages that a specification names: nouns, adjectives, verbs, both, all."""
    words = [spec] if isinstance(spec, str) else list(spec or [])
    out: set[str] = set()
    for w in (str(x).strip().lower() for x in words if x):
        for stage, names in (("noun", ("noun", "nouns")), ("adj", ("adj", "adjective", "adjectives")), ("verb", ("verb", "verbs"))):
            if w in names or w in ("both", "all"):
                out.add(stage)
    return out


def noun_pools(lemmas: DataFrame, requirement: str | None, classes: DataFrame) -> DataFrame:
    """Noun lemmas that fit a quantifier: COUNT keeps countable ones, MASS those that may be mass.

    ``lemmas``: lemma; ``classes``: lemma, cls.
    """
    from ..functions.inflection import countable
    from ..functions.wordlists import MASS_NOUNS

    known = lemmas.join(classes, "lemma", "left")
    if requirement == "MASS":
        return known.where(F.col("cls").isin("MASS", "FLEX")).select("lemma")
    if requirement != "COUNT":
        return known.select("lemma")
    ok = F.pandas_udf(lambda w, c: pd.Series([countable(a, b) for a, b in zip(w, c)]), "boolean")
    return known.where(~F.col("lemma").isin(MASS_NOUNS)).where(ok("lemma", "cls")).select("lemma")


def as_records(generated: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Generated pairs in the shape of ``generated_pair``: ``meta`` with traces and aggregates."""
    from .reports import swapped_words, zipf_aggregates

    key = F.xxhash64("subtask", "idx")
    traced = generated.withColumn("record_id", key).withColumn(
        "meta", F.struct("g_swaps", "b_swaps", "swap_failed_reason")
    )
    stats = zipf_aggregates(swapped_words(traced), lexicon)
    one = F.struct("role", F.struct(*[F.col(c).cast(k).alias(c) for c, k in (("n", "int"), ("oov_count", "int"), ("mean", "double"), ("median", "double"), ("min", "double"))]))
    maps = stats.groupBy("record_id").agg(F.map_from_entries(F.collect_list(one)).alias("zipf_swapped_position_aggregates"))
    got = traced.join(maps, "record_id", "left")
    meta = F.struct("g_swaps", "b_swaps", "swap_failed_reason", "zipf_swapped_position_aggregates")
    return got.select("phenomenon", "subtask", "idx", "good_original", "bad_original", "good_freq", "bad_freq", meta.alias("meta"))
