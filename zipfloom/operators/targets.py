"""Which tokens of a parsed sentence may be swapped, and why the others may not.

Every token has features; a kind of target is a table of named rules
over features.  The first rule that a token breaks is its reason, so a caller
sees the rejected tokens too.  A verb's frame is read off a census of its
children's roles.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

from ..functions.inflection import singularise
from .parsing import PARTICLES, REFLEXIVES, SUBJECT, Sentence, Token

# Words and labels that the rules name.
PARTITIVES = {"lot", "lots", "bunch", "number", "couple", "plenty"}
DEMONSTRATIVES = {"a", "an", "the", "this", "that", "these", "those"}
ARTICLES = {"a", "an", "the", "some"}
PLAIN_QUANTITIES = {"many", "most", "much", "few", "several"}
CLAUSE_OPENERS = {"that", "whether", "if", "what", "who", "which", "whom"}
PLURALS = set("men women people children teeth feet geese mice lice oxen indices matrices vertices criteria phenomena data media dice cacti alumni".split())
LIGHT_VERBS = {"be", "have", "do"}
EXPLETIVE = {"expl", "csubj", "csubjpass", *SUBJECT}

Bound = dict[int, tuple[str | None, bool]]


class Rule(NamedTuple):
    """A token keeps the rule if it has one of ``need`` (if any) and none of ``bar``, or one of ``unless``."""

    reason: str
    need: frozenset[str] = frozenset()
    bar: frozenset[str] = frozenset()
    unless: frozenset[str] = frozenset()

    def kept(self, has: Callable[[str], bool]) -> bool:
        if self.need and not any(map(has, self.need)):
            return any(map(has, self.unless))
        return not any(map(has, self.bar)) or any(map(has, self.unless))


def _rule(reason: str, need: str = "", bar: str = "", unless: str = "") -> Rule:
    return Rule(reason, *(frozenset(x.split()) for x in (need, bar, unless)))


NOUN_RULES = (
    _rule("no_common_noun", need="common_noun listed_plural"),
    _rule("no_word", need="word"),
    _rule("named", bar="named"),
    _rule("predicate", bar="dep:ROOT dep:relcl has_subject"),
    _rule("quantifier", bar="partitive"),
    _rule("proper", bar="properish", unless="common_plural"),
    _rule("no_phrase", need="chunk subject bound"),
)
ADJECTIVE_RULES = (
    _rule("no_modifier", need="dep:amod dep:compound"),
    _rule("closed_class", bar="pos:DET pos:PRON pos:PROPN pos:NUM quantity"),
    _rule("no_word", need="word"),
    _rule("named", bar="entity opening_name"),
    _rule("no_noun_near", need="by_common_noun"),
)
CONTROL_RULES = (
    _rule("no_adjective", need="pos:ADJ pos:ADV"),
    _rule("no_predicate", need="dep:acomp dep:advmod"),
    _rule("not_under_be", need="under_be"),
    _rule("no_infinitive", need="to_infinitive"),
    _rule("before_there", bar="before_there"),
)


def _infinitive(s: Sentence, t: Token | None) -> bool:
    return t is not None and any(k.low == "to" for k in s.children(t, "aux", "mark"))


def reflexive_subjects(s: Sentence) -> Bound:
    """Nominal subjects that a reflexive binds, one or two heads up: index -> (gender, animate)."""
    out: Bound = {}
    for p in (t for t in s.tokens if t.pos == "PRON" and t.low in REFLEXIVES):
        near = s.at(p.head)
        heads = {h.i: h for h in (near, s.at(near.head) if near else None) if h}
        for subject in (k for h in heads.values() for k in s.children(h, *SUBJECT) if k.pos in ("NOUN", "PROPN")):
            out[subject.i] = (REFLEXIVES[p.low], p.low != "itself")
    return out


def is_ex_compound(s: Sentence, t: Token) -> bool:
    return [x.low for x in s.tokens[max(0, t.i - 2) : t.i]] == ["ex", "-"]


#: Features beside ``pos:``, ``dep:`` and ``bound``: name and test.
_FEATURES: dict[str, Callable[[Sentence, Token], object]] = dict((
    ("common_noun", lambda s, t: t.pos == "NOUN" and t.tag in ("NN", "NNS")),
    ("listed_plural", lambda s, t: t.low in PLURALS),
    ("common_plural", lambda s, t: t.low in PLURALS or t.tag in ("NNS", "NNPS") and singularise(t.text) is not None),
    ("word", lambda s, t: t.text.isalpha() and len(t.text) > 2),
    ("entity", lambda s, t: t.ent),
    ("named", lambda s, t: t.ent and t.text[:1].isupper()),
    ("chunk", lambda s, t: t.chunk),
    ("subject", lambda s, t: t.dep in SUBJECT),
    ("has_subject", lambda s, t: s.children(t, *SUBJECT)),
    ("partitive", lambda s, t: t.low in PARTITIVES and s.word(t.i + 1) == "of" and (t.low == "lots" or s.word(t.i - 1) in DEMONSTRATIVES)),
    ("quantity", lambda s, t: t.low in PLAIN_QUANTITIES),
    ("opening_name", lambda s, t: t.i == 0 and t.text[:1].isupper() and t.lemma == t.text),
    ("by_common_noun", lambda s, t: (h := s.at(t.head)) and h.pos == "NOUN" and h.tag in ("NN", "NNS") and h.dep != "ROOT" and abs(h.i - t.i) <= 2),
    ("under_be", lambda s, t: (h := s.at(t.head)) and h.lemma.lower() == "be"),
    ("to_infinitive", lambda s, t: _infinitive(s, s.at(t.head)) or any(_infinitive(s, k) for h in (s.at(t.head), t) if h for k in s.children(h, "xcomp"))),
    ("before_there", lambda s, t: any(x.low == "there" and x.dep in EXPLETIVE for x in s.tokens) and not any(x.low == "there" and x.dep in EXPLETIVE for x in s.tokens[: t.i])),
    ("properish", lambda s, t: t.proper or t.text[:1].isupper() and (t.lemma == t.text or not _articled(s, t))),
))


def _articled(s: Sentence, t: Token) -> bool:
    return s.word(t.i - 1) in ARTICLES or (t.i > 0 and s.tokens[t.i - 1].pos == "DET")


def features(s: Sentence, t: Token, bound: Bound) -> Callable[[str], bool]:
    """Does the token have a feature?  Asked for by name, as most tokens break the first rule."""
    known: dict[str, bool] = {f"pos:{t.pos}": True, f"dep:{t.dep}": True, "bound": t.i in bound}

    def has(name: str) -> bool:
        got = known.get(name)
        if got is None:
            got = known[name] = name[3] != ":" and bool(_FEATURES[name](s, t))
        return got

    return has


def verdicts(s: Sentence, rules: tuple[Rule, ...], bound: Bound | None = None) -> list[tuple[Token, str | None]]:
    """Every token with the reason that rejects it, or None."""
    bound = reflexive_subjects(s) if bound is None else bound
    out = []
    for t in s.tokens:
        has = features(s, t, bound)
        out.append((t, next((r.reason for r in rules if not r.kept(has)), None)))
    return out


def _accepted(s: Sentence, rules: tuple[Rule, ...], bound: Bound | None = None) -> list[Token]:
    return [t for t, reason in verdicts(s, rules, bound) if reason is None]


def noun_targets(s: Sentence, bound: Bound | None = None) -> list[Token]:
    """Common nouns that may be swapped, left to right."""
    return _accepted(s, NOUN_RULES, bound)


def adjective_targets(s: Sentence) -> list[Token]:
    """Attributive adjectives close to a common noun."""
    return _accepted(s, ADJECTIVE_RULES, {})


def control_adjectives(s: Sentence) -> list[Token]:
    """Predicate adjectives under ``be`` with a to-infinitive; after ``there``, if it is expletive."""
    return _accepted(s, CONTROL_RULES, {})


def noun_tag(t: Token) -> str:
    """The number that a noun's replacement takes."""
    by_tag = {"NNS": "NNS", "NNPS": "NNS", "NN": "NN", "NNP": "NN"}
    return by_tag.get(t.tag) or ("NNS" if t.low.endswith("s") else "NN")


# ---- verbs -----------------------------------------------------------------------------


class Frame(NamedTuple):
    kind: str
    prep: Token | None = None
    particle: Token | None = None


#: The role of a verb's child: the first whose test holds.
_ROLES: tuple[tuple[str, Callable[[Sentence, Token], object]], ...] = (
    ("particle", lambda s, k: k.dep == "prt"),
    ("particle", lambda s, k: k.dep == "advmod" and k.low in PARTICLES and k.pos in ("ADV", "PART", "ADP", "ADJ")),
    ("particle", lambda s, k: k.dep == "prep" and k.low in PARTICLES and not s.children(k, "pobj")),
    ("clausal prep", lambda s, k: k.dep == "prep" and s.children(k, "pcomp")),
    ("prep", lambda s, k: k.dep == "prep"),
    ("indirect", lambda s, k: k.dep in ("iobj", "dative")),
    ("object", lambda s, k: k.dep == "obj" or k.dep == "dobj" and k.low != "that"),
)
#: (object, indirect) -> the frame without and with a preposition; None: no frame.
_KINDS = {(0, 0): ("intr", "intr_pp"), (1, 0): ("trans", "ditrans_pp"), (1, 1): ("ditrans", "ditrans_pp")}


def census(s: Sentence, t: Token) -> dict[str, list[Token]]:
    """A verb's children by role."""
    out: dict[str, list[Token]] = {}
    for k in s.children(t):
        role = next((r for r, test in _ROLES if test(s, k)), None)
        if role:
            out.setdefault(role, []).append(k)
    # a preposition that governs a clause counts only where it is the only one
    if "clausal prep" in out:
        rest = out.pop("clausal prep")
        if not out.get("prep"):
            out["prep"] = rest
    return out


def sentence_frame(s: Sentence, t: Token) -> Frame | None:
    """The frame of a verb in its sentence, or None if a role is filled twice or roles clash."""
    found = census(s, t)
    if any(len(v) > 1 for v in found.values()) or found.keys() >= {"prep", "particle"}:
        return None
    kinds = _KINDS.get((len(found.get("object", ())), len(found.get("indirect", ()))))
    if kinds is None:
        return None
    prep = found["prep"][0] if "prep" in found else _following(s, t, 2, lambda x: x.low == "about")
    particle = found["particle"][0] if "particle" in found else None
    return Frame(kinds[prep is not None] + ("_particle" if particle else ""), prep, particle)


def _following(s: Sentence, t: Token, reach: int, wanted: Callable[[Token], bool]) -> Token | None:
    """The first token after the verb that is no adverb, if it is a wanted preposition."""
    near = next((x for x in s.tokens[t.i + 1 : t.i + 1 + reach] if x.pos not in ("ADV", "PART")), None)
    return near if near is not None and near.pos == "ADP" and wanted(near) else None


def corpus_frame(s: Sentence, t: Token) -> tuple[str, str | None] | None:
    """The corpus miner's frame: prepositions need an object, particles don't count."""
    found = {r: s.children(t, *deps) for r, deps in (("object", ("dobj", "obj")), ("indirect", ("iobj",)))}
    found["prep"] = [p for p in s.children(t, "prep") if s.children(p, "pobj")]
    if any(len(v) > 1 for v in found.values()):
        return None
    plain, with_prep = _KINDS.get((len(found["object"]), len(found["indirect"])), _KINDS[0, 0])
    return (with_prep, found["prep"][0].low) if found["prep"] else (plain, None)


@dataclass
class VerbTarget:
    token: Token
    tag: str
    kind: str
    lemma: str
    prep: Token | None = None
    particle: Token | None = None
    clause: bool = False
    that: bool = False
    wh: str | None = None


#: Participles that a parser takes for another word: part of speech, dependency, test, frame.
_PARTICIPLES: tuple[tuple[str, str, Callable[[Sentence, Token, Token | None, Token | None], object], str], ...] = (
    ("ADJ", "amod", lambda s, t, before, after: after and after.pos in ("PROPN", "NOUN", "PRON") and t.head == after.i, "trans"),
    ("NOUN", "attr", lambda s, t, before, after: (h := s.at(t.head)) and h.lemma.lower() == "be" and before
        and before.pos in ("NOUN", "PROPN", "ADJ") and (after is None or after.pos == "PUNCT"), "intr"),
)


def _participle(s: Sentence, t: Token) -> VerbTarget | None:
    if not (t.text.isalpha() and t.low.endswith("ing") and len(t.text) >= 5):
        return None
    around = s.at(t.i - 1), s.at(t.i + 1)
    kind = next((k for pos, dep, test, k in _PARTICIPLES if (t.pos, t.dep) == (pos, dep) and test(s, t, *around)), None)
    return VerbTarget(t, "VBG", kind, t.low) if kind else None


def _lexical(s: Sentence, t: Token) -> bool:
    return t.dep not in ("aux", "auxpass", "cop") and t.tag != "MD" and t.lemma.lower() not in LIGHT_VERBS and t.text.isalpha() and not is_ex_compound(s, t)


def verb_targets(s: Sentence) -> list[VerbTarget]:
    """Lexical verbs with a simple argument structure, left to right."""
    out = []
    for t in s.tokens:
        if t.pos != "VERB":
            out += [v for v in [_participle(s, t)] if v]
            continue
        frame = sentence_frame(s, t) if _lexical(s, t) else None
        if frame is None:
            continue
        kind, prep, particle = frame
        clauses = s.children(t, "ccomp")
        if clauses and prep is None:  # a preposition before the clause makes the frame
            prep = _following(s, t, 3, lambda x: x.dep != "prt" and x.low not in CLAUSE_OPENERS | PARTICLES)
            if prep is not None and not kind.endswith("_pp"):
                kind = "intr_pp" if kind.startswith("intr") else "ditrans_pp"
        inner = sorted(s.subtree(clauses[0]), key=lambda x: x.i) if clauses and prep is None else []
        out.append(
            VerbTarget(
                t, t.tag, kind, t.lemma.lower(), prep, particle, clause=bool(inner),
                that=any(x.low == "that" and x.dep == "mark" for x in inner), wh=next((x.low for x in inner if x.low in ("what", "who")), None),
            )
        )
    return out


def passive_head(s: Sentence) -> Token | None:
    """The verb with a passive auxiliary, else a participle root, else a participle."""
    rank = lambda t: 0 if s.children(t, "auxpass") else (1 if t.dep == "ROOT" else 2) if t.tag == "VBN" else 3
    found = [t for t in s.tokens if t.pos == "VERB" and t.tag.startswith("VB") and rank(t) < 3]
    return min(found, key=lambda t: (rank(t), t.i), default=None)


#: The frame that an argument-structure subtask is about, on its good side.
GOOD_FRAMES = {"causative": "trans", "transitive": "trans", "inchoative": "intr", "intransitive": "intr", "drop_argument": "intr"}


def forced_frame(phenomenon: str, subtask: str, side: str, kind: str) -> tuple[str, bool]:
    """(kind, exclusive) after an argument-structure subtask has its say; the bad side has the other frame."""
    good = GOOD_FRAMES.get(subtask) if phenomenon == "argument_structure" else None
    if good is None or (side == "bad" and subtask == "drop_argument" and kind.startswith("intr_pp")):
        return kind, False
    own = good if side == "good" else {"trans": "intr", "intr": "trans"}[good]
    return own + ("_particle" if kind.endswith("_particle") else ""), side == "bad"


def forced_targets(s: Sentence, given: list[dict]) -> list[VerbTarget]:
    """Verb targets out of another run's records (``i``, and optionally ``tag, kind, lemma, prep, particle``).

    What a record lacks is read off the sentence.  Records whose place isn't in
    the sentence, and all but the first of a place, drop out.
    """
    own = {v.token.i: v for v in verb_targets(s)}
    out: dict[int, VerbTarget] = {}
    for r in given:
        t = s.at(r["i"]) if type(r.get("i")) is int else None
        if t is None or t.i in out:
            continue
        base = own.get(t.i) or VerbTarget(t, t.tag, "trans", t.lemma.lower())
        at = lambda name, was: next((x for x in s.tokens[t.i + 1 :] if x.low == str(r[name]).lower()), None) if r.get(name) else was
        out[t.i] = VerbTarget(
            t, r.get("tag") or base.tag, r.get("kind") or base.kind, str(r.get("lemma") or base.lemma).lower(),
            at("prep", base.prep), at("particle", base.particle), base.clause, base.that, base.wh,
        )
    return [out[i] for i in sorted(out)]
