"""Scalar text functions as JVM-side column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that attach to what precedes, numerals that stay upper case.
ATTACHED = [".", ",", "!", "?", ";", ":", "n't", "'s", "'re", "'ve", "'d", "'ll", "'m", "-"]
UPPER_NUMERALS = ["ii", "iii", "iv"]
# Frequency windows and the regimes they stand for.
REGIMES = [(4.0, 5.2, "head"), (3.6, 5.0, "head"), (2.2, 3.0, "tail"), (1.2, 2.0, "xtail")]
REGIME_VALUES = [(3.6, 5.2, "head"), (2.2, 3.0, "tail"), (1.2, 2.0, "xtail")]
REGIME_ORDER = ["original", "head", "tail", "xtail"]


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_letters(c: Column) -> Column:
    return F.upper(c) != F.lower(c)


def title(c: Column | str) -> Column:
    """Each run of letters capitalised, so ``ex-wife`` becomes ``Ex-Wife``."""
    parts = F.regexp_extract_all(F.lower(_c(c)), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(parts, capitalise_first), "")


def is_title(c: Column) -> Column:
    return has_letters(c) & (c == title(c))


def match_casing(template: Column | str, replacement: Column | str) -> Column:
    """Give ``replacement`` the case of ``template``; mixed templates follow their first letter."""
    t, r = _c(template), _c(replacement)
    upper = (has_letters(t) & (t == F.upper(t))) | t.isin(UPPER_NUMERALS)
    head = F.substring(t, 1, 1)
    return (
        F.when(upper, F.upper(r))
        .when(is_title(t), title(r))
        .when(has_letters(t) & (t == F.lower(t)), F.lower(r))
        .when(has_letters(head) & (head == F.upper(head)), title(r))
        .otherwise(F.lower(r))
    )


def match_inflected_case(template: Column | str, form: Column | str) -> Column:
    """As :func:`match_casing` for all-upper and title templates; others leave the form."""
    t, r = _c(template), _c(form)
    return (
        F.when(has_letters(t) & (t == F.upper(t)), F.upper(r))
        .when(is_title(t), F.concat(F.upper(F.substring(r, 1, 1)), r.substr(F.lit(2), F.length(r))))
        .otherwise(r)
    )


def capitalise_first(c: Column | str) -> Column:
    c = _c(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), c.substr(F.lit(2), F.length(c)))


def detokenise(tokens: Column | str) -> Column:
    """Join tokens into a text; empty tokens are skipped."""
    start = F.struct(F.lit("").alias("text"), F.lit("").alias("prev"))

    def step(acc: Column, tok: Column) -> Column:
        glued = tok.isin(ATTACHED) | tok.startswith("'") | (acc["prev"] == "-")
        sep = F.when((acc["text"] == "") | glued, F.lit("")).otherwise(F.lit(" "))
        added = F.struct(F.concat(acc["text"], sep, tok).alias("text"), tok.alias("prev"))
        return F.when(tok.isNull() | (tok == ""), acc).otherwise(added)

    return F.aggregate(_c(tokens), start, step, lambda acc: acc["text"])


def agree_articles(tokens: Column | str) -> Column:
    """``a`` or ``an`` by the next token's first letter; the case is kept."""
    t = _c(tokens)

    def fix(word: Column, i: Column) -> Column:
        nxt = F.try_element_at(t, i + 2)
        first = F.lower(F.substring(nxt, 1, 1))
        want = F.when(first.isin(*"aeiou"), F.lit("an")).otherwise(F.lit("a"))
        cased = F.when(F.substring(word, 1, 1) == "A", F.initcap(want)).otherwise(want)
        change = F.lower(word).isin("a", "an") & first.rlike(r"^\p{L}$") & (F.lower(word) != want)
        return F.when(F.coalesce(change, F.lit(False)), cased).otherwise(word)

    return F.transform(t, fix)


def looks_like_acronym(c: Column | str) -> Column:
    """Any digit, or letters without a, e, i, o, u."""
    s = F.lower(F.trim(_c(c)))
    return s.rlike("[0-9]") | (s.rlike("[a-z]") & ~s.rlike("[aeiou]"))


def plain_lemma(c: Column | str, least: int = 1) -> Column:
    return _c(c).rlike("^[a-z]+$") & (F.length(_c(c)) >= least)


def normal_field(c: Column | str) -> Column:
    """Trimmed; empty becomes null; one old spelling becomes the usual one."""
    s = F.trim(_c(c))
    return F.when(s == "", None).when(s == "syntax_semantics", F.lit("syntax/semantics")).otherwise(s)


def in_window(z: Column | str, low: float | None, high: float | None) -> Column:
    """``low <= z < high``; a missing bound doesn't bind."""
    z = _c(z)
    ok = F.lit(True)
    if high is not None:
        ok = ok & (z < F.lit(float(high)))
        if low is not None:
            ok = ok & (z >= F.lit(float(low)))
    return ok


def zipf_weight(z: Column | str, temperature: float = 1.0) -> Column:
    """Frequency to the power of 1/temperature, at least 0.001."""
    return F.greatest(F.pow(F.pow(F.lit(10.0), _c(z)), F.lit(1.0 / temperature)), F.lit(0.001))


def regime(low: Column | str, high: Column | str, variant: Column | str | None = None) -> Column:
    """The regime of a frequency window, or of a single value (low = high)."""
    lo, hi = _c(low), _c(high)
    out = F.when(F.lit(False), F.lit(""))
    if variant is not None:
        out = out.when(F.lower(F.trim(_c(variant))) == "original", F.lit("original"))
    for a, b, name in REGIMES:
        out = out.when((lo == a) & (hi == b), F.lit(name))
    for a, b, name in REGIME_VALUES:
        out = out.when((lo == hi) & lo.between(a, b), F.lit(name))
    return out


def zipf_text(z: Column | str) -> Column:
    """``3.4`` as ``3_4``."""
    return F.replace(_c(z).cast("double").cast("string"), F.lit("."), F.lit("_"))


def model_slug(c: Column | str) -> Column:
    """The last part of a model's path, with other signs than letters, digits, ``.-_`` as ``_``."""
    return F.regexp_replace(F.element_at(F.split(F.rtrim(_c(c), F.lit("/")), "/"), -1), r"[^A-Za-z0-9._-]+", "_")


def data_slug(path: Column | str) -> Column:
    """A data file's name without its folder and ending."""
    return F.regexp_replace(F.element_at(F.split(_c(path), "/"), -1), r"\.[^.]*$", "")


def strip_timestamps(c: Column | str) -> Column:
    """A name without timestamps before and after it."""
    return F.regexp_replace(F.regexp_replace(_c(c), r"^(\d{8}-\d{6}_)+", ""), r"(_\d{8}-\d{6})+$", "")


def strip_pair_suffix(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), r"(_pair[-_]scores?)?(_(original|freq|rare))?$", "")


def leading_timestamp(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(c), r"^(\d{8}-\d{6})", 1), F.lit(""))


def threshold_in_path(c: Column | str) -> Column:
    """The frequency threshold that a path names as ``zipf3_4``."""
    got = F.regexp_extract(_c(c), r"zipf(\d+(?:[._]\d+)?)", 1)
    return F.when(got != "", F.replace(got, F.lit("_"), F.lit(".")).cast("double"))


def model_size(c: Column | str) -> Column:
    """Billions of parameters in a model's name, else null."""
    got = F.regexp_extract(_c(c), r"(?i)(\d+(?:\.\d+)?)b", 1)
    return F.when(got != "", got.cast("double"))


def parse_window(text: str) -> tuple[float, float]:
    """``LOW-HIGH`` with LOW <= HIGH."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)\s*", text)
    if not m or float(m[1]) > float(m[2]):
        raise ValueError(f"not a window LOW-HIGH: {text!r}")
    return float(m[1]), float(m[2])


def parse_models(text: str) -> list[str]:
    return [m.strip() for m in text.split(",") if m.strip()]


def format_duration(seconds: float | None) -> str:
    """Milliseconds below a second, seconds below a minute, then two units; ``?`` for none."""
    if seconds is None or seconds != seconds or seconds in (float("inf"), float("-inf")):
        return "?"
    if seconds < 1:
        return f"{max(0, round(seconds * 1000))}ms"
    whole = int(seconds)
    units = [(whole // 3600, "h"), (whole % 3600 // 60, "m"), (whole % 60, "s")]
    first = next((k for k, (n, _) in enumerate(units) if n), 2)
    return " ".join(f"{n:02d}{u}" if k > first else f"{n}{u}" for k, (n, u) in enumerate(units) if first <= k <= first + 1)


def quantifier_requirement(tokens: Column | str, count_words: list[str], mass_words: list[str]) -> Column:
    """COUNT if a count quantifier is there, else MASS if a mass one is, else null."""
    low = F.transform(_c(tokens), F.lower)
    return F.when(F.arrays_overlap(low, F.array(*map(F.lit, count_words))), F.lit("COUNT")).when(
        F.arrays_overlap(low, F.array(*map(F.lit, mass_words))), F.lit("MASS")
    )
