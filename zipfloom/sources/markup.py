"""XML sources: wiki pages and verb classes; what categories say about gender."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "title string, ns int, redirect struct<_title:string>, revision struct<text:struct<_VALUE:string>>"
# Keywords that block a category or a label, and the default categories.
BLOCKED_CATEGORIES = [
    "offensive", "derogatory", "vulgar", "slur", "sexual", "masturb", "lgbt", "lesbian", ":gay", " gay", "gay ", "gay-", "lgbtq", "bisexual",
    "queer", "transgender", "transsexual", "transvestite", "paedoph", "pedoph", "fetish", "porn",
]
BLOCKED_LABELS = [
    "offensive", "derogatory", "vulgar", "slur", "pejorative", "sexual", "masturbation", "lgbt", "lesbian", "gay", "lgbtq", "bisexual",
    "queer", "transgender", "transsexual", "transvestite", "paedoph", "pedoph", "fetish", "porn",
]
CATEGORIES = {
    "female": ["en:Female people", "en:Women", "en:Female family members", "en:Female animals"],
    "male": ["en:Male people", "en:Men", "en:Male family members", "en:Male animals"],
}
#: Templates that hold categories, and those that hold labels.
CATEGORY_TEMPLATES = ["c", "cln"]
LABEL_TEMPLATES = ["lb", "lbl", "label", "qualifier", "qual", "q", "qq", "topics"]
TOPICS = {"female": ["female", "women", "woman"], "male": ["male", "men", "man"]}


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """``title, ns, redirect, text`` of a MediaWiki dump, read in splits."""
    raw = spark.read.format("xml").option("rowTag", "page").schema(PAGE).load(path)
    text = F.coalesce(F.col("revision.text._VALUE"), F.lit(""))
    return raw.select("title", F.coalesce("ns", F.lit(0)).alias("ns"), F.col("redirect").isNotNull().alias("redirect"), text.alias("text"))


def _without(c: Column, start: str) -> Column:
    """Without a leading word, whatever its case."""
    return F.when(F.lower(c).startswith(start), F.trim(F.substr(c, F.lit(len(start) + 1)))).otherwise(c)


def _category(c: Column) -> Column:
    name = _without(_without(F.trim(c), ":"), "category:")
    return F.when(name == "", None).when(F.lower(name).startswith("en:"), name).otherwise(F.concat(F.lit("en:"), name))


def _bracketed(text: Column, opening: str, closing: str) -> Column:
    """The parts, cut at ``|`` and trimmed, of every innermost bracket pair; the first names it."""
    inner = F.regexp_extract_all(text, F.lit(rf"\Q{opening}\E([^\[\]{{}}]*)\Q{closing}\E"), F.lit(1))
    return F.transform(inner, lambda t: F.transform(F.split(t, r"\|"), F.trim))


def templates(text: Column | str, names: list[str]) -> Column:
    """The arguments of every template of one of the names."""
    t = F.col(text) if isinstance(text, str) else text
    named = F.filter(_bracketed(t, "{{", "}}"), lambda p: (F.size(p) > 1) & F.lower(p[0]).isin(names))
    return F.transform(named, lambda p: F.slice(p, F.lit(2), F.size(p)))


def categories(text: Column | str) -> Column:
    """Categories out of links and of English category templates, with ``en:`` before them."""
    t = F.col(text) if isinstance(text, str) else text
    links = F.filter(F.transform(_bracketed(t, "[[", "]]"), lambda p: F.regexp_replace(p[0], r"\s*:\s*", ":")), lambda x: F.lower(x).startswith("category:"))
    english = F.filter(templates(t, CATEGORY_TEMPLATES), lambda a: F.lower(a[0]) == "en")
    named = F.flatten(F.transform(english, lambda a: F.slice(a, F.lit(2), F.size(a))))
    return F.array_compact(F.transform(F.concat(links, named), _category))


def labels(text: Column | str) -> Column:
    """Arguments of label, qualifier and topic templates in lower case."""
    return F.transform(F.flatten(templates(text, LABEL_TEMPLATES)), F.lower)


def _contains(items: Column, words: list[str]) -> Column:
    hit = lambda c: F.lower(c).rlike("|".join(w.replace("-", r"\-") for w in words))
    return F.exists(items, hit)


def _matches(items: Column, pattern: str) -> Column:
    return F.exists(items, lambda t: t.rlike(pattern))


def gendered_lemmas(
    pages: DataFrame, by_category: dict[str, list[str]] | None = None, by_topic: dict[str, list[str]] | None = None, least: int = 3, need_noun: bool = True
) -> DataFrame:
    """``lemma, gender`` of English noun pages by category and topic; a lemma may have both.

    Redirects, other name spaces, blocked categories and labels, and titles that
    aren't plain words drop out.
    """
    by_category, by_topic = by_category or CATEGORIES, by_topic or TOPICS
    p = pages.where((F.col("ns") == 0) & ~F.col("redirect")).withColumn("lemma", F.lower(F.trim("title")))
    p = p.where(F.col("lemma").rlike("^[a-z]+$") & (F.length("lemma") >= least))
    if need_noun:
        p = p.where(F.col("text").contains("==English==") & F.col("text").contains("===Noun==="))
    p = p.withColumns({"cats": categories("text"), "labels": labels("text")})
    p = p.where(~_contains(F.col("cats"), BLOCKED_CATEGORIES) & ~_contains(F.col("labels"), BLOCKED_LABELS))
    topics = F.flatten(templates("text", ["topics"]))
    tests = []
    for g in sorted({*by_category, *by_topic}):
        cat = F.arrays_overlap("cats", F.array(*[F.lit(c) for c in by_category.get(g, [""])]))
        word = r"(?i)\b(?:" + "|".join(by_topic.get(g, ["(?!)"])) + r")\b"
        tests.append(F.when(cat | _matches(topics, word), F.lit(g)))
    return p.select("lemma", F.explode(F.array_compact(F.array(*tests))).alias("gender")).distinct()


CLASS = (
    "_ID string, MEMBERS struct<MEMBER:array<struct<_name:string>>>, "
    "FRAMES struct<FRAME:array<struct<SYNTAX:struct<NP:array<struct<_value:string>>,PREP:array<struct<_value:string>>,VERB:string>>>>"
)


def verb_classes(spark: SparkSession, path: str) -> DataFrame:
    """``lemma, kind, prep, particle``: the members of each class with its frames.

    Members and frames of one class are combined, as the class defines them.  A
    two-part member (``give_up``) is a particle verb.  A first NP is the subject.
    """
    raw = spark.read.format("xml").option("rowTag", "VNCLASS").schema(CLASS).load(path)
    frame = raw.select("MEMBERS.MEMBER", F.explode("FRAMES.FRAME").alias("f")).select(F.explode("MEMBER._name").alias("name"), "f.SYNTAX")
    objects = F.greatest(F.coalesce(F.size("SYNTAX.NP"), F.lit(0)) - 1, F.lit(0))
    values = F.filter(F.transform(F.coalesce(F.col("SYNTAX.PREP"), F.array().cast("array<struct<_value:string>>")), lambda p: F.lower(F.element_at(F.split(F.trim(p["_value"]), r"[ |]+"), 1))), lambda v: v.isNotNull() & ~v.isin("", "none"))
    prep = F.try_element_at(values, F.lit(1))
    kind = (
        F.when(prep == "to", "intr_pp").when(prep.isNotNull(), F.when(objects >= 2, "ditrans_pp").otherwise("intr_pp"))
        .when(objects >= 2, "ditrans").when(objects == 1, "trans").otherwise("intr")
    )
    parts = F.split(F.lower("name"), "_")
    particle = F.when(F.size(parts) == 2, F.element_at(parts, -1))
    base = kind.alias("kind")
    got = frame.select(F.element_at(parts, 1).alias("lemma"), base, prep.alias("prep"), particle.alias("particle")).where(F.size(F.split("lemma", " ")) == 1)
    named = F.when(F.col("particle").isNotNull() & F.col("kind").isin("intr", "trans", "ditrans"), F.concat("kind", F.lit("_particle"))).otherwise(F.col("kind"))
    return got.withColumn("kind", named).distinct()


def frame_of_template(c: Column | str, prepositions: list[str]) -> Column:
    """``(kind, prep)`` of a sentence template such as ``Somebody ----s something on somebody``."""
    t = F.col(c) if isinstance(c, str) else c
    words = F.split(F.trim(F.regexp_replace(F.lower(t), "[,/]", " ")), r"\s+")
    verb = F.array_position(F.transform(words, lambda w: w.contains("----")), True).cast("int")
    rest = F.slice(words, verb + 1, F.greatest(F.size(words) - verb, F.lit(0)))
    is_prep = F.transform(rest, lambda w: w.isin(prepositions))
    at = F.array_position(is_prep, True).cast("int")
    span = F.when(at > 0, F.slice(rest, F.lit(1), at - 1)).otherwise(rest)
    n = F.size(F.filter(span, lambda w: w.isin("somebody", "someone", "something")))
    kind = F.when(at > 0, F.when(n == 0, "intr_pp").otherwise("ditrans_pp")).when(n >= 2, "ditrans").when(n == 1, "trans").otherwise("intr")
    return F.when(verb > 0, F.struct(kind.alias("kind"), F.when(at > 0, F.element_at(rest, at)).alias("prep")))
