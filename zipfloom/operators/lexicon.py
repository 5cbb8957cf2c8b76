"""A tag lexicon for parsers: in each worker where it is small, else beside each row."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.inflection import singularise
from ..runtime import BROADCAST_ROWS, materialise

#: The column that carries a row's own part of the lexicon.
OWN = "_lexicon"
_ENTRY = "map<string,struct<tag:string,lemma:string>>"


class Lexicon(NamedTuple):
    """``known`` where a count proves that all entries fit, else None; ``table`` has ``w, tag, lemma``."""

    known: dict[str, tuple[str, str]] | None
    table: DataFrame

    def attach(self, df: DataFrame, *texts: str) -> DataFrame:
        """``df`` with the entries of each row's words, null where the workers know them all.

        Rows are told apart by their texts, so equal texts are looked up once.
        """
        if self.known is not None:
            return df.withColumn(OWN, F.lit(None).cast(_ENTRY))
        keyed = df.withColumn("_texts", F.sha1(F.concat_ws("\x1f", *[F.coalesce(t, F.lit("")) for t in texts])))
        words = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)) for t in texts])))
        each = keyed.select("_texts", words.alias("_words")).dropDuplicates(["_texts"]).select("_texts", F.explode("_words").alias("w"))
        one = F.struct(F.col("w").alias("k"), F.struct("tag", "lemma").alias("v"))
        found = each.join(self.table, "w").groupBy("_texts").agg(F.map_from_entries(F.collect_list(one)).alias(OWN))
        none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<tag:string,lemma:string>>"))
        return keyed.join(found, "_texts", "left").withColumn(OWN, F.coalesce(OWN, none)).drop("_texts")


def own_entries(parser, row_lexicon) -> None:
    """Give a parser the entries that came with the row, if any did."""
    if row_lexicon is not None:
        entries = row_lexicon.items() if isinstance(row_lexicon, dict) else row_lexicon
        parser.lexicon = {k: (v["tag"], v["lemma"]) for k, v in entries}


def _lemma(word: str, tag: str) -> str:
    if tag == "NNS":
        return singularise(word) or word
    if tag in ("VBD", "VBN") and word.endswith("ed"):
        return word[:-2]
    return word[:-1] if tag == "VBZ" and word.endswith("s") else word


def tag_lexicon(swaps: DataFrame, most: int = BROADCAST_ROWS) -> Lexicon:
    """Every word that swaps replaced (``old, tag``) with its most frequent tag; ties go to the greater tag."""
    word = F.lower(F.trim("old"))
    got = swaps.where("old is not null and tag is not null").groupBy(word.alias("w"), "tag").agg(F.count("*").alias("n"))
    best = got.groupBy("w").agg(F.max_by("tag", F.struct("n", "tag")).alias("tag"))

    def lemmas(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pdf.assign(lemma=[_lemma(w, t) for w, t in zip(pdf["w"], pdf["tag"])])

    table = materialise(best.mapInPandas(lemmas, "w string, tag string, lemma string"), "lexicon")
    if table.limit(most + 1).count() > most:
        return Lexicon(None, table)
    return Lexicon({r["w"]: (r["tag"], r["lemma"]) for r in table.collect()}, table)
