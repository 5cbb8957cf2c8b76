"""Sentence likelihoods: a default corpus model in SQL and pluggable scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Scorer(Protocol):
    """A model that scores texts; made once per task by its factory."""

    def score(self, texts: list[str]) -> list[tuple[float, int]]:
        """``(total_nll, token_count)`` per text, never depending on the batch."""


class CausalScorer:
    """Any causal language model as a scorer.

    ``tokenize(text)`` gives ids; ``logits(ids, mask)`` gives the model's scores
    for arrays padded on the right, as (texts, places, vocabulary).  A text's
    likelihood is the sum over its own tokens after the first, so it depends on
    neither the batch nor the padding; ``token_count`` is their number.  Texts
    longer than ``max_length`` tokens are scored on their first ``max_length``,
    as the model reads no more; one of at most a token scores (0, 0).
    """

    def __init__(self, tokenize: Callable[[str], list[int]], logits: Callable[[np.ndarray, np.ndarray], np.ndarray], max_length: int = 256, batch: int = 64, pad: int = 0):
        self.tokenize, self.logits, self.max_length, self.batch, self.pad = tokenize, logits, max_length, batch, pad

    def score(self, texts: list[str]) -> list[tuple[float, int]]:
        out: list[tuple[float, int]] = []
        for lo in range(0, len(texts), self.batch):
            rows = [self.tokenize(t)[: self.max_length] for t in texts[lo : lo + self.batch]]
            width = max((len(r) for r in rows), default=0)
            if width < 2:
                out += [(0.0, 0)] * len(rows)
                continue
            mask = np.arange(width) < np.array([len(r) for r in rows])[:, None]
            ids = np.full((len(rows), width), self.pad, np.int64)
            ids[mask] = np.concatenate([np.array(r, np.int64) for r in rows])
            z = np.asarray(self.logits(ids, mask), np.float64)[:, :-1]
            top = z.max(axis=2, keepdims=True)
            own = np.take_along_axis(z, ids[:, 1:, None], 2)[..., 0]
            loss = np.where(mask[:, 1:], np.log(np.exp(z - top).sum(axis=2)) + top[..., 0] - own, 0.0)
            out += list(zip(loss.sum(axis=1).tolist(), mask[:, 1:].sum(axis=1).tolist()))
        return out


_WORDS = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{M}]+)"), F.lit(1))


def unigram_model(texts: DataFrame, column: str) -> DataFrame:
    """``word, n`` of a corpus."""
    return texts.select(F.explode(_WORDS(column)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def unigram_nll(texts: DataFrame, model: DataFrame, column: str = "text") -> DataFrame:
    """``text, total_nll, token_count`` with add-one smoothing; texts without words drop out."""
    size = model.agg((F.sum("n") + F.count("*") + 1).cast("double"))
    words = texts.select(column, F.explode(_WORDS(column)).alias("word"))
    p = (F.coalesce("n", F.lit(0)) + 1) / size.scalar()
    got = words.join(model, "word", "left").groupBy(column).agg(F.round(F.sum(-F.log(p)), 6).alias("total_nll"), F.count("*").alias("token_count"))
    return got.withColumnRenamed(column, "text")


def score_texts(texts: DataFrame, factory: Callable[[], Scorer], column: str = "text", batch: int = 64) -> DataFrame:
    """``text, total_nll, token_count`` by any scorer; the model is loaded once per task.

    Batches are cut by row, and a score is the text's own, so that equal texts
    score alike wherever they fall.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = factory()
        for pdf in parts:
            values = pdf[column].tolist()
            got = [s for i in range(0, len(values), batch) for s in scorer.score(values[i : i + batch])]
            yield pd.DataFrame({"text": values, "total_nll": [float(a) for a, _ in got], "token_count": [int(b) for _, b in got]})

    return texts.select(column).where(F.col(column).isNotNull()).mapInPandas(run, "text string, total_nll double, token_count bigint")


def uncached(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Texts that the cache (model, key = sha1 of the text) doesn't have for the model."""
    known = cache.where(F.col("model") == model).select("key")
    return texts.withColumn("key", F.sha1("text")).join(known, "key", "left_anti")


def score_pairs(pairs: DataFrame, scorer: Callable[[DataFrame], DataFrame], good: str = "sentence_good", bad: str = "sentence_bad") -> DataFrame:
    """Pairs with both sides' likelihood: distinct texts are scored once and joined back.

    Pairs with a side that is null or can't be scored drop out.
    """
    texts = pairs.select(F.explode(F.array(good, bad)).alias("text")).where("text is not null").distinct()
    scores = scorer(texts)
    side = lambda s, c: scores.select(F.col("text").alias(c), F.col("total_nll").alias(f"{s}_total_nll"), F.col("token_count").alias(f"{s}_token_count"))
    return pairs.join(side("good", good), good).join(side("bad", bad), bad)
