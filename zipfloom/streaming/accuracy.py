"""Accuracy kept up to date over a stream of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.reports import less, unknown


def running_accuracy(scores: DataFrame, delay: str = "30 days") -> DataFrame:
    """Correct and total per day of scoring, phenomenon and model.

    Scores that repeat within ``delay`` of their first arrival count once; later
    days stay open as long.  For ``append`` or ``update`` output.
    """
    rows = scores.where("good_total_nll is not null and bad_total_nll is not null and scored_at is not null")
    once = rows.withWatermark("scored_at", delay).dropDuplicates(["score_id", "scored_at"])
    ok = less(F.col("good_total_nll"), F.col("bad_total_nll")).cast("bigint")
    return once.groupBy(F.window("scored_at", "1 day"), unknown("phenomenon").alias("phenomenon"), "model").agg(
        F.sum(ok).alias("correct"), F.count("*").alias("total")
    )
