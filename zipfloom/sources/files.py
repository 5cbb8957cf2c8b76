"""Files: discovery, dimensions in names, safe rewriting."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TS = re.compile(r"^(\d{8}-\d{6})_")


def _part(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def dataset_dims(name: str) -> list[Column]:
    """Run timestamp and frequency window out of a file name."""
    c = F.element_at(F.split(F.col(name), "/"), -1)
    num = lambda p: F.replace(_part(c, p), F.lit("p"), F.lit(".")).cast("double")
    return [
        _part(c, r"^(\d{8}-\d{6})_").alias("run_ts"),
        _part(c, r"zw_(\d+p\d+_\d+p\d+)").alias("zipf_window"),
        num(r"zw_(\d+p\d+)_\d+p\d+").alias("zipf_lo"),
        num(r"zw_\d+p\d+_(\d+p\d+)").alias("zipf_hi"),
    ]


def score_file_dims(path: str) -> list[Column]:
    """``run_ts, model, dataset, variant`` of ``<ts>_<model>_<dataset>[_<variant>]_pair-scores.jsonl``.

    The dataset starts with its own timestamp; names of another form give nulls.
    """
    c = F.element_at(F.split(F.col(path), "/"), -1)
    p = r"^(\d{8}-\d{6})_(.+?)_(\d{8}-\d{6}_.+?)(?:_(original|freq|rare))?_pair-scores\.jsonl$"
    return [F.nullif(F.regexp_extract(c, p, i), F.lit("")).alias(n) for i, n in ((1, "run_ts"), (2, "model"), (3, "dataset"), (4, "variant"))]


def collect_paths(folder: str, pattern: str = "*.jsonl", timestamp: str | None = None) -> list[str]:
    """Files of a run: those with the given leading timestamp, or else the latest one."""
    found = sorted(str(p) for p in Path(folder).glob(pattern))
    stamps = {p: m[1] for p in found if (m := _TS.match(os.path.basename(p)))}
    if timestamp is None:
        if not stamps:
            return found
        timestamp = max(stamps.values())
    return [p for p in found if stamps.get(p) == timestamp]


def rewrite(df: DataFrame, path: str, backup: bool = False) -> None:
    """Replace a JSON table that ``df`` may be read from: write beside it, then rename."""
    spark: SparkSession = df.sparkSession
    jvm = spark.sparkContext._jvm
    P = jvm.org.apache.hadoop.fs.Path
    fs = P(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    tmp = path.rstrip("/") + ".tmp"
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(tmp)
    if fs.exists(P(path)):
        if backup:
            fs.delete(P(path + ".bak"), True)
            fs.rename(P(path), P(path + ".bak"))
        else:
            fs.delete(P(path), True)
    fs.rename(P(tmp), P(path))


def write_once(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write a JSON table unless it is there already."""
    df.write.mode("overwrite" if overwrite else "ignore").option("ignoreNullFields", "false").json(path)
