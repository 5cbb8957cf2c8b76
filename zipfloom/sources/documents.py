"""Report sinks: CSV tables, JSON documents, fixed-width text."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def write_csv(df: DataFrame, path: str, quoted: bool = True) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"' if quoted else "\u0000").csv(path)


def report_document(accuracy: DataFrame) -> dict:
    """The accuracy report as one document: a total and a list per level, in report order.

    Works on the report's rows, one per group.
    """
    out: dict = {"accuracy": None, "correct": 0, "total": 0}
    for level in ("phenomenon", "subtask", "phenomenon_subtask"):
        out[level] = []
    for r in accuracy.orderBy("level", F.desc("accuracy"), F.desc("total"), "phenomenon", "subtask").collect():
        row = {"accuracy": r["accuracy"], "correct": r["correct"], "total": r["total"]}
        if r["level"] == "overall":
            out |= row
        else:
            out[r["level"]].append({"key": "|".join(x for x in (r["phenomenon"], r["subtask"]) if x is not None), **row})
    return out


def write_document(doc: dict, path: str) -> None:
    """A JSON document, NaN as null, written beside and renamed."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    clean = json.loads(json.dumps(doc), parse_constant=lambda _: None)
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        json.dump(clean, f, ensure_ascii=False, indent=2)
    os.replace(path + ".tmp", path)


def pivot_table(accuracy: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Accuracy with one column per value, as the printed tables have it."""
    return accuracy.groupBy(row).pivot(column, values).agg(F.first("accuracy"))


def fixed_width(df: DataFrame, limit: int = 1000) -> str:
    """A small table as text, columns padded to their widest cell."""
    rows = [df.columns, *[["-" if v is None else str(v) for v in r] for r in df.limit(limit).collect()]]
    width = [max(len(r[k]) for r in rows) for k in range(len(df.columns))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, width)).rstrip() for r in rows)
