"""JSON lines: tolerant and strict scans with physical line numbers, and the sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_BAD = "_corrupt_record"


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, _row, value``: each physical line with its number from 0 within its file.

    Files are split as usual; a line's number is its place in its block and the
    lines of the file's earlier blocks, of which there are few.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), "value"
    )
    blocks = raw.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    got = raw.join(starts, ["file", "_block"])
    return got.select("file", (F.col("_id") - F.col("_first") + F.col("_start")).alias("_row"), "value")


def parse_lines(lines: DataFrame, schema: StructType, keep: list[str], value: str = "value") -> DataFrame:
    """Parsed fields of the lines that are JSON objects; blank and malformed lines drop out.

    A field of another type than the schema's is null and its row stays: a line
    is malformed only if no field of it could be read and it isn't an object.
    """
    wide = StructType([*schema.fields, StructField(_BAD, StringType())])
    got = lines.where(F.length(F.trim(value)) > 0).withColumn("_v", F.from_json(value, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}))
    readable = F.get_json_object(value, "$").isNotNull() & F.trim(value).startswith("{")
    ok = F.col(f"_v.{_BAD}").isNull() & F.trim(value).startswith("{") | readable
    return got.where(ok).select(*keep, *[F.col(f"_v.{f.name}").alias(f.name) for f in schema.fields])


def read_tolerant(
    spark: SparkSession, path: str | list[str], schema: StructType, *, physical_limit: int | None = None, record_limit: int | None = None
) -> DataFrame:
    """``file, _row`` and the schema's fields of every good line.

    ``physical_limit`` counts lines, blank and broken ones too; ``record_limit``
    counts parsed records, in order of file and line.
    """
    lines = numbered_lines(spark, path)
    if physical_limit is not None:
        lines = lines.where(F.col("_row") < physical_limit)
    got = parse_lines(lines, schema, ["file", "_row"])
    return got if record_limit is None else got.orderBy("file", "_row").limit(record_limit)


def read_strict(spark: SparkSession, path: str | list[str], schema: StructType) -> DataFrame:
    """A scan that fails at the first malformed line."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """UTF-8 JSON lines; null fields keep their keys."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def split_outputs(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Generated rows without the originals, and originals without the swapped texts."""
    drop = lambda end: [c for c in records.columns if c.endswith(end)]
    return records.drop(*drop("_original")), records.drop(*drop("_freq"))


def read_pairs(spark: SparkSession, folder: str, names: list[str], schema: str = "sentence_good string, sentence_bad string, field string") -> DataFrame:
    """Source pairs of configurations by name: ``<folder>/<name>.jsonl`` or ``.parquet``, one scan for all.

    ``subtask`` is the file's name, ``idx`` the row's number in it, from 0.
    Names without a file raise, as Spark does for a missing path.
    """
    kinds = spark.createDataFrame([], schema).schema
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    there = lambda p: Path(p).getFileSystem(hadoop).exists(Path(p))
    tables = [n for n in names if there(f"{folder}/{n}.parquet")]
    texts = [f"{folder}/{n}.jsonl" for n in names if n not in tables]
    name = F.regexp_extract("file", r"([^/]+)\.jsonl$", 1).alias("subtask")
    parts = []
    if texts:
        parts.append(read_tolerant(spark, texts, kinds).select(name, F.col("_row").cast("int").alias("idx"), *kinds.names))
    for n in tables:
        got = spark.read.parquet(f"{folder}/{n}.parquet")
        rest = [F.col(c) if c in got.columns else F.lit(None).cast("string").alias(c) for c in kinds.names]
        number = F.col("idx").cast("int") if "idx" in got.columns else F.monotonically_increasing_id().cast("int")
        parts.append(got.select(F.lit(n).alias("subtask"), number.alias("idx"), *rest))
    out = parts[0] if parts else spark.createDataFrame([], f"subtask string, idx int, {schema}")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
