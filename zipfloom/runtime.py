"""Session, table access, shared storage and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; more rows take a shuffle join.
BROADCAST_ROWS = 200_000

_SHIPPED: set[str] = set()


def session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("zipfloom")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="zipfloom-")
    atexit.register(shutil.rmtree, folder, True)
    archive = os.path.join(folder, "zipfloom_src.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Where it is unset a
    temporary folder is made, which is right for local masters only.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="zipfloom-shared-")
    atexit.register(shutil.rmtree, folder, True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the application has ended; the folder's owner clears it
        pass


def materialise(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it.

    ``by``: a column of few values that the files are told apart by, so that a
    filter on it reads its own files only.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/zipfloom/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only where a count proves that ``df`` has few rows."""
    if df.limit(rows + 1).count() <= rows:
        return F.broadcast(df)
    return df


def same_name(c: Column | str) -> Column:
    """Subtask names are equal but for case, outer blanks and ``-`` for ``_``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.translate(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), "-", "_")


#: The SQL twin of :func:`same_name`.
def same_name_sql(c: str) -> str:
    return f"replace(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '-', '_')"


def latest(df: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """One row per ``key``: the one with the greatest ``order``.

    A partial aggregate runs before the shuffle, so a key that holds a third of
    all rows leaves one row per task.  Ties in ``order`` are broken by the kept
    columns' hash; null keys form one group; null order values come first.
    """
    kept = F.struct(*[F.col(k) for k in keep])
    rank = F.struct(*[F.col(o) for o in order], F.xxhash64(*[F.col(k) for k in keep]))
    got = df.groupBy(key).agg(F.max_by(kept, rank).alias("_kept"))
    return got.select(key, *[F.col(f"_kept.{k}").alias(k) for k in keep])
