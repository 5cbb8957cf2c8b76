"""Configuration and lexical resources as tables."""

from __future__ import annotations

import json
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FRAME_KINDS = ["intr", "trans", "ditrans", "intr_pp", "ditrans_pp", "intr_particle", "trans_particle", "ditrans_particle"]


def parse_yaml(text: str) -> object:
    """The part of YAML that configurations use: maps, lists, scalars, flow lists.

    Uses PyYAML where it is installed.
    """
    try:
        import yaml

        return yaml.safe_load(text)
    except ImportError:
        return _simple_yaml(text)


def _scalar(s: str) -> object:
    s = s.strip()
    if s[:1] == "[":
        return [_scalar(x) for x in s.strip("[]").split(",") if x.strip()]
    if s[:1] in "'\"" and s[-1:] == s[:1] and len(s) > 1:
        return s[1:-1]
    low = s.lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("", "null", "~"):
        return None
    for kind in (int, float):
        try:
            return kind(s)
        except ValueError:
            pass
    return s


def _simple_yaml(text: str) -> object:
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]

    def block(k: int, indent: int) -> tuple[object, int]:
        if lines[k][1].startswith("- ") or lines[k][1] == "-":
            out: list = []
            while k < len(lines) and lines[k][0] == indent and lines[k][1].startswith("-"):
                item = lines[k][1][1:].strip()
                if ":" in item and item[:1] not in "'\"[":
                    lines[k] = (indent + 2, item)
                    value, k = block(k, indent + 2)
                else:
                    value, k = _scalar(item), k + 1
                out.append(value)
            return out, k
        got: dict = {}
        while k < len(lines) and lines[k][0] == indent and not lines[k][1].startswith("- "):
            key, _, rest = lines[k][1].partition(":")
            k += 1
            if rest.strip():
                got[key.strip()] = _scalar(rest)
            elif k < len(lines) and (lines[k][0] > indent or (lines[k][0] == indent and lines[k][1].startswith("- "))):
                got[key.strip()], k = block(k, lines[k][0])
            else:
                got[key.strip()] = None
        return got, k

    return block(0, lines[0][0])[0] if lines else None


def task_config(spark: SparkSession, path: str) -> DataFrame:
    """``grp, phenomenon, subtask, ord`` of a configuration of groups."""
    data = parse_yaml(Path(path).read_text(encoding="utf-8")) or {}
    groups = data.get("phenomena", data.get("groups", data)) if isinstance(data, dict) else {}
    rows = []
    for grp, spec in groups.items():
        spec = spec if isinstance(spec, dict) else {"configs": spec}
        for sub in spec.get("configs") or []:
            rows.append((str(grp), str(spec.get("phenomenon") or grp), str(sub), len(rows)))
    return spark.createDataFrame(rows, "grp string, phenomenon string, subtask string, ord int")


def quantifiers(spark: SparkSession, path: str) -> DataFrame:
    """``kind, word`` of count and mass triggers."""
    data = parse_yaml(Path(path).read_text(encoding="utf-8")) or {}
    rows = [(k, str(w)) for k, key in (("COUNT", "count_triggers"), ("MASS", "mass_triggers")) for w in data.get(key) or []]
    return spark.createDataFrame(rows, "kind string, word string")


def _json(path: str) -> object:
    """A small JSON file, or None if it is missing or broken."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return None


def static_field_map(spark: SparkSession, path: str, wanted: list[str] | None = None) -> DataFrame:
    """``subtask, field``, normalised; unreadable files give no rows."""
    data = _json(path)
    rows = []
    for k, v in data.items() if isinstance(data, dict) else []:
        v = v.strip() if isinstance(v, str) else None
        if v and (wanted is None or k in wanted):
            rows.append((k, "syntax/semantics" if v == "syntax_semantics" else v))
    return spark.createDataFrame(rows, "subtask string, field string")


def arrow_field(path: str, column: str = "field") -> str | None:
    """The alphabetically least non-empty value of one column of an Arrow stream."""
    try:
        with pa.memory_map(path) as src:
            table = pa.ipc.open_stream(src).read_all()
    except (OSError, pa.ArrowInvalid):
        return None
    if column not in table.column_names:
        return None
    return min((v.strip() for v in table[column].to_pylist() if isinstance(v, str) and v.strip()), default=None)


def resolve_fields(static: DataFrame, cached: DataFrame) -> DataFrame:
    """``subtask, field``: cached values before static ones."""
    c = cached.select("subtask", F.col("field").alias("_c"))
    return static.join(c, "subtask", "full").select("subtask", F.coalesce("_c", "field").alias("field"))


def count_classes(spark: SparkSession, path: str) -> DataFrame:
    """``lemma, cls`` of a two-column TSV; other classes are UNKNOWN, the later of repeated lemmas counts."""
    raw = spark.read.csv(path, sep="\t", header=True).toDF("lemma", "cls")
    rows = raw.select(F.lower(F.trim("lemma")).alias("lemma"), F.upper(F.trim("cls")).alias("cls"), F.monotonically_increasing_id().alias("_n"))
    last = rows.where("lemma <> ''").groupBy("lemma").agg(F.max_by("cls", "_n").alias("cls"))
    return last.withColumn("cls", F.when(F.col("cls").isin("COUNT", "MASS", "FLEX"), F.col("cls")).otherwise("UNKNOWN"))


def verb_inventory(spark: SparkSession, path: str) -> DataFrame:
    """``lemma, kind, prep, particle, separable, ord``; unsupported frames drop out."""
    schema = "lemma string, frames array<struct<type:string,prep:string,preposition:string,particle:string,separable:boolean>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    got = raw.select(F.lower(F.trim("lemma")).alias("lemma"), F.posexplode("frames").alias("ord", "f")).where(F.col("f.type").isin(FRAME_KINDS))
    low = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    return got.where("lemma <> ''").select(
        "lemma", F.col("f.type").alias("kind"), low(F.coalesce("f.prep", "f.preposition")).alias("prep"), low(F.col("f.particle")).alias("particle"),
        F.coalesce("f.separable", F.lit(False)).alias("separable"), "ord",
    )


def write_verb_inventory(frames: DataFrame, path: str) -> None:
    one = F.struct(F.col("kind").alias("type"), "prep", "particle")
    frames.groupBy("lemma").agg(F.array_sort(F.collect_set(one)).alias("frames")).orderBy("lemma").write.mode("overwrite").json(path)


def gender_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``lemma, gender`` of a flat or nested payload; a missing file gives no rows."""
    data = _json(path)
    data = data.get("lemmas", data) if isinstance(data, dict) else {}
    rows = [(str(x).strip().lower(), g) for g in ("female", "male") for x in (data.get(g) or []) if str(x).strip()]
    return spark.createDataFrame(rows, "lemma string, gender string").distinct()


def lemma_gender(lexicon: DataFrame) -> DataFrame:
    """One gender per lemma, female first."""
    return lexicon.groupBy("lemma").agg(F.min("gender").alias("gender"))


def clause_lists(spark: SparkSession, path: str) -> DataFrame:
    """``list_name, lemma, ord`` of whitelists; a missing or broken file gives no rows."""
    data = _json(path)
    rows = []
    for k, v in data.items() if isinstance(data, dict) else []:
        if isinstance(v, list):
            rows += [(k, str(x), i) for i, x in enumerate(v)]
        elif isinstance(v, dict) and k == "wh":
            rows += [(f"wh.{w}", str(x), i) for w, xs in v.items() if isinstance(xs, list) for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "list_name string, lemma string, ord int")


def lexicon_lemmas(lexicon: DataFrame, pos: str) -> DataFrame:
    """Plain lower-case lemmas of a part of speech, numbered by name."""
    got = lexicon.where(F.col("pos") == pos).select(F.lower("lemma").alias("lemma")).where(F.col("lemma").rlike("^[a-z]+$")).distinct()
    return got.withColumn("ord", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("lemma")))
