"""Deeply nested records as related flat tables.

One depth-first visitor passes over each record once and emits rows: a table
tag, the row's key, its parent's key and the payload in the columns of the
table's schema.  Every array of objects and every map of objects, at any depth,
is a table of its own; objects that stand alone belong to the row around them.
Typed columns are visited as Arrow trees, JSON text as values, by the same
rules.  The rows are written once, partitioned by tag.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from ..runtime import materialise
from .drift import parse_object

AGGREGATES = "zipf_swapped_position_aggregates"
Path = tuple[str, ...]

#: Schemas of the flat tables, fields in natural order; a table's rows are the nodes whose path :func:`table_of` gives it.
SCHEMAS = {
    "record": "phenomenon string, subtask string, idx int, variant string, field string, swap_failed_reason string",
    "swaps": "i int, old string, new string, tag string, lemma string, pos string, frame string",
    "preps": "i int, old string, new string",
    "aggregates": "n int, oov_count int, mean double, median double, min double",
}
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
_FIELDS = {t: [tuple(f.split()) for f in s.split(", ")] for t, s in SCHEMAS.items()}
_STRUCTS = {t: pa.struct([(f, _ARROW[k]) for f, k in fs]) for t, fs in _FIELDS.items()}


@lru_cache(10_000)
def is_swaps(path: Path) -> bool:
    """A meta field that holds swaps: an array, or a lone object as its element 0."""
    return len(path) == 2 and path[0] == "meta" and path[1].endswith("_swaps")


@lru_cache(10_000)
def table_of(path: Path) -> str:
    """The table whose schema a path's rows have; ``other`` where none is known."""
    if not path:
        return "record"
    if is_swaps(path):
        return "swaps"
    if len(path) == 3 and is_swaps(path[:2]) and path[2] == "preps":
        return "preps"
    return "aggregates" if path == ("meta", AGGREGATES) else "other"


@lru_cache(10_000)
def _tag(path: Path) -> str:
    """Names from the record to the table; ``meta``, where they all are, is left out."""
    return ".".join(path[1:] if path[:1] == ("meta",) and len(path) > 1 else path)


# ---- values (JSON text) -----------------------------------------------------


def visit(record: dict, emit: Callable[[Path, str, str, object], None]) -> None:
    """Depth-first over one record; ``emit(path, key, parent, own)``.

    ``own`` is what a row holds itself: its fields without those that are tables,
    fields of lone objects under joined names, or a bare value.  ``meta`` may be
    JSON text.  Children are the non-null elements of every array that holds an
    object (key = position from 0, nulls counted), of ``*_swaps`` and ``preps``
    whatever they hold (a lone object is element 0), and the non-null values of
    the aggregates map (key = map key).  A key goes on from its parent's by a
    point.
    """
    todo: list[tuple[Path, str, str, object]] = [((), "", "", record)]
    while todo:
        path, key, parent, node = todo.pop()
        if type(node) is not dict:
            emit(path, key, parent, node)
            continue
        own: dict[str, object] = {}
        found = []
        inner: list[tuple[Path, str, dict]] = [(path, "", node)]
        while inner:
            at, prefix, obj = inner.pop()
            for k, v in obj.items():
                kind = type(v)
                if kind is str and k == "meta" and not at and (read := parse_object(v)) is not None:
                    v, kind = read, dict
                if kind is not dict and kind is not list:
                    own[f"{prefix}{k}" if prefix else k] = v
                    continue
                here = (*at, k)
                known = table_of(here)
                children: list[tuple[str, object]] | None = None
                if known == "aggregates":
                    children = list(v.items()) if kind is dict else None
                elif kind is list and (known != "other" or any(type(e) is dict for e in v)):
                    children = [(str(i), e) for i, e in enumerate(v)]
                elif known != "other" and kind is dict:
                    children = [("0", v)]
                elif kind is dict and v:
                    inner.append((here, f"{prefix}{k}.", v))
                    continue
                if children is None:
                    own[f"{prefix}{k}"] = v
                else:
                    found += [(here, f"{key}.{c}" if key else c, key, e) for c, e in children if e is not None]
        emit(path, key, parent, own)
        todo += reversed(found)


def _fits(v: object, kind: str) -> bool:
    if kind == "int":
        return type(v) is int and -(1 << 31) <= v < 1 << 31
    if kind == "bigint":
        return type(v) is int and -(1 << 63) <= v < 1 << 63
    if kind == "double":
        return type(v) is float or type(v) is int and -(1 << 53) <= v <= 1 << 53
    return type(v) is (str if kind == "string" else bool)


_SHORT = {t: {f: k for f, k in fs} for t, fs in _FIELDS.items()}


def _split(own: object, table: str) -> tuple[dict | None, list[tuple[str, str]] | None]:
    """A row's values under its table's schema, and as text what that has no place for."""
    if type(own) is not dict:
        return {} if table in SCHEMAS else None, [("", json.dumps(own, ensure_ascii=False))]
    schema = _SHORT.get(table, {})
    got: dict[str, object] = {}
    rest = []
    for k, v in own.items():
        if v is None:
            continue
        name = k[5:] if table == "record" and k.startswith("meta.") and k[5:] in schema and k[5:] not in own else k
        if name in schema and name not in got and _fits(v, schema[name]):
            got[name] = float(v) if schema[name] == "double" else v
        else:
            rest.append((k, v if type(v) is str else json.dumps(v, ensure_ascii=False)))
    return got if table in SCHEMAS else None, rest or None


_ROW = pa.schema(
    [("rec_id", pa.int64()), ("child", pa.string()), ("child_key", pa.string()), ("parent_key", pa.string()),
     *[(t, s) for t, s in _STRUCTS.items()], ("rest", pa.map_(pa.string(), pa.string()))]
)
ROW = (
    "rec_id bigint, child string, child_key string, parent_key string, "
    + ", ".join(f"`{t}` struct<" + ",".join(f"`{f}`:{k}" for f, k in fs) + ">" for t, fs in _FIELDS.items())
    + ", rest map<string,string>"
)


def _rows(n: int, **cols: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([cols[f.name] if f.name in cols else pa.nulls(n, f.type) for f in _ROW], schema=_ROW)


def _encodable(x: object) -> object:
    """Text of a row, wherever it stands in it, with lone surrogates as their JSON escapes."""
    if type(x) is str:
        return x.encode("utf-8", "backslashreplace").decode("utf-8")
    if type(x) is dict:
        return {k: _encodable(v) for k, v in x.items()}
    return type(x)(map(_encodable, x)) if type(x) in (list, tuple) else x


def _batch_of(table: str, found: list[tuple]) -> pa.RecordBatch:
    rec, tag, key, parent, values, rest = zip(*found)
    more = {table: pa.array(values, _STRUCTS[table])} if table in _STRUCTS else {}
    return _rows(
        len(rec), rec_id=pa.array(rec, pa.int64()), child=pa.array(tag, pa.string()), child_key=pa.array(key, pa.string()),
        parent_key=pa.array(parent, pa.string()), rest=pa.array(rest, _ROW.field("rest").type), **more,
    )


def _flat_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held: dict[str, list[tuple]] = {}
        ids = batch.column(0).to_pylist()
        for rec, text in zip(ids, batch.column(1).to_pylist()):
            o = parse_object(text)
            if o is None:
                continue

            def emit(path: Path, key: str, parent: str, own: object) -> None:
                table = table_of(path)
                held.setdefault(table, []).append((rec, _tag(path), key, parent, *_split(own, table)))

            visit(o, emit)
        for table, found in held.items():
            try:
                yield _batch_of(table, found)
            except UnicodeEncodeError:  # lone surrogates
                yield _batch_of(table, [tuple(_encodable(x) for x in row) for row in found])


# ---- typed columns (Arrow trees) --------------------------------------------


def _elements(child: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array | None]:
    """(owner, position, element, map key) of every non-null element of a list or map array."""
    offsets = child.offsets.to_numpy()
    n = np.where(child.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    owner = np.repeat(np.arange(len(n)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = pa.array(np.repeat(offsets[:-1], n) + within)
    is_map = pa.types.is_map(child.type)
    items = (child.items if is_map else child.values).take(at)
    there = items.is_valid().to_numpy(zero_copy_only=False)
    keys = child.keys.take(at).cast(pa.string()).filter(pa.array(there)) if is_map else None
    return owner[there], within[there], items.filter(pa.array(there)), keys


def _is_table(kind: pa.DataType) -> bool:
    inner = kind.item_type if pa.types.is_map(kind) else kind.value_type if pa.types.is_list(kind) or pa.types.is_large_list(kind) else None
    return inner is not None and pa.types.is_struct(inner)


def visit_tree(column: pa.StructArray, emit: Callable[[Path, np.ndarray, np.ndarray, np.ndarray, dict[str, pa.Array]], None]) -> None:
    """The visitor over a struct column: ``emit(path, row, key, parent, own)`` once per table, all rows at once."""
    none = np.full(len(column), "", object)
    todo = [(("meta",), np.arange(len(column)), none, none, column)]
    while todo:
        path, row, key, parent, node = todo.pop()
        own: dict[str, pa.Array] = {}
        found = []
        inner = [(path, "", node)]
        while inner:
            at, prefix, obj = inner.pop()
            for f, child in zip(obj.type, obj.flatten()):
                here = (*at, f.name)
                if pa.types.is_struct(child.type):
                    inner.append((here, f"{prefix}{f.name}.", child))
                elif _is_table(child.type):
                    owner, position, items, keys = _elements(child)
                    name = keys.to_numpy(zero_copy_only=False) if keys is not None else position.astype(str).astype(object)
                    up = key[owner]
                    joined = np.array([f"{a}.{b}" if a else b for a, b in zip(up, name)], object) if len(up) and up[0] else name
                    found.append((here, row[owner], joined, up, items))
                else:
                    own[f"{prefix}{f.name}"] = child
        emit(path if len(path) > 1 else (), row, key, parent, own)
        todo += reversed(found)


def _flat_column(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        out: list[pa.RecordBatch] = []

        def emit(path: Path, row: np.ndarray, key: np.ndarray, parent: np.ndarray, own: dict[str, pa.Array]) -> None:
            table, n = table_of(path), len(row)
            got, rest = [], {}
            schema = _SHORT.get(table, {})
            for name, kind in schema.items():
                col = own.get(name)
                try:
                    got.append(pa.nulls(n, _ARROW[kind]) if col is None else col.cast(_ARROW[kind]))
                except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
                    got.append(pa.nulls(n, _ARROW[kind]))
                    rest[name] = col
            rest.update({k: v for k, v in own.items() if k not in schema})
            cols = {}
            if table in _STRUCTS:
                cols[table] = pa.StructArray.from_arrays(got, fields=list(_STRUCTS[table])) if n else pa.nulls(0, _STRUCTS[table])
            if rest:
                texts = {k: v.to_pylist() for k, v in rest.items()}
                plain = lambda v: v if type(v) is str else json.dumps(v, ensure_ascii=False, default=str)
                each = [[(k, plain(v[i])) for k, v in texts.items() if v[i] is not None] or None for i in range(n)]
                cols["rest"] = pa.array(each, _ROW.field("rest").type)
            out.append(
                _rows(
                    n, rec_id=ids.take(pa.array(row)), child=pa.array([_tag(path)] * n, pa.string()), child_key=pa.array(key, pa.string()),
                    parent_key=pa.array(parent, pa.string()), **cols,
                )
            )

        visit_tree(batch.column(1), emit)
        yield from out


# ---- tables -----------------------------------------------------------------


def _line_rank() -> Column:
    return F.struct(F.length("_text"), F.xxhash64("_text"))


def _hashable(c: Column, kind: DataType) -> list[Column]:
    """Columns of which a hash tells two values apart; maps, which have no order, as sorted entries."""
    if isinstance(kind, StructType):
        return [x for f in kind for x in _hashable(c[f.name], f.dataType)]
    if isinstance(kind, MapType):
        return [F.to_json(F.array_sort(F.transform(F.map_keys(c), lambda k: F.struct(k.alias("k"), F.to_json(F.struct(c[k].alias("v"))).alias("v")))))]
    if isinstance(kind, ArrayType) and "map<" in kind.simpleString():
        return [F.to_json(c)]
    return [c]


def _lines(lines: DataFrame, key: str, text: str) -> DataFrame:
    return lines.select(F.col(key).cast("bigint").alias("rec_id"), F.col(text).alias("_text"))


def _columns(records: DataFrame, key: str, column: str, version: str) -> DataFrame:
    got = records.select(F.col(key).cast("bigint").alias("rec_id"), F.col(column).alias("_meta"), F.col(version).alias("_ver"))
    parts = _hashable(F.col("_meta"), got.schema["_meta"].dataType)
    return got.select("rec_id", "_meta", F.struct("_ver", F.xxhash64(*parts)).alias("_rank"))


def rows_of_lines(lines: DataFrame, key: str = "line_id", text: str = "payload") -> DataFrame:
    """All rows of all flat tables of JSON lines (:data:`ROW`), the records' own with an empty ``child``.

    Each row has its table's struct filled (``swaps``, ``preps``, ``aggregates``
    or ``record``); ``rest`` holds as text the fields that its schema doesn't
    know, those of another type, and all fields of tables without a schema.
    (rec_id, parent_key) leads to the parent row, an empty parent_key to the
    record.  Rows that share a key count once, and are settled before they are
    visited: the longest text, then the one of the greatest hash, so that a null
    copy doesn't hide a whole line.  Null, empty and broken texts have no rows.
    """
    src = _lines(lines, key, text)
    once = src.groupBy("rec_id").agg(F.max_by("_text", _line_rank()).alias("_text"))
    return once.mapInArrow(_flat_lines, ROW)


def rows_of_column(records: DataFrame, key: str, column: str, version: str) -> DataFrame:
    """The same of a typed struct column, of each record's latest ``version``.

    Rows that tie in version are settled by the column's hash; null versions
    come first; a record whose latest row has a null column has its own row only.
    """
    once = _columns(records, key, column, version).groupBy("rec_id").agg(F.max_by("_meta", "_rank").alias("_meta"))
    return once.mapInArrow(_flat_column, ROW)


def _told_apart(rows: DataFrame) -> DataFrame:
    kind = F.lit("other")
    for t in SCHEMAS:
        kind = F.when(F.col(t).isNotNull(), F.lit(t)).otherwise(kind)
    return rows.withColumn("kind", kind)


def write_tables(rows: DataFrame) -> DataFrame:
    """Write the rows once, partitioned by table; a filter on ``kind`` then reads its own files only."""
    return materialise(_told_apart(rows), "nested", by="kind")


def children(written: DataFrame) -> DataFrame:
    """``rec_id, child, child_key`` of every row of the tables of swaps, prepositions and aggregates."""
    keys = [c for c in written.columns if c == "table_name"]
    return written.where(F.col("kind").isin("swaps", "preps", "aggregates")).select(*keys, "rec_id", "child", "child_key")


def keys_of_column(records: DataFrame, key: str, column: str, version: str) -> DataFrame:
    """The :func:`children` of a typed column, nothing written."""
    return children(_told_apart(rows_of_column(records, key, column, version)))


def flat_table(written: DataFrame, kind: str) -> DataFrame:
    """One flat table: its keys and the fields of its schema; a field of another type is null here and in ``rest``."""
    keys = [c for c in written.columns if c in ("table_name", "rec_id", "child", "child_key", "parent_key")]
    return written.where(F.col("kind") == kind).select(*keys, f"{kind}.*", "rest")


def unplaced(written: DataFrame) -> DataFrame:
    """Fields that no schema has a place for: ``child, field, n_rows``."""
    keys = [c for c in written.columns if c == "table_name"]
    each = written.where("rest is not null").select(*keys, "child", F.explode(F.map_keys("rest")).alias("field"))
    return each.groupBy(*keys, "child", "field").agg(F.count("*").alias("n_rows"))
