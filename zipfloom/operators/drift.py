"""Schemas that drift between files: find the changes, read all as one table.

Each file's schema is a graph of names, types and nesting.  Similarity flooding
(Melnik, Garcia-Molina, Rahm 2002) scores every vanished field against every
new one, starting from the likeness of their names and of a sketch of their
values; the correspondences that it selects are the candidates for renames, and
equal values of records that both files hold confirm them.  The one table also
joins selected names that are alike, unless the values speak against it.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import BROADCAST_ROWS, materialise

#: Distinct (file, field) counters that a task holds before it emits them.
HELD_FIELDS = 100_000
ROUNDS, TOLERANCE = 50, 1e-4
#: A pair is a candidate if its score is this part of the best of either field.
RELATIVE = 0.4
#: Least hashes of a field's values that its sketch keeps; the share of common ones that counts as full likeness.
SKETCH, FULL_OVERLAP = 32, 0.25
#: Likeness of names from which a correspondence that flooding selects is joined
#: without equal values.  Scores shrink with the size of the graphs, so none is
#: a bound for all.
ALIKE = 0.6
#: Parts that a file's lines are joined in where the fields under comparison are too many to broadcast.
SALTS = 16
#: Columns of the one table; fields beyond stay whole in its map ``other_fields``.
MAX_COLUMNS = 2_000


def _number(text: str) -> float | int:
    if "." in text:
        return float(text)
    value = float(text)
    return int(value) if abs(value) < 1e300 else value


def _no_constant(text: str):
    raise ValueError(text)


_DECODER = json.JSONDecoder(parse_constant=_no_constant)
#: For lines that may hold numbers with an exponent, which are decimals only if written with a point.
_EXPONENTS = json.JSONDecoder(parse_float=_number, parse_constant=_no_constant)
_EXPONENT = re.compile(r"[0-9][eE][-+0-9]")
_ENCODE = json.JSONEncoder(sort_keys=True).encode


def parse_object(payload: str | None) -> dict | None:
    """The line's JSON object, or None if it isn't a complete one."""
    if not payload:
        return None
    try:
        got = (_EXPONENTS if _EXPONENT.search(payload) else _DECODER).decode(payload)
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


_KIND = {str: "string", int: "integer", float: "decimal", bool: "boolean", list: "array", dict: "object", type(None): "null"}


def kind_of(value: object) -> str:
    return _KIND[type(value)]


#: Marks beside an integer field's type: values beyond a double's exact range, and beyond 64 bits.
LONG, WIDE = "integer>53", "integer>63"


class _Names:
    """Numbers for (parent, field, type), so that a line's fields are counted as integers."""

    def __init__(self) -> None:
        self.entries: list[tuple[str, str, str]] = []
        self.parents: list[str] = [""]
        self.below: list[dict] = [{}]  # of each parent: field -> type -> number, and None -> number as a parent

    def _enter(self, parent: int, field: str, kind: str) -> int:
        self.entries.append((self.parents[parent], field, kind))
        return len(self.entries) - 1

    def of(self, o: dict) -> set[int]:
        """Every field at every depth; of an array's objects each counts."""
        out = set()
        todo: list[tuple[int, object]] = [(0, o)]
        while todo:
            parent, node = todo.pop()
            if type(node) is list:
                todo += [(parent, v) for v in node if type(v) is dict or type(v) is list]
                continue
            fields = self.below[parent]
            for k, v in node.items():
                t = type(v)
                known = fields.get(k)
                if known is None:
                    known = fields[k] = {}
                i = known.get(t)
                if i is None:
                    i = known[t] = self._enter(parent, k, _KIND[t])
                out.add(i)
                if t is dict or t is list:
                    if v:
                        child = known.get(None)
                        if child is None:
                            child = known[None] = len(self.parents)
                            self.parents.append(f"{self.parents[parent]}{k}\x1f")
                            self.below.append({})
                        todo.append((child, v))
                elif t is int and not -(1 << 53) <= v <= 1 << 53:
                    mark = LONG if -(1 << 63) <= v < 1 << 63 else WIDE
                    if mark not in known:
                        known[mark] = self._enter(parent, k, mark)
                    out.add(known[mark])
        return out


_CODE = {k: i for i, k in enumerate(_KIND.values())}


def _hash(value: object) -> int:
    """A bigint whose lowest three bits are the value's type."""
    text = value if type(value) is str else _ENCODE(value)
    kind = _KIND[type(value)]
    digest = xxhash.xxh3_64_intdigest(f"{kind}:{text}".encode("utf-8", "surrogatepass"))
    return (digest & ~7 | _CODE[kind]) - (1 << 63)


_SCANNED = pa.schema(
    [("part", pa.string()), ("file_stream", pa.string()), ("file_ts", pa.string()), ("file_name", pa.string()), ("line_no", pa.int64()),
     ("rec", pa.int64()), ("held", pa.map_(pa.string(), pa.int64())), ("parent", pa.string()), ("field", pa.string()), ("kind", pa.string()),
     ("n", pa.int64()), ("mins", pa.list_(pa.int64()))]
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over the lines: hashed values of each line, counted fields of each file."""
    names = _Names()
    held: dict[tuple, Counter] = {}
    sketch: dict[tuple, np.ndarray] = {}

    def out(part: str, size: int, **cols: pa.Array) -> pa.RecordBatch:
        cols["part"] = pa.array([part] * size, pa.string())
        return pa.RecordBatch.from_arrays([cols[f.name] if f.name in cols else pa.nulls(size, f.type) for f in _SCANNED], schema=_SCANNED)

    def fields() -> pa.RecordBatch:
        none = (None, None, None)
        rows = [(*file, *(none if i < 0 else names.entries[i])) for file, c in held.items() for i in c]
        cols = list(zip(*rows)) or [[]] * 6
        labels = ["file_stream", "file_ts", "file_name", "parent", "field", "kind"]
        mins = [sketch.get((r[:3], r[4], r[5])) if r[3] == "" else None for r in rows]
        got = out(
            "field", len(rows), n=pa.array([n for c in held.values() for n in c.values()], pa.int64()), mins=pa.array(mins, pa.list_(pa.int64())),
            **{c: pa.array(v, pa.string()) for c, v in zip(labels, cols)},
        )
        held.clear()
        sketch.clear()
        return got

    for batch in batches:
        stream, ts, file_name, line_no, payload = (c.to_pylist() for c in batch.columns)
        files, nos, recs, keys, values, ends = [], [], [], [], [], [0]
        seen: dict[tuple, list[int]] = {}
        for s, t, f, no, p in zip(stream, ts, file_name, line_no, payload):
            o = parse_object(p)
            file = (s, t, f)
            counts = held.get(file)
            if counts is None:
                counts = held[file] = Counter({-1: 0})
            if o is None:
                continue
            counts.update(names.of(o))
            sub, idx = o.get("subtask"), o.get("idx")
            for k, v in o.items():
                if v is not None and k != "subtask" and k != "idx":
                    h = _hash(v)
                    seen.setdefault((file, k, _KIND[type(v)]), []).append(h)
                    keys.append(k)
                    values.append(h)
            if sub is None or idx is None:
                del keys[ends[-1] :], values[ends[-1] :]
                continue
            sub = str(sub).strip().lower().replace("-", "_")
            files.append(f)
            nos.append(no)
            recs.append(xxhash.xxh3_64_intdigest(f"{sub}\x1f{idx}".encode("utf-8", "surrogatepass")) - (1 << 63))
            ends.append(len(keys))
        for at, hashes in seen.items():
            every = np.unique(np.r_[np.array(hashes, np.int64), sketch.get(at, np.empty(0, np.int64))])
            sketch[at] = every[:SKETCH]
        if files:
            maps = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.int64()))
            yield out(
                "line", len(files), file_name=pa.array(files, pa.string()), line_no=pa.array(nos, pa.int64()),
                rec=pa.array(recs, pa.int64()), held=maps,
            )
        if sum(map(len, held.values())) > HELD_FIELDS:
            yield fields()
            names = _Names()
    yield fields()


class Scan(NamedTuple):
    """What one pass over the lines leaves: ``schemas`` of files and ``prints`` of lines."""

    schemas: DataFrame
    prints: DataFrame


def scan(lines: DataFrame) -> Scan:
    """Parse the lines once.

    ``schemas``: one row per file, ``file_stream, file_ts, file_name, fields``;
    fields has (parent, field, kind, n, mins) of every field at any depth, of
    each object of an array; parent is empty at the top, where mins sketches the
    values.  ``prints``: file_name, line_no, rec (the hashed subtask and idx) and
    the hashed top-level values of each line that has both.

    Lines that aren't a complete JSON object count for no field, as do those
    nested too deep for the parser.  Lines without file_stream or file_name
    belong to no file and are left out.
    """
    src = lines.where(F.col("file_name").isNotNull() & F.col("file_stream").isNotNull()).select(
        "file_stream", F.col("file_ts").cast("string").alias("file_ts"), "file_name", F.col("line_no").cast("bigint").alias("line_no"), "payload"
    )
    kind = (
        "part string, file_stream string, file_ts string, file_name string, line_no bigint, rec bigint, held map<string,bigint>, "
        "parent string, field string, kind string, n bigint, mins array<bigint>"
    )
    got = materialise(src.mapInArrow(_scan, kind), "scan", by="part")
    by = ["file_stream", "file_ts", "file_name"]
    counted = got.where("part = 'field'").groupBy(*by, "parent", "field", "kind").agg(
        F.sum("n").alias("n"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("mins")))), 1, SKETCH).alias("mins")
    )
    one = F.when(F.col("field").isNotNull(), F.struct("parent", "field", "kind", "n", "mins"))
    schemas = materialise(counted.groupBy(*by).agg(F.collect_list(one).alias("fields")), "schemas")
    return Scan(schemas, got.where("part = 'line'").select("file_name", "line_no", "rec", "held"))


def file_schemas(lines: DataFrame) -> DataFrame:
    """The schema of each file, see :func:`scan`."""
    return scan(lines).schemas


def _grams(name: str) -> set[str]:
    s = f"  {name.lower()} "
    return {s[i : i + 3] for i in range(len(s) - 2)}


def name_likeness(a: str, b: str) -> float:
    x, y = _grams(a), _grams(b)
    return 2 * len(x & y) / (len(x) + len(y))


def flood(
    a: list[tuple[str, str, str]], b: list[tuple[str, str, str]], overlap: dict[tuple[str, str], float] | None = None
) -> dict[tuple[str, str], float]:
    """Similarity flooding over two schema graphs.

    ``a`` and ``b`` list (parent, field, kind).  Nodes are the root, each field
    and each kind; edges are ``child`` and ``kind``.  ``overlap`` is the
    likeness of the values of pairs of top-level fields, from which a pair
    starts where its names are less alike.  Returns the converged score of every
    pair of top-level fields, at most 1.
    """

    def graph(s: list[tuple[str, str, str]]) -> tuple[list[str], dict[str, np.ndarray], list[str]]:
        nodes = ["\x1eroot", *sorted({f"{p}{f}" for p, f, _ in s}), *sorted({f"\x1e{k}" for _, _, k in s})]
        at = {n: i for i, n in enumerate(nodes)}
        edges = {"child": np.zeros((len(nodes), len(nodes))), "kind": np.zeros((len(nodes), len(nodes)))}
        for p, f, k in s:
            up = p[:-1] if p else "\x1eroot"
            if up in at:
                edges["child"][at[up], at[f"{p}{f}"]] = 1
            edges["kind"][at[f"{p}{f}"], at[f"\x1e{k}"]] = 1
        return nodes, edges, sorted({f for p, f, _ in s if not p})

    na, ea, top_a = graph(a)
    nb, eb, top_b = graph(b)
    start = np.zeros((len(na), len(nb)))
    for i, x in enumerate(na):
        for j, y in enumerate(nb):
            if x[0] == "\x1e" or y[0] == "\x1e":
                start[i, j] = float(x == y)
            else:
                start[i, j] = max(0.01, name_likeness(x.rpartition("\x1f")[2], y.rpartition("\x1f")[2]), (overlap or {}).get((x, y), 0.0))

    def shared(m: np.ndarray, axis: int) -> np.ndarray:
        total = m.sum(axis=axis, keepdims=True)
        return np.divide(m, total, out=np.zeros_like(m), where=total > 0)

    s = start / start.max()
    for _ in range(ROUNDS):
        base = start + s
        # edges carry a pair's score to the pairs of their ends, divided among them
        flow = sum(
            shared(ea[k], 1).T @ base @ shared(eb[k], 1) + shared(ea[k], 0) @ base @ shared(eb[k], 0).T for k in ea
        )
        new = base + flow
        new /= new.max()
        done = np.abs(new - s).max() < TOLERANCE
        s = new
        if done:
            break
    ia, ib = {n: i for i, n in enumerate(na)}, {n: i for i, n in enumerate(nb)}
    return {(x, y): float(s[ia[x], ib[y]]) for x in top_a for y in top_b}


def select(scores: dict[tuple[str, str], float]) -> dict[str, str]:
    """Consistent correspondences: equal names first, then one to one by score."""
    left, right = {x for x, _ in scores}, {y for _, y in scores}
    chosen = {x: x for x in left & right}
    used = set(chosen)
    for (x, y), _ in sorted(scores.items(), key=lambda kv: (-kv[1], kv[0])):
        if x not in chosen and y not in used and scores[x, y] > 0:
            chosen[x] = y
            used.add(y)
    return chosen


def candidates(scores: dict[tuple[str, str], float], gone: list[str], fresh: list[str]) -> set[tuple[str, str]]:
    """The selection of correspondences to be confirmed by values.

    A vanished and a new field are kept if their score is near the best of
    either (RELATIVE), so that one field may match several new ones; a pair
    without a score is none.
    """
    best_x = {x: max(scores[x, y] for y in fresh) for x in gone}
    best_y = {y: max(scores[x, y] for x in gone) for y in fresh}
    return {(x, y) for x in gone for y in fresh if 0 < scores[x, y] >= RELATIVE * max(best_x[x], best_y[y])}


def _overlap(a: set[int], b: set[int]) -> float:
    """Likeness of two sketches: the share of common values among the least of both, scaled.

    Files that follow each other share part of their records only, so a share
    of FULL_OVERLAP is as good as an equal name.
    """
    least = sorted(a | b)[:SKETCH]
    return min(1.0, sum(h in a and h in b for h in least) / (FULL_OVERLAP * len(least))) if least else 0.0


_CHANGES = "file_stream string, file_name string, prev_name string, field string, drift string, old_field string, score double, chosen boolean, old_kinds string, new_kinds string"


def _compare(exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                out += [(row["file_stream"], row["file_name"], row["prev_name"], *c) for c in _changes(row["prev_fields"], row["fields"], exact)]
            cols = list(zip(*out)) or [[]] * 10
            kinds = [pa.string()] * 6 + [pa.float64(), pa.bool_(), pa.string(), pa.string()]
            names = [c.split()[0] for c in _CHANGES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return run


def _changes(old: list[dict], new: list[dict], exact: bool = False) -> list[tuple]:
    """Changes of the top-level fields; pairs that may be renames are ``renamed?``."""

    def read(fields: list[dict]) -> tuple[list[tuple[str, str, str]], dict[str, set], dict[str, set]]:
        graph = sorted((f["parent"], f["field"], f["kind"]) for f in fields if f["kind"] in _CODE)
        kinds: dict[str, set] = {}
        mins: dict[str, set] = {}
        for f in fields:
            if not f["parent"] and f["kind"] in _CODE:
                kinds.setdefault(f["field"], set()).add(f["kind"])
                mins.setdefault(f["field"], set()).update(f["mins"] or ())
        return graph, {f: k - {"null"} for f, k in kinds.items()}, mins

    (graph_a, a, mins_a), (graph_b, b, mins_b) = read(old), read(new)
    text = lambda k: "|".join(sorted(k))
    out = [
        (f, "retyped", f, 1.0, True, text(a[f]), text(b[f])) for f in sorted(a.keys() & b.keys()) if a[f] and b[f] and a[f] != b[f]
    ]
    gone, fresh = sorted(a.keys() - b.keys()), sorted(b.keys() - a.keys())
    out += [(f, "added", None, None, None, None, text(b[f])) for f in fresh]
    out += [(f, "removed", f, None, None, text(a[f]), None) for f in gone]
    if gone and fresh:
        scores = flood(graph_a, graph_b, {(x, y): _overlap(mins_a[x], mins_b[y]) for x in gone for y in fresh})
        chosen = select(scores)
        kept = {(x, y) for x in gone for y in fresh} if exact else candidates(scores, gone, fresh)
        out += [(y, "renamed?", x, scores[x, y], chosen.get(x) == y, text(a[x]), text(b[y])) for x, y in sorted(kept)]
    return out


def _adjacent(schemas: DataFrame) -> DataFrame:
    """Each file's fields beside those of the stream's previous file.

    The window holds the names of a stream's files only; their fields are joined.
    """
    order = Window.partitionBy("file_stream").orderBy(F.col("file_ts").asc_nulls_first(), "file_name")
    names = schemas.select("file_stream", "file_ts", "file_name")
    before = names.withColumn("prev_name", F.lag("file_name").over(order)).withColumn("prev_ts", F.lag("file_ts").over(order))
    own = schemas.select("file_stream", "file_ts", "file_name", "fields")
    prev = schemas.select(
        "file_stream", F.col("file_ts").alias("prev_ts"), F.col("file_name").alias("prev_name"), F.col("fields").alias("prev_fields")
    )
    p, o = before.where("prev_name is not null").alias("p"), own.alias("o")
    same = (F.col("p.file_stream") == F.col("o.file_stream")) & F.col("p.file_ts").eqNullSafe(F.col("o.file_ts"))
    got = p.join(o, same & (F.col("p.file_name") == F.col("o.file_name"))).select("p.*", "o.fields").alias("g")
    v = prev.alias("v")
    same = (F.col("g.file_stream") == F.col("v.file_stream")) & F.col("g.prev_ts").eqNullSafe(F.col("v.prev_ts"))
    return got.join(v, same & (F.col("g.prev_name") == F.col("v.prev_name"))).select(
        "g.file_stream", "g.file_name", "g.prev_name", "g.fields", "v.prev_fields"
    )


def schema_changes(lines: DataFrame | Scan, exact: bool = False) -> DataFrame:
    """Changes of top-level fields against the stream's previous file.

    Input: ``file_stream, file_ts, file_name, line_no, payload``, or their
    :func:`scan`.  Files of a stream follow each other by (file_ts, file_name);
    a null file_ts is first.  Result: ``file_stream, file_name, prev_name, field,
    drift, old_field, score, old_kinds, new_kinds`` where drift is ``added``,
    ``removed``, ``retyped`` or ``renamed`` (field = the new name) and score is
    the flooding's.

    A new and a vanished field are one renamed field if flooding selects the
    pair (:func:`candidates`) and their values, of one type, are equal in more
    than half of the records, by (subtask, idx), that both files hold with
    non-null values.  ``exact`` asks the values of every pair, whatever its
    score.  Of lines with one (subtask, idx) in a file the last line's value
    counts.

    Defined cases: null, empty and broken lines and lines of other JSON values
    count for no field; repeated lines change nothing; a file without any whole
    object has no fields; an empty table gives no rows; other columns are
    ignored, whatever their names.

    Scale: lines are parsed once and shrink to counted fields in their task;
    windows run over files' names, not lines; of the values only hashes of
    fields under comparison are shuffled, by record.
    """
    return decided(compared(lines, exact))


def compared(lines: DataFrame | Scan, exact: bool = False) -> DataFrame:
    """The changes before renames are decided, as a written table.

    A vanished and a new field are ``renamed?`` here, beside ``added`` and
    ``removed``, with ``chosen`` (flooding selects the pair one to one) and the
    numbers of shared records: ``both`` with values on both sides, ``alike``
    with values of one type, ``same`` with equal ones; null where no record is
    shared.
    """
    known = lines if isinstance(lines, Scan) else scan(lines)
    changes = materialise(_adjacent(known.schemas).mapInArrow(_compare(exact), _CHANGES), "changes")
    tried = changes.where(F.col("drift") == "renamed?")
    pair = [F.col("file_name").alias("pair"), F.col("old_field").alias("was_name"), F.col("field").alias("now_name")]
    wanted = tried.select(F.col("prev_name").alias("file_name"), F.lit(0).alias("side"), F.col("old_field").alias("name"), *pair).unionByName(
        tried.select(F.col("file_name"), F.lit(1).alias("side"), F.col("field").alias("name"), *pair)
    )
    prints = known.prints
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        met = prints.join(F.broadcast(wanted), "file_name")
    else:  # a large file's lines are spread over the join's tasks
        salted = wanted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = prints.withColumn("_salt", F.pmod("rec", F.lit(SALTS)).cast("int")).join(salted, ["file_name", "_salt"])
    value = met.select("pair", "was_name", "now_name", "rec", "side", "line_no", F.col("held")[F.col("name")].alias("value")).where(
        "value is not null"
    )
    last = lambda side: F.max(F.when(F.col("side") == side, F.struct("line_no", "value")))["value"]
    each = value.groupBy("pair", "was_name", "now_name", "rec").agg(last(0).alias("was"), last(1).alias("now"))
    kind = lambda c: F.col(c).bitwiseAND(7)
    counts = (
        each.where("was is not null and now is not null")
        .groupBy("pair", "was_name", "now_name")
        .agg(F.count("*").alias("both"), F.count_if(kind("was") == kind("now")).alias("alike"), F.count_if(F.col("was") == F.col("now")).alias("same"))
        .select(
            F.col("pair").alias("file_name"), F.col("was_name").alias("old_field"), F.col("now_name").alias("field"),
            F.lit("renamed?").alias("drift"), "both", "alike", "same",
        )
    )
    return materialise(changes.join(counts, ["file_name", "old_field", "field", "drift"], "left"), "drift")


def nested_changes(lines: DataFrame | Scan) -> DataFrame:
    """Fields below the top level that are added, removed or retyped against the stream's previous file.

    ``file_stream, file_name, prev_name, path, drift, old_kinds, new_kinds``;
    path joins the names by ``.``.  Fields below one that is new or gone itself
    are listed as well.
    """
    schemas = (lines if isinstance(lines, Scan) else scan(lines)).schemas
    inner = lambda c: F.filter(c, lambda f: (f["parent"] != "") & f["kind"].isin(*_CODE))
    both = _adjacent(schemas).select(
        "file_stream", "file_name", "prev_name",
        F.concat(
            F.transform(inner("prev_fields"), lambda f: F.struct(f["parent"], f["field"], f["kind"], F.lit(0).alias("side"))),
            F.transform(inner("fields"), lambda f: F.struct(f["parent"], f["field"], f["kind"], F.lit(1).alias("side"))),
        ).alias("f"),
    )
    flat = both.select("file_stream", "file_name", "prev_name", F.explode("f").alias("f"))
    path = F.concat(F.translate(F.col("f.parent"), "\x1f", "."), F.col("f.field")).alias("path")
    kinds = lambda side: F.array_join(
        F.array_sort(F.collect_set(F.when((F.col("f.side") == side) & (F.col("f.kind") != "null"), F.col("f.kind")))), "|"
    )
    got = flat.groupBy("file_stream", "file_name", "prev_name", path).agg(
        F.max(F.col("f.side") == 0).alias("_was"), F.max(F.col("f.side") == 1).alias("_is"), kinds(0).alias("old_kinds"), kinds(1).alias("new_kinds")
    )
    told = (F.col("old_kinds") != "") & (F.col("new_kinds") != "") & (F.col("old_kinds") != F.col("new_kinds"))
    drift = F.when(~F.col("_was"), "added").when(~F.col("_is"), "removed").when(told, "retyped")
    return got.withColumn("drift", drift).where("drift is not null").select(
        "file_stream", "file_name", "prev_name", "path", "drift", "old_kinds", "new_kinds"
    )


def decided(changes: DataFrame) -> DataFrame:
    """:func:`schema_changes` out of what :func:`compared` gives."""
    renamed = changes.where((F.col("drift") == "renamed?") & (F.col("same") * 2 > F.col("both")))
    best = Window.partitionBy("file_name", "field").orderBy(F.desc("chosen"), F.desc("score"), "old_field")
    first = renamed.withColumn("_n", F.row_number().over(best)).where("_n = 1").withColumn("drift", F.lit("renamed"))
    taken = renamed.select("file_name", F.explode(F.array("field", "old_field")).alias("field"), F.lit(True).alias("_hit")).distinct()
    plain = changes.where(F.col("drift") != "renamed?").join(taken, ["file_name", "field"], "left")
    rest = plain.where((F.col("drift") == "retyped") | F.col("_hit").isNull())
    cols = ["file_stream", "file_name", "prev_name", "field", "drift", "old_field", "score", "old_kinds", "new_kinds"]
    return rest.select(*cols).unionByName(first.select(*cols))


def _folded(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum()) or name


def _selected(tried: DataFrame) -> list[tuple[str, str]]:
    """Pairs of names that flooding selected and that are alike, the most alike first.

    Values of one type that mostly differ in shared records refute a pair,
    unless its names differ in case and separators only.
    """
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    got = tried.where("drift = 'renamed?' and chosen").groupBy("old_field", "field").agg(
        F.count("*").alias("files"), F.max("score").alias("score"), n("alike"), n("same")
    )
    out = []
    for r in got.collect():
        x, y = r["old_field"], r["field"]
        one = _folded(x) == _folded(y)
        like = 1.0 if one else name_likeness(x, y)
        if one or (like >= ALIKE and not (r["alike"] and r["same"] * 2 <= r["alike"])):
            out.append((-like, -r["files"], -r["score"], x, y))
    return [(x, y) for *_, x, y in sorted(out)]


def canonical_names(tried: DataFrame, schemas: DataFrame) -> dict[str, tuple[str, str]]:
    """Each field name's name and type in the one consistent table.

    ``tried``: the lines' :func:`compared`.  Renames are joined, the best
    attested first, then the names that flooding selected for each other between
    adjacent files if they are alike (:data:`ALIKE`), as for fields that are
    renamed and retyped at once or share no records, unless two names of one
    field occur together in a file.  The name that most files have stands for
    the field.

    Works on distinct names: the MAX_COLUMNS that most files have, as a table
    can't have more columns; rarer names stay in the table's map of other fields.
    """
    fields = schemas.select("file_name", F.explode("fields").alias("f")).where("f.parent = ''")
    kinds = fields.groupBy("f.field").agg(F.collect_set("f.kind").alias("kinds"), F.count_distinct("file_name").alias("n"))
    top = kinds.orderBy(F.desc("n"), "field").limit(MAX_COLUMNS).collect()
    known = {r["field"]: (set(r["kinds"]) - {"null"}, r["n"]) for r in top}
    # no more than the pairs of known names
    pairs = tried.where(F.col("field").isin(list(known)) & F.col("old_field").isin(list(known)))
    proven = decided(pairs).where("drift = 'renamed'").groupBy("old_field", "field").count().collect()
    edges = [(e["old_field"], e["field"]) for e in sorted(proven, key=lambda e: (-e["count"], e["old_field"], e["field"]))]
    edges += [e for e in _selected(pairs) if e not in edges]
    ends = sorted({x for e in edges for x in e})
    together: set[tuple[str, str]] = set()
    if ends:
        own = fields.where(F.col("f.field").isin(ends)).select("file_name", F.col("f.field").alias("field")).distinct()
        met = own.alias("a").join(own.alias("b"), (F.col("a.file_name") == F.col("b.file_name")) & (F.col("a.field") < F.col("b.field")))
        for r in met.select("a.field", F.col("b.field").alias("other")).distinct().collect():
            together |= {(r["field"], r["other"]), (r["other"], r["field"])}
    group = {f: {f} for f in known}
    for old, new in edges:
        x, y = group[old], group[new]
        if x is not y and not any((p, q) in together for p in x for q in y):
            x |= y
            for f in y:
                group[f] = x
    out = {}
    for f in known:
        name = min(group[f], key=lambda g: (-known[g][1], g))
        every = set().union(*(known[g][0] for g in group[f]))
        plain = every - {LONG, WIDE}
        kind = "string"
        if plain == {"boolean"}:
            kind = "boolean"
        elif plain == {"integer"} and WIDE not in every:
            kind = "bigint"
        elif plain and plain <= {"integer", "decimal"} and plain == every:
            kind = "double"
        out[f] = (name, kind)
    return out


def unified_table(lines: DataFrame, names: dict[str, tuple[str, str]]) -> DataFrame:
    """All lines as one table: each field cast to its type under one name.

    ``status`` is ``ok``, ``empty`` (null or blank) or ``broken``; the latter two
    have nulls for every field.  Nested values and values of mixed types become
    text, nested ones as JSON; so do integers beyond 64 bits, and integers that
    a double can't hold where decimals occur.  The map ``other_fields`` keeps, as
    text, what has no place in the columns: fields without a name in ``names``,
    values that don't fit their column's type, and the value of a second name
    where two names of one field meet in a line.  Columns whose names equal one
    of the line's own get the suffix ``_field``.
    """
    own = ["line_id", "file_name", "line_no", "status"]
    cols = sorted({v for v in names.values()})
    used = {o.lower() for o in [*own, "other_fields"]}
    label, seen = {}, {}
    for c, _ in cols:
        base = f"{c}_field" if c.lower() in used else c
        seen[base.lower()] = seen.get(base.lower(), 0) + 1
        label[c] = base if seen[base.lower()] == 1 else f"{base}_{seen[base.lower()]}"
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
    target = dict(cols)

    def text(v: object) -> str:
        return v if type(v) is str else json.dumps(v, ensure_ascii=False)

    def fits(v: object, kind: str) -> bool:
        if kind == "bigint":
            return type(v) is int and -(1 << 63) <= v < 1 << 63
        if kind == "double":
            return type(v) is float or type(v) is int and -(1 << 53) <= v <= 1 << 53
        return kind == "string" or type(v) is bool

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c, _ in cols}
            status, other = [], []
            for p in batch.column(3).to_pylist():
                o = parse_object(p)
                status.append("ok" if o is not None else "broken" if p and p.strip() else "empty")
                got: dict[str, object] = {}
                rest: list[tuple[str, str]] = []
                for k, v in (o or {}).items():
                    if v is None:
                        continue
                    c = names[k][0] if k in names else None
                    if c is None or c in got or not fits(v, target[c]):
                        rest.append((k, text(v)))
                    else:
                        got[c] = text(v) if target[c] == "string" else float(v) if target[c] == "double" else v
                for c, _ in cols:
                    out[c].append(got.get(c))
                other.append(rest or None)
            maps = pa.array(other, pa.map_(pa.string(), pa.string()))
            arrays = [*batch.columns[:3], pa.array(status, pa.string()), *[pa.array(out[c], kinds[k]) for c, k in cols], maps]
            yield pa.RecordBatch.from_arrays(arrays, names=[*own, *[label[c] for c, _ in cols], "other_fields"])

    schema = ", ".join(
        ["line_id bigint", "file_name string", "line_no bigint", "status string", *[f"`{label[c]}` {k}" for c, k in cols],
         "other_fields map<string,string>"]
    )
    source = lines.select(F.col("line_id").cast("bigint"), "file_name", F.col("line_no").cast("bigint"), "payload")
    return source.mapInArrow(read, schema)
