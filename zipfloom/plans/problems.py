"""Queries of the general data-quality operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, nested, references
from ..runtime import same_name, same_name_sql, table


def _misses(spark: SparkSession, d: str) -> DataFrame:
    generated = table(spark, d, "generated_pair")
    scores = table(spark, d, "pair_score")
    name = same_name("subtask").alias("subtask")
    pairs = references.orphan_references(
        generated.where("idx is not null").select("record_id", name, "idx", "written_at"),
        table(spark, d, "source_pair").select(name, "idx", "loaded_at", "deleted_at"),
        ["subtask", "idx"],
        ref_id="record_id", ref_time="written_at", start="loaded_at", end="deleted_at",
    )
    records = references.orphan_references(
        scores.where("idx is not null").select("score_id", "dataset", name, "idx", "scored_at"),
        generated.select("dataset", name, "idx", "written_at", "withdrawn_at"),
        ["dataset", "subtask", "idx"],
        ref_id="score_id", ref_time="scored_at", start="written_at", end="withdrawn_at",
    )
    return pairs.withColumn("table_name", F.lit("generated_pair")).unionByName(
        records.withColumn("table_name", F.lit("pair_score"))
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows that name a pair that isn't present at the row's time."""
    return _misses(spark, d).select("table_name", "rec_id").distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Dangling references per table, month and reason; repeated rows count once."""
    once = _misses(spark, d).distinct()
    return (
        once.groupBy("table_name", F.date_format("at", "yyyy-MM").alias("month"), "reason")
        .agg(F.count("*").alias("n_refs"))
    )


_LINES = ["line_id", "file_name", "file_stream", "file_ts", "line_no", "payload"]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Changes of payload fields against the stream's previous file."""
    return drift.schema_changes(table(spark, d, "raw_line").select(*_LINES)).select("file_name", "field", "drift")


def p2_changes(spark: SparkSession, d: str) -> DataFrame:
    """The changes with the previous file, old names and kinds."""
    return drift.schema_changes(table(spark, d, "raw_line").select(*_LINES)).drop("score")


def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    """The correspondences that flooding selects, their scores and the values that confirm or refute them."""
    tried = drift.compared(table(spark, d, "raw_line").select(*_LINES)).where("drift = 'renamed?'")
    return tried.select("file_name", "prev_name", "old_field", "field", F.round("score", 6).alias("score"), "chosen", "both", "alike", "same")


def p2_nested(spark: SparkSession, d: str) -> DataFrame:
    """Changes of fields below the top level."""
    return drift.nested_changes(table(spark, d, "raw_line").select(*_LINES))


def p2_table(spark: SparkSession, d: str) -> DataFrame:
    """All lines as one consistent table."""
    lines = table(spark, d, "raw_line").select(*_LINES)
    scanned = drift.scan(lines)
    return drift.unified_table(lines, drift.canonical_names(drift.compared(scanned), scanned.schemas))


_RECORDS = ("record_id", "meta", "written_at")


def _tables(spark: SparkSession, d: str) -> DataFrame:
    """All flat tables, visited and written once."""
    typed = nested.rows_of_column(table(spark, d, "generated_pair").select(*_RECORDS), *_RECORDS)
    lines = nested.rows_of_lines(table(spark, d, "raw_line").select("line_id", "payload"))
    both = typed.withColumn("table_name", F.lit("generated_pair")).unionByName(lines.withColumn("table_name", F.lit("raw_line")))
    return nested.write_tables(both)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every nested child of the records and lines: the keys of the flat tables' rows."""
    return nested.children(_tables(spark, d))


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    """The records and lines themselves, parents of the other tables."""
    got = nested.flat_table(_tables(spark, d), "record")
    return got.withColumn("n_other", F.coalesce(F.size("rest"), F.lit(0))).drop("rest", "child", "child_key", "parent_key")


def p4_swaps(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of swaps, tied to records and lines."""
    return nested.flat_table(_tables(spark, d), "swaps").drop("rest")


def p4_preps(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of prepositions within swaps, tied to their swap."""
    return nested.flat_table(_tables(spark, d), "preps").drop("rest")


def p4_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of per-role frequency aggregates."""
    got = nested.flat_table(_tables(spark, d), "aggregates")
    return got.select("*", *[F.round(c, 6).alias(f"{c}_r") for c in ("mean", "median", "min")]).drop("mean", "median", "min", "rest")


def p4_unplaced(spark: SparkSession, d: str) -> DataFrame:
    """Nested fields that no flat table's schema has a place for, or that have another type."""
    return nested.unplaced(_tables(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_changes, p2_scores, p2_nested, p2_table, p4_found, p4_records, p4_swaps, p4_preps, p4_aggregates, p4_unplaced)}

_KEY = same_name_sql

_PAIR_CASES = f"""
SELECT 'generated_pair' AS table_name, g.record_id AS rec_id, g.written_at AS ref_at,
       (SELECT CASE WHEN count(*) = 0 THEN 'absent' WHEN count(*) FILTER (p.loaded_at <= g.written_at) > 0 THEN 'gone' ELSE 'not_yet' END
          FROM source_pair p WHERE {_KEY('p.subtask')} = {_KEY('g.subtask')} AND p.idx = g.idx AND p.loaded_at IS NOT NULL) AS reason
FROM generated_pair g
WHERE g.idx IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM source_pair p WHERE {_KEY('p.subtask')} = {_KEY('g.subtask')} AND p.idx = g.idx
    AND p.loaded_at <= g.written_at AND (p.deleted_at IS NULL OR p.deleted_at > g.written_at))
UNION ALL
SELECT 'pair_score', s.score_id, s.scored_at,
       (SELECT CASE WHEN count(*) = 0 THEN 'absent' WHEN count(*) FILTER (p.written_at <= s.scored_at) > 0 THEN 'gone' ELSE 'not_yet' END
          FROM generated_pair p WHERE p.dataset = s.dataset AND {_KEY('p.subtask')} = {_KEY('s.subtask')} AND p.idx = s.idx AND p.written_at IS NOT NULL)
FROM pair_score s
WHERE s.idx IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM generated_pair p WHERE p.dataset = s.dataset AND {_KEY('p.subtask')} = {_KEY('s.subtask')} AND p.idx = s.idx
    AND p.written_at <= s.scored_at AND (p.withdrawn_at IS NULL OR p.withdrawn_at > s.scored_at))
"""

_NODES = """
WITH rec AS (SELECT * FROM generated_pair QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY written_at DESC) = 1),
arr AS (SELECT record_id AS id, 'g_swaps' AS child, unnest(meta.g_swaps) AS e, generate_subscripts(meta.g_swaps, 1) - 1 AS i FROM rec
        UNION ALL SELECT record_id, 'b_swaps', unnest(meta.b_swaps), generate_subscripts(meta.b_swaps, 1) - 1 FROM rec),
mp AS (SELECT record_id AS id, unnest(map_keys(meta.zipf_swapped_position_aggregates)) AS k, unnest(map_values(meta.zipf_swapped_position_aggregates)) AS v FROM rec),
obj AS (SELECT DISTINCT line_id AS id, payload::JSON AS j FROM raw_line WHERE json_valid(payload)),
m0 AS (SELECT id, json_extract(j, '$.meta') AS m FROM obj WHERE json_type(j) = 'OBJECT'),
m1 AS (SELECT id, CASE WHEN json_type(m) <> 'VARCHAR' THEN m WHEN json_valid(m ->> '$') THEN (m ->> '$')::JSON END AS m FROM m0),
kv AS (SELECT id, k, json_extract(m, '$."' || k || '"') AS v FROM (SELECT id, m, unnest(json_keys(m)) AS k FROM m1 WHERE json_type(m) = 'OBJECT')),
sw AS (SELECT id, k, CASE json_type(v) WHEN 'OBJECT' THEN [v] WHEN 'ARRAY' THEN json_extract(v, '$[*]') END AS a FROM kv WHERE suffix(k, '_swaps')),
el AS (SELECT id, k, unnest(a) AS e, generate_subscripts(a, 1) - 1 AS i FROM sw),
pr AS (SELECT id, k, i, CASE json_type(p) WHEN 'OBJECT' THEN [p] WHEN 'ARRAY' THEN json_extract(p, '$[*]') END AS a
       FROM (SELECT id, k, i, json_extract(e, '$.preps') AS p FROM el WHERE json_type(e) = 'OBJECT')),
pe AS (SELECT id, k, i, unnest(a) AS e, generate_subscripts(a, 1) - 1 AS n FROM pr),
zk AS (SELECT id, v, unnest(json_keys(v)) AS z FROM kv WHERE k = 'zipf_swapped_position_aggregates' AND json_type(v) = 'OBJECT')
"""
_KEYS = """SELECT 'generated_pair' AS table_name, id AS rec_id, child, i::VARCHAR AS child_key FROM arr WHERE e IS NOT NULL
UNION ALL SELECT 'generated_pair', id, 'zipf_swapped_position_aggregates', k FROM mp WHERE v IS NOT NULL
UNION ALL SELECT 'raw_line', id, k, i::VARCHAR FROM el WHERE json_type(e) <> 'NULL'
UNION ALL SELECT 'raw_line', id, k || '.preps', i || '.' || n FROM pe WHERE json_type(e) <> 'NULL'
UNION ALL SELECT 'raw_line', id, 'zipf_swapped_position_aggregates', z FROM zk WHERE json_type(json_extract(v, '$."' || z || '"')) <> 'NULL'
"""

_KIND = """CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'integer' WHEN 'UBIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'decimal'
  WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' END"""
_DRIFT = f"""
WITH lines AS (SELECT file_name, file_stream, file_ts, line_no, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM raw_line),
files AS (SELECT DISTINCT file_stream, file_ts, file_name FROM lines),
pairs AS (SELECT file_name, lag(file_name) OVER (PARTITION BY file_stream ORDER BY file_ts, file_name) AS prev FROM files),
kv AS (SELECT file_name, line_no, {_KEY("j ->> '$.subtask'")} AS sub, j ->> '$.idx' AS idx, k, json_extract(j, '$."' || k || '"') AS v
       FROM (SELECT *, unnest(json_keys(j)) AS k FROM lines WHERE json_type(j) = 'OBJECT')),
vals AS (SELECT *, {_KIND} AS kind FROM kv),
sch AS (SELECT file_name, k, list_sort(list_distinct(list(kind) FILTER (kind IS NOT NULL))) AS kinds FROM vals GROUP BY ALL),
fresh AS (SELECT p.file_name, p.prev, s.k FROM pairs p JOIN sch s USING (file_name) WHERE prev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sch o WHERE o.file_name = p.prev AND o.k = s.k)),
gone AS (SELECT p.file_name, p.prev, s.k FROM pairs p JOIN sch s ON s.file_name = p.prev WHERE NOT EXISTS (SELECT 1 FROM sch o WHERE o.file_name = p.file_name AND o.k = s.k)),
one AS (SELECT file_name, k, sub, idx, arg_max(kind || ':' || v::VARCHAR, line_no) AS v FROM vals WHERE kind IS NOT NULL AND sub IS NOT NULL AND idx IS NOT NULL GROUP BY ALL),
ren AS (SELECT f.file_name, f.k AS new, g.k AS old FROM fresh f JOIN gone g USING (file_name) JOIN one a ON a.file_name = f.file_name AND a.k = f.k
        JOIN one b ON b.file_name = f.prev AND b.k = g.k AND a.sub = b.sub AND a.idx = b.idx GROUP BY ALL HAVING count(*) FILTER (a.v = b.v) * 2 > count(*))
"""
_FOUND = """SELECT DISTINCT file_name, new AS field, 'renamed' AS drift FROM ren
UNION ALL SELECT file_name, k, 'added' FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE r.file_name = f.file_name AND r.new = f.k)
UNION ALL SELECT file_name, k, 'removed' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE r.file_name = g.file_name AND r.old = g.k)
UNION ALL SELECT p.file_name, a.k, 'retyped' FROM pairs p JOIN sch a USING (file_name) JOIN sch b ON b.file_name = p.prev AND b.k = a.k
  WHERE len(a.kinds) > 0 AND len(b.kinds) > 0 AND a.kinds <> b.kinds
"""

_CHANGED = """, f AS (SELECT DISTINCT p.*, i.file_stream FROM pairs p JOIN files i USING (file_name) WHERE p.prev IS NOT NULL),
k AS (SELECT file_name, k, coalesce(array_to_string(kinds, '|'), '') AS kinds FROM sch)
SELECT f.file_stream, f.file_name, f.prev AS prev_name, r.new AS field, 'renamed' AS drift, r.old AS old_field, a.kinds AS old_kinds, b.kinds AS new_kinds
  FROM (SELECT file_name, new, min(old) AS old FROM ren GROUP BY ALL) r JOIN f USING (file_name) JOIN k a ON a.file_name = f.prev AND a.k = r.old JOIN k b ON b.file_name = f.file_name AND b.k = r.new
UNION ALL SELECT f.file_stream, f.file_name, f.prev, g.k, 'added', NULL, NULL, b.kinds FROM fresh g JOIN f USING (file_name) JOIN k b ON b.file_name = f.file_name AND b.k = g.k
  WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE r.file_name = g.file_name AND r.new = g.k)
UNION ALL SELECT f.file_stream, f.file_name, f.prev, g.k, 'removed', g.k, a.kinds, NULL FROM gone g JOIN f USING (file_name) JOIN k a ON a.file_name = f.prev AND a.k = g.k
  WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE r.file_name = g.file_name AND r.old = g.k)
UNION ALL SELECT f.file_stream, f.file_name, f.prev, a.k, 'retyped', a.k, b.kinds, a.kinds FROM f JOIN k a USING (file_name) JOIN k b ON b.file_name = f.prev AND b.k = a.k
  WHERE a.kinds <> '' AND b.kinds <> '' AND a.kinds <> b.kinds
"""



def _json(e: str, field: str, kind: str) -> str:
    """A field of a JSON value where it has the schema's type."""
    types = {"int": "'BIGINT', 'UBIGINT'", "string": "'VARCHAR'", "double": "'BIGINT', 'UBIGINT', 'DOUBLE'"}[kind]
    return f"CASE WHEN json_type({e}, '$.{field}') IN ({types}) THEN ({e} ->> '$.{field}'){'' if kind == 'string' else '::' + kind} END AS {field}"


_WORDS = ["old", "new", "tag", "lemma", "pos"]
_SWAPS = f"""SELECT 'generated_pair' AS table_name, id AS rec_id, child, i::VARCHAR AS child_key, '' AS parent_key, e.i::INT AS i,
  {", ".join(f"e.{w} AS {w}" for w in _WORDS)}, NULL AS frame FROM arr WHERE e IS NOT NULL
UNION ALL SELECT 'raw_line', id, k, i::VARCHAR, '', {_json("e", "i", "int")}, {", ".join(_json("e", w, "string") for w in [*_WORDS, "frame"])}
FROM el WHERE json_type(e) <> 'NULL'"""
_PREPS = f"""SELECT 'raw_line' AS table_name, id AS rec_id, k || '.preps' AS child, i || '.' || n AS child_key, i::VARCHAR AS parent_key,
  {_json("e", "i", "int")}, {_json("e", "old", "string")}, {_json("e", "new", "string")} FROM pe WHERE json_type(e) <> 'NULL'"""
_MEANS = ["mean", "median", "min"]
_AGGS = f"""SELECT table_name, rec_id, child, child_key, '' AS parent_key, n, oov_count, {", ".join(f"round({m}, 6) AS {m}_r" for m in _MEANS)} FROM (
  SELECT 'generated_pair' AS table_name, id AS rec_id, 'zipf_swapped_position_aggregates' AS child, k AS child_key, v.n::INT AS n, v.oov_count::INT AS oov_count,
    v.mean AS mean, v.median AS median, v.min AS min FROM mp WHERE v IS NOT NULL
  UNION ALL SELECT 'raw_line', id, 'zipf_swapped_position_aggregates', z, {_json("e", "n", "int")}, {_json("e", "oov_count", "int")},
    {", ".join(_json("e", m, "double") for m in _MEANS)} FROM (SELECT id, z, json_extract(v, '$."' || z || '"') AS e FROM zk) WHERE json_type(e) <> 'NULL')"""

_NESTED = """
WITH lines AS (SELECT file_name, file_stream, file_ts, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM raw_line),
files AS (SELECT DISTINCT file_stream, file_ts, file_name FROM lines),
pairs AS (SELECT file_stream, file_name, lag(file_name) OVER (PARTITION BY file_stream ORDER BY file_ts, file_name) AS prev FROM files),
tree AS (SELECT l.file_name, regexp_replace(t.path, '\\[[0-9]+\\]', '', 'g') AS up, t.key, t.type, t.path AS raw FROM lines l, LATERAL json_tree(l.j) t WHERE json_type(l.j) = 'OBJECT'),
-- children of arrays are numbered, fields are not
named AS (SELECT file_name, replace(up, '"', '') || '.' || key AS path, type FROM tree WHERE key IS NOT NULL AND NOT regexp_full_match(key, '[0-9]+') AND up <> '$'),
sch AS (SELECT file_name, regexp_replace(path, '^\\$\\.', '') AS path, coalesce(list_sort(list_distinct(list(CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'integer' WHEN 'UBIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'decimal'
   WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' END) FILTER (type <> 'NULL'))), []) AS kinds FROM named GROUP BY ALL),
s AS (SELECT file_name, path, array_to_string(kinds, '|') AS kinds FROM sch),
p AS (SELECT * FROM pairs WHERE prev IS NOT NULL),
b AS (SELECT p.file_stream, p.file_name, p.prev, s.path, s.kinds FROM p JOIN s USING (file_name)),
a AS (SELECT p.file_stream, p.file_name, p.prev, s.path, s.kinds FROM p JOIN s ON s.file_name = p.prev)
SELECT file_stream, file_name, prev AS prev_name, path, CASE WHEN a.kinds IS NULL THEN 'added' WHEN b.kinds IS NULL THEN 'removed' ELSE 'retyped' END AS drift,
  coalesce(a.kinds, '') AS old_kinds, coalesce(b.kinds, '') AS new_kinds
FROM a FULL JOIN b USING (file_stream, file_name, prev, path)
WHERE a.kinds IS NULL OR b.kinds IS NULL OR (a.kinds <> '' AND b.kinds <> '' AND a.kinds <> b.kinds)
"""

ORACLES = {
    "p2_nested": _NESTED,
    "p4_swaps": _NODES + _SWAPS,
    "p4_preps": _NODES + _PREPS,
    "p4_aggregates": _NODES + _AGGS,
    "p2_found": _DRIFT + _FOUND,
    "p2_changes": _DRIFT + _CHANGED,
    "p4_found": _NODES + _KEYS,
    "p1_found": f"SELECT DISTINCT table_name, rec_id FROM ({_PAIR_CASES})",
    "p1_report": f"""SELECT table_name, strftime(ref_at, '%Y-%m') AS month, reason, count(*) AS n_refs
        FROM (SELECT DISTINCT * FROM ({_PAIR_CASES})) GROUP BY ALL""",
}
