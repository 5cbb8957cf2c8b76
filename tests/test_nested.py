import json

from zipfloom.operators import nested as N
from zipfloom.runtime import table


def children(meta):
    out = []
    N.visit({"meta": meta}, lambda path, key, parent, own: out.append((N._tag(path), key)) if N.table_of(path) not in ("record", "other") else None)
    return out


def brute(meta):
    """The definition, read plainly."""
    out = []
    if isinstance(meta, str):
        try:
            meta = json.loads(meta)
        except ValueError:
            return out
    if not isinstance(meta, dict):
        return out
    for k, v in meta.items():
        if k.endswith("_swaps"):
            v = [v] if isinstance(v, dict) else v if isinstance(v, list) else []
            out += [(k, str(i)) for i, s in enumerate(v) if s is not None]
            out += [
                (f"{k}.preps", f"{i}.{j}")
                for i, s in enumerate(v)
                if isinstance(s, dict)
                for j, p in enumerate(s.get("preps") or [])
                if p is not None
            ]
        if k == N.AGGREGATES and isinstance(v, dict):
            out += [(k, name) for name, a in v.items() if a is not None]
    return out


def test_visitor_on_odd_values():
    assert children({"g_swaps": [{"i": 1}, None, {"preps": [None, {"i": 2}]}], "x_swaps": {"old": "a"}}) == [
        ("g_swaps", "0"), ("g_swaps", "2"), ("g_swaps.preps", "2.1"), ("x_swaps", "0")]
    assert children('{"b_swaps": [{}]}') == [("b_swaps", "0")]
    for empty in (None, "", "text", 3, [], {}, {"g_swaps": None}, {"g_swaps": "x"}, {N.AGGREGATES: None}, {N.AGGREGATES: {"a": None}}):
        assert children(empty) == []


def test_found_equals_brute_force(spark, sf):
    from zipfloom.plans.problems import p4_found

    want = set()
    for r in table(spark, sf, "raw_line").collect():
        try:
            o = json.loads(r["payload"] or "")
        except ValueError:
            continue
        if isinstance(o, dict):
            want |= {("raw_line", r["line_id"], *c) for c in brute(o.get("meta"))}
    latest = {}
    for r in table(spark, sf, "generated_pair").collect():
        if r["record_id"] not in latest or latest[r["record_id"]]["written_at"] < r["written_at"]:
            latest[r["record_id"]] = r
    for r in latest.values():
        m = r["meta"].asDict(True) if r["meta"] else None
        want |= {("generated_pair", r["record_id"], *c) for c in brute(m)}
    rows = [tuple(r) for r in p4_found(spark, sf).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


SWAP = "struct<i:int,old:string,preps:array<struct<i:string,x:array<struct<y:int>>>>>"
META = f"struct<g_swaps:array<{SWAP}>,other:int,note:struct<a:int,list:array<struct<b:double>>>,{N.AGGREGATES}:map<string,struct<n:int>>>"


def typed(spark, rows):
    return spark.createDataFrame(rows, f"id bigint, meta {META}, v int").repartition(3)


def test_typed_records(spark):
    rows = [
        (1, ([(0, "a", [("7", [(3,), None])]), None, (2, None, None)], 1, (5, [(0.5,)]), {"x": (1,), "y": None}), 2),
        (1, ([(9, "late", None)], 1, None, None), 1),
        (2, (None, 1, None, {}), 1), (3, None, 1), (4, ([], None, None, None), None), (4, ([(1, "tie", None)], None, None, None), None),
        (None, ([(5, "k", None)], None, None, None), 1),
    ]
    df = typed(spark, rows)
    flat = [r for r in N.rows_of_column(df, "id", "meta", "v").collect() if r["rec_id"] != 4]
    got = {(r["rec_id"] or 0, r["child"], r["child_key"]): r for r in flat}
    assert set(got) == {
        (0, "", ""), (1, "", ""), (2, "", ""), (3, "", ""), (0, "g_swaps", "0"), (1, "g_swaps", "0"), (1, "g_swaps", "2"),
        (1, "g_swaps.preps", "0.0"), (1, "g_swaps.preps.x", "0.0.0"), (1, "note.list", "0"), (1, N.AGGREGATES, "x"),
    }
    assert got[1, "g_swaps", "0"]["swaps"]["old"] == "a" and got[1, "g_swaps.preps", "0.0"]["parent_key"] == "0"
    assert got[1, "g_swaps.preps", "0.0"]["preps"]["i"] == 7  # cast to the schema's type
    third = got[1, "g_swaps.preps.x", "0.0.0"]
    assert third["parent_key"] == "0.0" and third["rest"] == {"y": "3"}
    assert got[1, "", ""]["rest"] == {"other": "1", "note.a": "5"} and got[1, "note.list", "0"]["rest"] == {"b": "0.5"}
    keys = {(r["rec_id"] or 0, r["child"], r["child_key"]) for r in N.keys_of_column(df, "id", "meta", "v").collect() if r["rec_id"] != 4}
    assert keys == {k for k in got if k[1] and not k[1].endswith(".x") and k[1] != "note.list"}
    four = [r for r in N.rows_of_column(df, "id", "meta", "v").collect() if r["rec_id"] == 4]
    assert len(four) == 1 + N.keys_of_column(df, "id", "meta", "v").where("rec_id = 4").count()
    assert N.rows_of_column(df.limit(0), "id", "meta", "v").count() == N.keys_of_column(df.limit(0), "id", "meta", "v").count() == 0


def test_lines_and_schemas(spark):
    meta = {"g_swaps": [{"i": 1, "old": "a", "preps": [{"i": 2, "old": "in"}]}], N.AGGREGATES: {"r": {"n": 2, "mean": 1.5}}}
    whole = json.dumps({"meta": json.dumps(meta), "subtask": "s"})
    odd = {"meta": {"g_swaps": [{"i": "text", "new": 1 << 40}, "bare"], "swap_failed_reason": "r"}, "levels": [{"a": [{"b": {"c": [{"d": None, "e": 1}]}}]}], "flat": [1, 2]}
    rows = [(1, whole), (1, whole), (1, None), (2, "broken"), (3, ""), (4, json.dumps(odd)), (5, "[]"), (None, '{"idx": 1}')]
    flat = N.write_tables(N.rows_of_lines(spark.createDataFrame(rows, "line_id bigint, payload string")))
    swaps = {(r["rec_id"], r["child_key"]): r for r in N.flat_table(flat, "swaps").collect()}
    assert swaps[1, "0"]["i"] == 1 and swaps[1, "0"]["parent_key"] == "" and swaps[4, "0"]["i"] is None
    assert swaps[4, "0"]["rest"] == {"i": "text", "new": str(1 << 40)} and set(swaps) == {(1, "0"), (4, "0"), (4, "1")}
    assert swaps[4, "1"]["rest"] == {"": '"bare"'} and swaps[4, "1"]["old"] is None
    prep = N.flat_table(flat, "preps").collect()
    assert [(p["rec_id"], p["child_key"], p["parent_key"], p["old"]) for p in prep] == [(1, "0.0", "0", "in")]
    assert N.flat_table(flat, "aggregates").collect()[0]["mean"] == 1.5
    records = {r["rec_id"]: r for r in N.flat_table(flat, "record").collect()}
    assert set(records) == {1, 4, None} and records[1]["subtask"] == "s" and records[None]["idx"] == 1
    assert records[4]["swap_failed_reason"] == "r" and records[4]["rest"] == {"flat": "[1, 2]"}
    other = {(r["child"], r["child_key"], r["parent_key"]): r["rest"] for r in flat.where("kind = 'other'").collect()}
    assert other == {
        ("levels", "0", ""): None, ("levels.a", "0.0", "0"): None, ("levels.a.b.c", "0.0.0", "0.0"): {"e": "1"},
    }
    lost = {(r["child"], r["field"]): r["n_rows"] for r in N.unplaced(flat).collect()}
    assert lost == {("g_swaps", "i"): 1, ("g_swaps", "new"): 1, ("g_swaps", ""): 1, ("", "flat"): 1, ("levels.a.b.c", "e"): 1}


def test_every_key_of_a_line_is_a_row_and_each_value_is_somewhere(spark, sf):
    """Nothing of a payload is lost: its scalars come back from the tables' columns and rests."""
    src = table(spark, sf, "raw_line").select("line_id", "payload")
    seen = {}
    for r in N.rows_of_lines(src).collect():
        n = sum(sum(v is not None for v in r[t]) for t in N.SCHEMAS if r[t] is not None) + len(r["rest"] or {})
        seen[r["rec_id"]] = seen.get(r["rec_id"], 0) + n

    def scalars(v):
        if isinstance(v, dict):
            return sum(map(scalars, v.values())) if v else 1
        if isinstance(v, list):
            return sum(map(scalars, v)) if any(isinstance(e, dict) for e in v) else 1
        return v is not None

    want = {}
    for r in src.collect():
        o = N.parse_object(r["payload"])
        if o is not None:
            if isinstance(o.get("meta"), str):
                o["meta"] = N.parse_object(o["meta"]) or o["meta"]
            swaps = [s for k, v in (o.get("meta") or {}).items() if k.endswith("_swaps") for s in (v if isinstance(v, list) else [v]) if isinstance(s, dict)]
            empty = sum(s.get("preps") == [] for s in swaps) + sum(v == [] for k, v in (o.get("meta") or {}).items() if k.endswith("_swaps"))
            want[r["line_id"]] = scalars(o) - empty  # empty tables have no rows
    assert {k: v for k, v in seen.items() if v} == {k: v for k, v in want.items() if v}


def test_found_comes_from_the_written_tables(spark, sf, monkeypatch):
    """The keys are those of rows that the visitor emitted whole and that were written by table, parents and payload with them."""
    from zipfloom.plans.problems import p4_found

    written = []
    monkeypatch.setattr(N, "write_tables", lambda rows, real=N.write_tables: written.append(real(rows)) or written[-1])
    got = {tuple(r) for r in p4_found(spark, sf).collect()}
    assert len(written) == 1
    rows = written[0].where("kind in ('swaps', 'preps', 'aggregates')").collect()
    assert got == {(r["table_name"], r["rec_id"], r["child"], r["child_key"]) for r in rows}
    assert all(sum(r[t] is not None for t in N.SCHEMAS) == 1 and r[r["kind"]] is not None for r in rows)
    there = {(r["table_name"], r["rec_id"], r["child_key"]) for r in rows if r["kind"] == "swaps"}
    there |= {(r["table_name"], r["rec_id"], "") for r in written[0].where("kind = 'record'").collect()}
    assert {(r["table_name"], r["rec_id"], r["parent_key"]) for r in rows} <= there
    # with what is written cut, the result is cut
    monkeypatch.setattr(N, "write_tables", lambda rows: written[0].where("kind <> 'preps'"))
    assert {tuple(r) for r in p4_found(spark, sf).collect()} == {g for g in got if not g[2].endswith(".preps")} != got


def test_lone_surrogates(spark):
    texts = [(1, r'{"meta": {"g_swaps": [{"i": 1, "old": "\ud800x"}, {"i": 2, "more": ["\udc00"]}]}}'), (2, r'{"meta": {"\ud800_swaps": [{"old": "a"}]}}'), (3, '{"meta": {"g_swaps": [{"old": "é"}]}}')]
    flat = N.write_tables(N.rows_of_lines(spark.createDataFrame(texts, "line_id bigint, payload string").coalesce(1)))
    got = {(r["rec_id"], r["child"], r["child_key"]): r for r in N.flat_table(flat, "swaps").collect()}
    assert set(got) == {(1, "g_swaps", "0"), (1, "g_swaps", "1"), (2, r"\ud800_swaps", "0"), (3, "g_swaps", "0")}
    assert got[1, "g_swaps", "0"]["old"] == r"\ud800x" and got[1, "g_swaps", "1"]["rest"] == {"more": r'["\udc00"]'}
    assert got[3, "g_swaps", "0"]["old"] == "é"
