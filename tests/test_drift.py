import json
from collections import defaultdict

import pytest

from zipfloom.operators import drift as D
from zipfloom.runtime import table

LINES = "line_id bigint, file_name string, file_stream string, file_ts string, line_no bigint, payload string, field string"


def model(rows):
    """Sequential reading of the definition."""
    files = defaultdict(list)
    for _, name, stream, ts, no, payload, *_ in rows:
        if name is not None and stream is not None:
            files[stream, ts, name].append((no, D.parse_object(payload)))
    kind = D.kind_of
    out, prev = set(), {}
    for stream, ts, name in sorted(files, key=lambda f: (f[0], f[1] is not None, f[1] or "", f[2])):
        objs = [o for _, o in sorted(files[stream, ts, name], key=lambda x: x[0]) if o is not None]
        kinds, values = defaultdict(set), defaultdict(dict)
        for o in objs:
            for k, v in o.items():
                kinds[k] |= {kind(v)} - {"null"}
                if v is not None and o.get("subtask") is not None and o.get("idx") is not None:
                    rec = (str(o["subtask"]).strip().lower().replace("-", "_"), str(o["idx"]))
                    values[k][rec] = (kind(v), json.dumps(v, sort_keys=True))
        if stream in prev:
            old_kinds, old_values = prev[stream]
            new, gone = set(kinds) - set(old_kinds), set(old_kinds) - set(kinds)
            renamed, taken = set(), set()
            for y in new:
                for x in gone:
                    both = values[y].keys() & old_values[x].keys()
                    if sum(values[y][r] == old_values[x][r] for r in both) * 2 > len(both):
                        renamed.add(y)
                        taken.add(x)
            out |= {(name, f, "renamed") for f in renamed} | {(name, f, "added") for f in new - renamed}
            out |= {(name, f, "removed") for f in gone - taken}
            out |= {(name, f, "retyped") for f in set(kinds) & set(old_kinds) if kinds[f] and old_kinds[f] and kinds[f] != old_kinds[f]}
        prev[stream] = kinds, values
    return out


def found(spark, rows):
    got = D.schema_changes(spark.createDataFrame(rows, LINES).repartition(4))
    return {(r["file_name"], r["field"], r["drift"]) for r in got.collect()}


def lines(name, ts, objs, stream="s"):
    return [(i, name, stream, ts, i, o if o is None or isinstance(o, str) else json.dumps(o), "x") for i, o in enumerate(objs)]


def pair(i, **more):
    return {"subtask": "A-b", "idx": i, **more}


def test_each_kind_of_change(spark):
    one = [pair(i, text=f"t{i}", n=i, gone=1, only_null=None) for i in range(6)]
    two = [pair(i, label=f"t{i}" if i < 4 else "other", n=i + 0.5 if i else i, fresh=[1], only_null=None) for i in range(6)]
    two[0]["subtask"] = " a_B "
    three = [pair(i, label={"v": i}, n="x", fresh=[1], only_null=True) for i in range(6)]
    rows = lines("f1", "20240101-000000", one) + lines("f2", "20240102-000000", two) + lines("f3", "20240103-000000", three)
    rows += rows[:3]
    want = {
        ("f2", "label", "renamed"), ("f2", "gone", "removed"), ("f2", "fresh", "added"), ("f2", "n", "retyped"),
        ("f3", "label", "retyped"), ("f3", "n", "retyped"),
    }
    assert found(spark, rows) == want == model(rows)


def test_half_is_not_more_than_half(spark):
    one = [pair(i, a=f"t{i}") for i in range(4)]
    two = [pair(i, b=f"t{i}" if i < 2 else "z") for i in range(4)]
    rows = lines("f1", "1", one) + lines("f2", "2", two)
    assert found(spark, rows) == {("f2", "a", "removed"), ("f2", "b", "added")} == model(rows)


def test_equal_text_of_another_type_is_no_rename(spark):
    rows = lines("f1", "1", [pair(i, a=i) for i in range(4)]) + lines("f2", "2", [pair(i, b=str(i)) for i in range(4)])
    assert found(spark, rows) == {("f2", "a", "removed"), ("f2", "b", "added")}


def test_bad_lines_and_nulls(spark):
    rows = lines("f1", "1", [pair(0, a=1), "", None, "  ", '{"z": 1', "[1]", '{"z": NaN}', "x" * 20000])
    rows += lines("f2", None, [pair(0, a=1, early=2)]) + lines(None, "3", [pair(0, zz=1)]) + lines("f4", "2", ["broken"])
    rows += [(1, "g", None, "1", 0, '{"q": 1}', "x")]
    assert found(spark, rows) == model(rows)
    assert found(spark, []) == set()


def test_numbers():
    assert [D.kind_of(v) for v in D.parse_object('{"a": 1, "b": 1.0, "c": true, "d": 1e3}').values()] == ["integer", "decimal", "boolean", "integer"]


@pytest.mark.parametrize("d", ["sf0.001", "sf0.01"])
def test_raw_lines(spark, d):
    df = table(spark, f"/root/testdata/{d}", "raw_line").select(*[c.split()[0] for c in LINES.split(", ")[:6]])
    want = model([tuple(r) for r in df.collect()])
    got = {(r["file_name"], r["field"], r["drift"]) for r in D.schema_changes(df).collect()}
    assert got == want and want


def test_flooding_prefers_the_likely():
    a = [("", "good_text", "string"), ("", "meta", "object"), ("meta\x1f", "n", "integer")]
    b = [("", "goodText", "string"), ("", "details", "object"), ("details\x1f", "n", "integer")]
    s = D.flood(a, b)
    assert D.select(s) == {"good_text": "goodText", "meta": "details"}
    assert D.select(D.flood(a, a)) == {"good_text": "good_text", "meta": "meta"}


def test_one_table(spark, sf):
    from zipfloom.plans.problems import p2_table

    got = p2_table(spark, sf)
    src = table(spark, sf, "raw_line")
    assert got.count() == src.count() and "subtask" in got.columns
    text = {r["line_id"]: r["payload"] for r in src.collect()}
    for r in got.collect():
        o = D.parse_object(text[r["line_id"]])
        assert (r["status"] == "ok") == (o is not None)
        if o and isinstance(o.get("subtask"), str):
            assert r["subtask"] == o["subtask"]


def names_of(df):
    scanned = D.scan(df)
    return D.canonical_names(D.compared(scanned), scanned.schemas)


def test_table_of_clashing_names(spark):
    rows = lines("f1", "1", [{"line_id": "own", "Status": 1, "n": 2}, {"n": 2.5}, None])
    df = spark.createDataFrame(rows, LINES)
    names = names_of(df)
    got = D.unified_table(df, names).orderBy("line_no").collect()
    assert [r["n"] for r in got] == [2.0, 2.5, None] and got[0]["line_id_field"] == "own" and got[0]["Status_field"] == 1
    assert [r["status"] for r in got] == ["ok", "ok", "empty"]


def test_a_field_renamed_and_retyped_is_one_column(spark):
    one = [pair(i, variant="freq", good_freq=f"t{i}", count=f"c{i}", count_of_x=i) for i in range(4)]
    two = [pair(i, Variant={"name": "freq"}, goodFreq=f"u{i}", seed=[i], count_of_y=i + 9) for i in range(4)]
    df = spark.createDataFrame(lines("f1", "1", one) + lines("f2", "2", two), LINES)
    assert D.schema_changes(df).where("drift = 'renamed'").count() == 0
    names = names_of(df)
    assert names["variant"] == names["Variant"] == ("Variant", "string") and names["good_freq"] == names["goodFreq"]
    assert names["count"][0] != names["seed"][0]  # selected, but not alike
    assert names["count_of_x"][0] != names["count_of_y"][0]  # alike, but the values differ
    got = D.unified_table(df, names).orderBy("file_name", "line_no").collect()
    assert [r["Variant"] for r in got] == ["freq"] * 4 + ['{"name": "freq"}'] * 4


def test_files_without_shared_records_and_names_that_meet(spark):
    one, two = [pair(i, variant="freq") for i in range(3)], [pair(i + 9, variant_kind=2) for i in range(3)]
    rows = lines("f1", "1", one) + lines("f2", "2", two)
    df = spark.createDataFrame(rows, LINES)
    names = names_of(df)
    assert names["variant"] == names["variant_kind"]
    df = spark.createDataFrame(rows + lines("f3", "1", [pair(1, variant="a", variant_kind=1)], "other"), LINES)
    names = names_of(df)
    assert names["variant"][0] != names["variant_kind"][0]


def renamed(df, **how):
    return {(r["field"], r["old_field"]) for r in D.schema_changes(df, **how).where("drift = 'renamed'").collect()}


def test_flooding_finds_what_the_values_of_all_pairs_prove(spark):
    """Names that say nothing, few shared records, two copies of a field: recall against the exact mode."""
    import random

    rnd, rows, want = random.Random(5), [], 0
    for s in range(12):
        names = [f"{rnd.choice('abcdefgh')}{rnd.randrange(10**6)}" for _ in range(16)]
        old, new = names[:8], names[8:]
        one = [pair(i, **{n: (f"{n} {i}" if k % 3 else i * 7 + k if k else {"x": [i, k]}) for k, n in enumerate(old)}) for i in range(60)]
        two = [pair(i, **{new[k]: (f"{n} {i}" if k % 3 else i * 7 + k if k else {"x": [i, k]}) for k, n in enumerate(old)}) for i in range(40, 100)]
        for o in two:
            o["copy"] = o[new[1]]
        rows += lines(f"{s}a", "1", one, f"s{s}") + lines(f"{s}b", "2", two, f"s{s}")
    df = spark.createDataFrame(rows, LINES)
    every, got = renamed(df, exact=True), renamed(df)
    assert len(every) == 12 * 9 and got <= every and len(got) >= 0.95 * len(every)


def test_without_flooding_renames_are_lost(spark, monkeypatch):
    one = [pair(i, a=f"x{i}", b=f"y{i}", c=f"z{i}") for i in range(5)]
    two = [pair(i, k=f"z{i}", l=f"x{i}", m=f"y{i}") for i in range(5)]
    df = spark.createDataFrame(lines("f1", "1", one) + lines("f2", "2", two), LINES)
    assert renamed(df) == {("k", "c"), ("l", "a"), ("m", "b")}
    assert D.select({("a", "k"): 0.0}) == {} and D.candidates({("a", "k"): 0.0}, ["a"], ["k"]) == set()
    field = lambda names: [{"parent": "", "field": f, "kind": "string", "n": 5, "mins": []} for f in names]
    assert any(r[1] == "renamed?" for r in D._changes(field("abc"), field("klm")))
    monkeypatch.setattr(D, "flood", lambda a, b, o=None: {(x, y): 0.0 for x in "abc" for y in "klm"})
    assert {r[1] for r in D._changes(field("abc"), field("klm"))} == {"added", "removed"}


def test_every_depth_and_every_element():
    deep = {"a": [{"x": 1}, {"y": {"z": [[{"w": "t"}]]}}]}
    names = D._Names()
    assert {(p.replace("\x1f", "."), f, k) for p, f, k in (names.entries[i] for i in names.of(deep))} == {
        ("", "a", "array"), ("a.", "x", "integer"), ("a.", "y", "object"), ("a.y.", "z", "array"), ("a.y.z.", "w", "string")}


def test_nested_changes(spark):
    one = [pair(0, meta={"g": [{"i": 1}, {"old": "a"}]}, list=[{"q": 1}])]
    two = [pair(0, meta={"g": [{"i": 1}, {"old": 2, "new": [{"k": None}]}]}, list=[])]
    got = D.nested_changes(spark.createDataFrame(lines("f1", "1", one) + lines("f2", "2", two), LINES)).collect()
    assert {(r["path"], r["drift"]) for r in got} == {
        ("meta.g.old", "retyped"), ("meta.g.new", "added"), ("meta.g.new.k", "added"), ("list.q", "removed")}


def test_values_that_fit_no_column_are_kept(spark):
    big, huge = 1 << 63, 10**400
    objs = [{"n": 1, "m": 1, "k": 2**60, "d": 1}, {"n": big, "m": huge, "k": 3, "d": 1.5}, {"other": 2, "n": 5}]
    df = spark.createDataFrame(lines("f1", "1", objs), LINES)
    names = names_of(df)
    assert names["n"][1] == names["m"][1] == "string" and names["k"][1] == "bigint" and names["d"][1] == "double"
    got = D.unified_table(df, names).orderBy("line_no").collect()
    assert got[1]["n"] == str(big) and got[1]["m"] == str(huge) and got[0]["k"] == 2**60
    forced = {"n": ("n", "bigint"), "m": ("m", "double"), "other": ("n", "bigint")}
    got = D.unified_table(df, forced).orderBy("line_no").collect()
    assert got[1]["n"] is None and got[1]["other_fields"] == {"n": str(big), "m": str(huge), "k": "3", "d": "1.5"}
    assert got[2]["n"] == 2 and got[2]["other_fields"] == {"n": "5"}
