import json
from collections import defaultdict
from datetime import datetime

from rasterloom.common import table
from rasterloom.operators import drift

T = datetime(2024, 1, 1)
SCHEMA = "result_id bigint, feed string, file_no int, meta string, ingested_at timestamp"


def kind(v):
    return "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "object" if isinstance(v, dict) else "array"


def plain(v):
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else [plain(x) for x in v] if isinstance(v, list) else v


def brute(rows):
    """Straight from the definition: rows (result_id, feed, file_no, meta)."""
    files = defaultdict(lambda: defaultdict(lambda: (set(), set())))
    for _, feed, no, meta in {r[0]: r for r in rows}.values():
        f = files[feed, no]
        try:
            o = json.loads(meta)
        except (ValueError, TypeError):
            continue

        def walk(o, at):
            for k, v in o.items():
                if v is not None:
                    f[at + (k,)][0].add(kind(v))
                    f[at + (k,)][1].add(json.dumps(plain(v), sort_keys=True))
                    if isinstance(v, dict):
                        walk(v, at + (k,))

        if isinstance(o, dict):
            walk(o, ())
    out = set()
    for (feed, no), now in list(files.items()):
        if (feed, no - 1) not in files:
            continue
        was = files[feed, no - 1]
        changed = {p for p in now.keys() | was.keys() if p not in now or p not in was or now[p][0] != was[p][0]}
        changed = {p for p in changed if not any(p[:i] in changed for i in range(1, len(p)))}
        gone, new = {p for p in changed if p not in now}, {p for p in changed if p not in was}
        ren = {(a, b) for a in gone for b in new if a[:-1] == b[:-1] and was[a][0] == now[b][0] and was[a][1] & now[b][1]}
        name = ".".join
        out |= {(feed, no, "retyped", name(p), "") for p in changed - gone - new}
        out |= {(feed, no, "renamed", name(a), name(b)) for a, b in ren}
        out |= {(feed, no, "removed", name(p), "") for p in gone - {a for a, _ in ren}} | {(feed, no, "added", name(p), "") for p in new - {b for _, b in ren}}
    return out


def found(df):
    got = [tuple(r) for r in drift.changes(drift.file_texts(df)).select("feed", "file_no", "change_kind", "field", "new_field").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_whole_table(spark):
    df = table(spark, "/root/testdata/sf0.01", "model_results")
    rows = [(r.result_id, r.feed, r.file_no, r.meta) for r in df.select("result_id", "feed", "file_no", "meta").collect()]
    want = brute(rows)
    assert {"added", "removed", "renamed", "retyped"} == {w[2] for w in want}
    assert found(df) == want


def frame(spark, metas):
    rows = [(i, feed, no, m if m is None or isinstance(m, str) else json.dumps(m), T) for i, (feed, no, m) in enumerate(metas)]
    return spark.createDataFrame(rows, SCHEMA), [r[:4] for r in rows]


def test_kinds_nesting_and_bad_rows(spark):
    df, rows = frame(spark, [
        ("a", 1, {"x": 1, "o": {"p": 1, "q": {"r": "s"}}, "t": "v", "n": None}), ("a", 1, None), ("a", 1, ""), ("a", 1, "{bad"), ("a", 1, "[1]"), ("a", 1, {}),
        ("a", 2, {"y": 1.0, "o": "gone", "t": ["v"], "n": 3}),
        ("a", 3, None), ("a", 4, {"y": 2, "new": {"deep": 1}}), ("a", 6, {"far": 1}),
        ("b", 1, {"o": {"k": 5, "m": True}}), ("b", 2, {"o": {"l": 5, "m": True}}), ("b", 3, {"w": {"l": 5, "m": True}}),
        ("c", 1, {"a": 1, "b": 1, "mixed": 1}), ("c", 1, {"mixed": "s"}), ("c", 2, {"c": 1, "mixed": "s"}), ("d", 1, {"z": 1}),
    ])
    want = brute(rows)
    assert ("a", 2, "renamed", "x", "y") in want and ("b", 2, "renamed", "o.k", "o.l") in want and ("b", 3, "renamed", "o", "w") in want
    assert found(df) == want


def test_repeats_empty_and_null_keys(spark):
    df, _ = frame(spark, [("a", 1, {"x": 1}), ("a", 2, {"x": "1"})])
    again = df.unionByName(df.withColumn("ingested_at", df.ingested_at + __import__("pyspark").sql.functions.expr("interval 1 day")))
    assert found(again) == {("a", 2, "retyped", "x", "")}
    assert found(df.limit(0)) == set()
    holes = spark.createDataFrame([(1, None, 1, '{"x": 1}', T), (2, "a", None, '{"x": 1}', T), (None, "a", 1, '{"x": 1}', T)], SCHEMA)
    assert found(holes) == set()
    assert found(df.selectExpr("*", "'p' AS path", "'k' AS key", "1 AS types")) == {("a", 2, "retyped", "x", "")}


def test_versions_and_one_table(spark):
    df, _ = frame(spark, [("a", 1, {"x": 1, "o": {"k": "v"}}), ("a", 2, {"y": 1, "o": {"k": "v"}}), ("a", 3, {"y": 1, "w": {"k": "v"}}), ("a", 4, {"y": "1", "w": {"k": "v"}}), ("a", 5, {"y": "2", "w": {"k": "u"}})])
    rec = drift.file_records(df)
    v = [(r.file_no, r.version) for r in drift.versions(drift.file_fields(rec)).orderBy("file_no").collect()]
    assert v == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 4)]
    got = [json.loads(r.record) for r in drift.unify(rec).orderBy("file_no").collect()]
    assert got[:4] == [{"y": "1", "w.k": "v"}] * 4 and got[4] == {"y": "2", "w.k": "u"}


def test_defaults_and_values_without_a_form(spark):
    df, _ = frame(spark, [
        ("a", 1, {"x": "7", "o": {"k": 1}, "l": [1, 2], "gone": True}), ("a", 1, {"x": "no number", "o": {"k": 2}}), ("a", 1, None),
        ("a", 2, {"x": 1.5, "o": "text", "l": 3, "new": "v"}),
        ("b", 1, {"x": True, "deep": 5}), ("b", 2, {"x": True, "deep": {"er": 1}}),
    ])
    rec = drift.file_records(df)
    rows = {r.key: r for r in drift.unify(rec, {"new": "none yet"}).collect()}
    first = json.loads(rows[0].record)
    assert first == {"x": 7.0, "o": '{"k":1}', "l": None, "gone": True, "new": "none yet"}
    assert [tuple(x) for x in rows[0].lost] == [("l", "[1,2]", "number")]
    assert [tuple(x) for x in rows[1].lost] == [("x", '"no number"', "number")] and json.loads(rows[1].record)["x"] is None
    assert json.loads(rows[2].record) == {"new": "none yet"} and json.loads(rows[3].record)["new"] == "v"
    assert [tuple(x) for x in rows[4].lost] == [("deep", "5", "object")] and json.loads(rows[5].record) == {"x": True, "deep.er": 1}
    assert {(r.feed, r.field): r.n for r in drift.lost_values(drift.unify(rec)).collect()} == {("a", "l"): 1, ("a", "x"): 1, ("b", "deep"): 1}
    t = drift.unified_table(rec)
    kinds = dict(t.dtypes)
    assert kinds["x"] == "string" and kinds["o"] == "string" and kinds["l"] == "double" and kinds["gone"] == "boolean" and kinds["deep__er"] == "double"
    got = {r.key: r for r in t.collect()}
    assert got[0].x == "7" and got[4].x == "true" and got[0].o == '{"k":1}' and got[0].l is None and got[3].l == 3.0 and got[5].deep__er == 1.0
    assert drift.unified_table(drift.file_records(df.limit(0))).count() == 0


def test_deep_records_are_read(spark):
    deep = '{"a":' * 50_000 + "[1, -2.5e3, \"s\\n\", true, null, {}, []]" + "}" * 50_000
    from rasterloom.common import parse_json, read_json

    v = parse_json(deep)
    for _ in range(50_000):
        v = v["a"]
    assert v == [1, -2500.0, "s\n", True, None, {}, []]
    for bad in (deep[:-1], deep + "}", deep.replace("}", "", 1), deep.replace(",", ";")):
        try:
            parse_json(bad)
            raise AssertionError(bad[-40:])
        except ValueError:
            pass
    assert read_json("x" + deep + "y", 1)[1] == len(deep) + 1
    assert drift.canonical(parse_json("[" * 9000 + "1.0" + "]" * 9000)) == "[" * 9000 + "1" + "]" * 9000
    assert drift.parsed(deep[: len(deep) // 2]) is None
