import json
from datetime import datetime

from rasterloom.common import table
from rasterloom.operators import shredding

T = datetime(2024, 1, 1)


def opened(v):
    while isinstance(v, str) and v[:1] in "{[" and v:
        try:
            v = json.loads(v)
        except ValueError:
            return v
    return v


def brute(manifests):
    """Straight from the definition, by recursion."""
    out = set()
    kinds = {"tiles": "tile", "frames": "frame", "issues": "issue"}

    def below(v, at):
        v = opened(v)
        if isinstance(v, list):
            for x in v:
                below(x, at)
        elif isinstance(v, dict):
            for k, x in v.items():
                o = opened(x)
                if k in kinds:
                    items = list(enumerate(o)) if isinstance(o, list) else [(0, o)] if isinstance(o, dict) else []
                    out.update((*at, kinds[k], i) for i, e in items if isinstance(opened(e), dict))
                below(x, at)

    for export, text in manifests:
        try:
            m = json.loads(text)
        except (ValueError, TypeError):
            continue
        if not isinstance(m, dict):
            continue
        ms = opened(m.get("models"))
        if isinstance(ms, list):
            ms = [(None, x) for x in ms]
        elif isinstance(ms, dict):
            ms = [(None, ms)] if {"model", "metas", "sensor"} & ms.keys() else list(ms.items())
        else:
            ms = []
        for key, e in ms:
            e = opened(e)
            if not isinstance(e, dict):
                continue
            metas = opened(e.get("metas"))
            if isinstance(metas, dict):
                metas = [(int(k), v) for k, v in metas.items()] if metas and all(k.isdecimal() for k in metas) else [(0, metas)]
            elif isinstance(metas, list):
                metas = list(enumerate(metas))
            else:
                metas = []
            for i, p in metas:
                if isinstance(opened(p), dict):
                    below(p, (export, e.get("model") or key, i))
    return out


def children(spark, rows):
    df = spark.createDataFrame([(i, "combined", 1, m, T) for i, m in rows], "export_id bigint, layout string, n_items int, manifest string, ingested_at timestamp")
    got = [tuple(r) for r in shredding.manifest_children(df).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_whole_table(spark):
    df = table(spark, "/root/testdata/sf0.01", "export_manifests")
    rows = [(r.export_id, r.manifest) for r in df.collect()]
    got = shredding.manifest_children(df).collect()
    assert {tuple(r) for r in got} == brute(rows) and len(got) > 1000


SHAPES = [
    {"models": [{"model": "a", "metas": [{"tiles": [{"row": 0}, None, {"row": 1}]}, None, {"x": {"y": {"issues": {"code": "q"}}}}]}]},
    {"models": {"b": {"metas": {"3": {"frames": [{"t": 0}]}, "5": "{\"tiles\": {\"row\": 1}}"}}, "c": None}},
    {"models": {"model": "d", "metas": {"model": "d", "tiles": "[{\"row\":0},null,3]"}}},
    {"models": json.dumps([{"model": "e", "metas": [json.dumps({"tiles": [json.dumps({"row": 7, "frames": [{"t": 1}]})]})]}])},
    {"models": []}, {"models": None}, {}, {"models": {}}, {"tiles": [{"row": 1}], "models": "{oops"},
    {"models": [{"model": "f", "metas": [{"tiles": 5, "frames": "text", "issues": []}, 7, "x"]}, 4, "z", None]},
]


def test_shapes(spark):
    rows = [(i, json.dumps(s)) for i, s in enumerate(SHAPES)] + [(50, None), (51, ""), (52, '{"models": [{"mod'), (53, "[1, 2]"), (54, '"text"'), (None, json.dumps(SHAPES[0]))]
    assert children(spark, rows) == brute([r for r in rows if r[0] is not None])


def test_deep_and_long(spark):
    deep = "[" * 100_000 + "]" * 100_000
    long = json.dumps({"models": [{"model": "m", "metas": [{"tiles": [{"row": i, "text": "x" * 50} for i in range(20_000)]}]}]})
    assert len(children(spark, [(1, deep), (2, long)])) == 20_000


def test_readable_delivery_wins_and_empty(spark):
    df = spark.createDataFrame([(1, '{"models": [', T), (1, json.dumps(SHAPES[0]), datetime(2024, 3, 1)), (1, json.dumps(SHAPES[0]), datetime(2024, 4, 1))], "export_id bigint, manifest string, ingested_at timestamp")
    assert shredding.manifest_children(df).count() == 3
    assert shredding.manifest_children(df.limit(0)).count() == 0
    clash = df.selectExpr("*", "1 AS doc", "2 AS node", "3 AS text")
    assert shredding.manifest_children(clash).count() == 3


def test_tables_link_and_keep_values(spark):
    m = {"status": "ok", "n_items": 2, "layout": "combined", "models": {"b": {"status": "ok", "metas": [{"image_size": 64, "tiles": [{"row": 1, "col": 2, "valid_h": 3, "valid_w": 4, "more": "z"}], "frames": [{"t": 0, "start": "2020-01-01", "end": "2020-02-01", "empty": True}]}]}}}
    df = spark.createDataFrame([(9, json.dumps(m), T)], "export_id bigint, manifest string, ingested_at timestamp")
    t = {k: [r.asDict() for r in v.collect()] for k, v in shredding.manifest_tables(df).items()}
    assert t["exports"][0]["n_items"] == 2 and t["models"][0]["model"] == "b" and t["points"][0]["image_size"] == 64
    tile = t["tiles"][0]
    assert (tile["model"], tile["point_index"], tile["row"], tile["col"], tile["valid_h"], tile["valid_w"]) == ("b", 0, 1, 2, 3, 4)
    assert tile["point_node"] == t["points"][0]["point_node"] and t["frames"][0]["empty"] is True and t["issues"] == []


def test_tables_keep_what_has_no_column(spark):
    point = {"model": "own", "input_prep": {"mode": "tile"}, "inspection": {"ok": False}, "tiles": [{"row": 1, "more": {"a": [5]}}]}
    m = {"status": "ok", "temporal": {"mode": "year", "end": {"name": "x"}}, "summary": {}, "a.b": None, "spatials": [{"type": "BBox", "minlon": 1.5, "new": "n"}], "models": [{"model": "a", "sensor": {"bands": ["B1", "B2"]}, "metas": [point]}]}
    df = spark.createDataFrame([(9, json.dumps(m), T)], "export_id bigint, manifest string, ingested_at timestamp")
    t = {k: [r.asDict() for r in v.collect()] for k, v in shredding.manifest_tables(df).items()}
    assert t["exports"][0]["extra"] == {"temporal.mode": "year", "temporal.end.name": "x", "summary": "{}", '["a.b"]': None}
    s = t["spatials"][0]
    assert (s["export_id"], s["spatial_pos"], s["type"], s["minlon"], s["extra"]) == (9, 0, "BBox", 1.5, {"new": "n"})
    assert t["models"][0]["extra"] == {"sensor.bands[0]": "B1", "sensor.bands[1]": "B2"}
    assert t["points"][0]["own_model"] == "own" and t["points"][0]["model"] == "a"
    assert t["points"][0]["extra"] == {"input_prep.mode": "tile", "inspection.ok": "false"} and t["tiles"][0]["extra"] == {"more.a[0]": "5"}


def test_result_meta(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": {"c": [true, null, "x"]}}', T), (2, None, T), (3, "{", T)], "result_id bigint, meta string, ingested_at timestamp")
    got = {(r.label, r.ordinal, r.kind, r.scalar) for r in shredding.meta_table(df).collect()}
    assert got == {("a", 0, "number", "1"), ("c", 0, "boolean", "true"), ("c", 2, "string", "x")}


def test_meta_links_and_entities(spark):
    m = {"model": "a", "provider": {"name": "p"}, "temporal": {"mode": "year", "end": {"name": "e", "v": 1}}, "sensor": {"bands": ["B1"]}, "band_stats": [0.5]}
    df = spark.createDataFrame([(1, json.dumps(m), T)], "result_id bigint, meta string, ingested_at timestamp")
    nodes = {r.node: r for r in shredding.meta_nodes(df).collect()}
    assert all(r.parent is None or r.parent in nodes for r in nodes.values())
    assert {r.path: r.scalar for r in nodes.values() if r.label == "name"} == {"provider.name": "p", "temporal.end.name": "e"}
    t = {k: v.collect() for k, v in shredding.meta_tables(df).items()}
    assert t["result"][0].model == "a" and t["result"][0].extra == {"band_stats[0]": "0.5"}
    assert (t["provider"][0].name, t["provider"][0].parent_node) == ("p", 0) and t["sensor"][0].extra == {"bands[0]": "B1"}
    assert (t["temporal"][0].mode, t["temporal"][0].extra) == ("year", {"end.name": "e", "end.v": "1"})


def test_documents_of_any_depth(spark):
    n = 2500
    df = spark.createDataFrame([(1, '{"a":' * n + '{"tiles": [{"row": 1}]}' + "}" * n), (2, '{"a":' * n)], "k bigint, t string")
    rows = shredding.shred(df, "k", "t").filter("doc = 1").collect()
    assert len(rows) == n + 4 and sum(r.entity == "tile" for r in rows) == 1
    assert shredding.shred(df, "k", "t").filter("doc = 2").count() == 0  # cut off


def test_only_the_wanted_values(spark):
    df = table(spark, "/root/testdata/sf0.001", "export_manifests")
    docs = shredding.readable_once(df, "export_id", "manifest", "ingested_at")
    pick = ("doc", "entity", "ordinal", "key", "path", "scalar")
    full = shredding.shred(docs, "export_id", "manifest").filter("entity is not null or path = 'model'").select(*pick)
    some = shredding.shred(docs, "export_id", "manifest", only=("model",)).select(*pick)
    assert sorted(map(str, full.collect())) == sorted(map(str, some.collect())) and some.count() > 50
