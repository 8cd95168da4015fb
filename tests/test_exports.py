"""Providers, the model catalog, export files of every format, loading them again, and netCDF."""

import json
import struct
import zlib

import numpy as np
import pytest

from rasterloom.operators import fetch, guards, inspection, manifests, products
from rasterloom.plans import api, catalog, providers
from rasterloom.plans.errors import ModelError, ProviderError, SpecError
from rasterloom.sources import netcdf, quicklook, storage

SPOTS = [api.BBox(0, 0, 4, 1), api.PointBuffer(5, 5, 100), api.PointBuffer(6, 6, 100)]


@pytest.fixture(scope="module")
def pixels(spark):
    rows = [(p, b, y, x, float(100 * y + x + 1000 * b + 10_000 * p)) for p in range(3) for b in range(2) for y in range(2) for x in range(3)]
    return spark.createDataFrame(rows, "point_index bigint, band int, y int, x int, value double")


@pytest.mark.parametrize("kind,layout", [("npz", "combined"), ("npz", "per_item"), ("netcdf", "combined"), ("netcdf", "per_item"), ("parquet", "combined")])
def test_export_and_load(spark, pixels, tmp_path, kind, layout):
    api.register_provider("pix", api.from_pixels(pixels))
    path = f"{tmp_path}/e"
    rows = api.export_batch(spark, SPOTS, ["band_mean", "cells"], path, provider="pix", output=api.Output("pooled", "max"), layout=layout, file_format=kind)
    assert rows.count() == 6
    got = api.load_export(spark, path)
    v = {(r.model, r.point_index): list(r.embedding) for r in got.rows.collect()}
    assert v["cells", 1] == [10_102.0, 11_102.0] and v["band_mean", 1] == [10_051.0, 11_051.0]
    assert got.ok_models() == ["band_mean", "cells"] and got.failed_models() == []
    assert [r.point_index for r in got.embedding("cells").orderBy("point_index").collect()] == [0, 1, 2]
    with pytest.raises(KeyError):
        got.embedding("nothing")
    if kind != "parquet" and layout == "per_item":
        names = storage.names(path)
        assert {"p00000.json", "p00002.json"} <= set(names) and json.loads(storage.read(f"{path}/p00001.json"))["status"] == "ok"
        one = api.load_export(spark, f"{path}/p00001.json").rows.collect()
        assert {(r.model, r.point_index) for r in one if r.status} == {("band_mean", 1), ("cells", 1)}
        storage.remove(f"{path}/p00002.json")
        with pytest.raises(Exception, match="manifest"):
            api.load_export(spark, path).rows.count()
    with pytest.raises(FileNotFoundError):
        api.load_export(spark, f"{tmp_path}/none")


def test_another_preparation_or_output_is_another_request(spark, pixels, tmp_path):
    api.register_provider("pix", api.from_pixels(pixels))
    path = f"{tmp_path}/f"
    how = dict(provider="pix", output=api.Output("pooled", "mean"))
    api.export_batch(spark, SPOTS[:1], ["cells"], path, **how)
    api.export_batch(spark, SPOTS[:1], ["cells"], path, **how)
    assert spark.read.parquet(path).count() == 1
    assert api.export_batch(spark, SPOTS[:1], ["cells"], path, provider="pix", output=api.Output("pooled", "max")).first().embedding == [102.0, 1102.0]
    api.export_batch(spark, SPOTS[:1], ["cells"], path, prep=api.InputPrep(tile_size=2), **how)
    assert spark.read.parquet(path).count() == 3


def test_providers(spark, pixels, monkeypatch):
    providers.register_provider("lazy", "rasterloom.nowhere:thing")
    assert providers.has_provider("LAZY") and not providers.has_provider("") and "lazy" in providers.list_providers()
    with pytest.raises(ProviderError, match="nowhere"):
        providers.resolve_provider("lazy")
    providers.register_provider("one", api.from_pixels(pixels))
    assert providers.resolve_provider("one") is providers.resolve_provider("one")
    monkeypatch.setenv(providers.DEFAULT, "one")
    assert providers.resolve_provider("auto") is providers.resolve_provider("one")
    with pytest.raises(ProviderError):
        providers.register_provider("auto", api.from_pixels(pixels))

    class Down(providers.Provider):
        def ready(self):
            raise ProviderError("down")

    providers.register_provider("down", Down)
    with pytest.raises(ProviderError, match="down"):
        providers.resolve_provider("down")
    with pytest.raises(ProviderError):
        providers.Provider().images(None)


def test_catalog(spark):
    assert len(catalog.MODELS) == 20 and len(catalog.ALIASES) == 11 and catalog.list_models(spark, True).count() == 31
    assert catalog.entry(" SATMAE++ ").name == "satmaepp" and catalog.supports("thor", "Sentinel-1") and not catalog.supports("clay", "s1")
    assert catalog.sensor_for("terrafm", modality="sentinel1").bands == ("VV", "VH")
    assert catalog.sensor_for("clay", fetch={"scale_m": 20, "cloudy_pct": None}).scale_m == 20
    for bad in (lambda: catalog.sensor_for("clay", catalog.Sensor("X"), {}), lambda: catalog.sensor_for("clay", modality="s1"), lambda: catalog.sensor_for("clay", catalog.Sensor("X"), modality="toa"), lambda: catalog.overridden(catalog.Sensor("X"), {"bands": 1}), lambda: catalog.Sensor("X", composite="sum")):
        with pytest.raises(SpecError):
            bad()
    with pytest.raises(ModelError):
        catalog.entry("nothing")
    assert catalog.check("gse", ranged=True) and not catalog.check("clay")
    with pytest.raises(ModelError):
        catalog.check("clay", backend="somewhere")
    assert catalog.frame_count(catalog.entry("prithvi"), 92) == 3 and catalog.frame_count(catalog.entry("galileo"), 365) == 12 and catalog.frame_count(catalog.entry("anysat"), 1) == 8 and catalog.frame_count(catalog.entry("clay"), 99, 4) == 4


def test_netcdf_round_trip():
    arrays = {"input_chw__m": np.arange(24, dtype=np.float32).reshape(2, 3, 4), "embedding__m": np.arange(5.0), "embeddings__n": np.ones((3, 7), np.float32), "indices": np.array([1, -2], np.int64), "embedding__k": np.arange(6.0)}
    back, axes, attrs = netcdf.decode(netcdf.encode(arrays, {"title": "x"}))
    assert all(np.array_equal(back[k], arrays[k]) for k in arrays) and attrs["title"] == "x" and attrs["Conventions"].startswith("CF")
    assert axes["input_chw__m"] == ("band", "y", "x") and axes["embedding__m"] == ("dim",) and axes["embedding__k"] == ("dim__embedding__k",) and axes["embeddings__n"][0] == "point"
    assert netcdf.dims_of("inputs_bchw__m", 4) == ("point", "band", "y", "x") and netcdf.dims_of("other", 2) == ("d0", "d1")
    for bad in ({"a": np.array(["x"])}, {"a": np.array([2**40])}):
        with pytest.raises(ValueError):
            netcdf.encode(bad)
    with pytest.raises(ValueError):
        netcdf.decode(b"nothing like it")
    assert netcdf.decode(netcdf.encode({}))[0] == {}


def test_quicklook(spark, tmp_path):
    x = np.random.default_rng(0).random((3, 4, 5))
    df = spark.createDataFrame([(0, 3, 4, 5, x.ravel().tolist()), (1, 1, 1, 1, [1.0])], "point_index bigint, c int, h int, w int, pixels array<double>")
    got = {r.point_index: r for r in quicklook.save(df, f"{tmp_path}").collect()}
    data = (tmp_path / "p00000.png").read_bytes()
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == (5, 4) and got[1].error
    at = data.index(b"IDAT")
    raw = zlib.decompress(data[at + 4 : at + 4 + struct.unpack(">I", data[at - 4 : at])[0]])
    assert len(raw) == 4 * 16 and raw[1:4] == quicklook.stretched(x)[0, 0].tobytes()


def test_storage(tmp_path):
    path = f"{tmp_path}/a/b.json"
    storage.write_json(path, {"x": 1})
    assert storage.read_json_object(path) == {"x": 1} and storage.names(f"{tmp_path}/a") == ["b.json"]
    storage.write(path, b"[1]")
    assert storage.read_json_object(path) is None and storage.read_json_object(f"{tmp_path}/none") is None
    got = storage.jsonable({"a": np.arange(3.0), "b": api.BBox(0, 0, 1, 1), "c": {1, 2}, "d": float("nan"), "e": object, "f": np.int64(3), 5: api.Period.year(2020).start})
    assert got["a"] == {"dtype": "float64", "shape": [3], "min": 0.0, "max": 2.0} and got["b"]["maxlat"] == 1 and got["c"] == [1, 2] and got["d"] == "nan" and got["f"] == 3 and got["5"] == "2020-01-01"
    assert json.dumps(got)


def test_guards(spark):
    try:
        try:
            raise OSError("disk")
        except OSError as e:
            raise ValueError("not authorized") from e
    except ValueError as e:
        text = guards.error_text(e)
    assert "ValueError: not authorized <- OSError: disk" in text and "signed in" in text
    df = spark.createDataFrame([(1.0,), (2.0,)], "value double")
    assert guards.finite_weights(df).first().ok and guards.finite_weights(df.limit(0)).first().why == "no parameters"
    assert guards.finite_weights(spark.createDataFrame([(1e-9,), (0.0,)], "value double"), near_zero=True).first().why == "about zero"
    sha = spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<float>").select(guards.array_sha1(__import__("pyspark").sql.functions.col("v")).alias("s")).collect()
    import hashlib

    a = np.array([1.0, 2.0], np.float32)
    assert sha[0].s == hashlib.sha1(b"float32" + b"(2,)" + a.tobytes()).hexdigest() and sha[1].s is None


def test_an_empty_scan_stops_the_query(spark):
    df = spark.createDataFrame([(1, "a")], "a int, b string")
    assert guards.required(df, "pixels").collect() == df.collect()
    for use in (lambda d: d.collect(), lambda d: d.count(), lambda d: d.select("b").collect()):
        with pytest.raises(Exception, match="no pixels"):
            use(guards.required(df.limit(0), "pixels"))


def test_inspection_gates(spark, monkeypatch):
    p = spark.createDataFrame([(0, "a", y, x, 5.0) for y in range(3) for x in range(3)], "point_index int, band string, y int, x int, value double")
    report = inspection.flags(p, ["point_index", "band"], 0, 10, 0)
    assert inspection.gated(report, False, True).count() == 0 and inspection.gated(report, True, False).count() == 1
    with pytest.raises(Exception, match="constant"):
        inspection.gated(report, True, True).collect()
    assert inspection.checks(catalog.Sensor("X")) == (False, True)
    monkeypatch.setenv("RASTERLOOM_CHECK_INPUT", "yes")
    assert inspection.checks()[0]
    assert inspection.histogram_range(p, clip=(1, 2)) == (1, 2) and inspection.histogram_range(p) == (5.0, 6.0) and inspection.histogram_range(p, at=(0.1, 0.9)) == (5.0, 6.0) and inspection.histogram_range(p.limit(0)) == (0.0, 1.0)
    assert inspection.sampled(p, ["point_index"], 2).count() == 1


def test_scans_say_what_is_missing(spark):
    cols = "point_index bigint, collection string, band string, scene_id bigint, ts timestamp_ntz, cloud double, mode string, orbit string, y int, x int, value double"
    from datetime import datetime

    rows = [(1, catalog.S2, "B4", 1, datetime(2024, 1, 5), 5.0, None, None, 0, 0, 7.0), (1, catalog.S2, "B3", 1, datetime(2024, 1, 5), 5.0, None, None, 0, 0, float("nan")), (2, catalog.S2, "B4", 2, datetime(2024, 1, 5), 90.0, None, None, 0, 0, 7.0)]
    px = spark.createDataFrame(rows, cols)
    rq = spark.createDataFrame([(1, datetime(2024, 1, 1), datetime(2024, 2, 1)), (2, datetime(2024, 1, 1), datetime(2024, 2, 1))], "point_index bigint, start timestamp_ntz, end timestamp_ntz")
    s = catalog.Sensor(catalog.S2, catalog.RGB)
    got = fetch.assembled(fetch.patch(px, rq, s), s.bands).collect()
    assert len(got) == 1 and got[0].pixels is None and got[0].error == "no band B2; there are B3, B4"
    two = fetch.assembled(fetch.patch(px, rq, catalog.Sensor(catalog.S2, ("B4", "B3"))), ("B4", "B3")).first()
    assert two.pixels == [7.0, 0.0]
    with pytest.raises(ValueError):
        fetch.radar(px, catalog.Sensor(catalog.S1, fetch.RADAR, modality="s1", orbit="up"))
    assert fetch.native("LANDSAT/LC08/C02/T1_L2", ("red", "QA")) == ("SR_B4", "QA") and fetch.family("MODIS/061/MOD09GA") is None
    parts = fetch.split_parts(spark.createDataFrame([(1, 0.0, 0.0, 4.0, 1.0), (2, 0.0, 0.0, 1e-4, 1e-4)], "roi_id int, minlon double, minlat double, maxlon double, maxlat double"), 100, 10_000.0).collect()
    assert all(p.h * p.w <= 100 for p in parts) and sum(p.roi_id == 1 for p in parts) > 4
    area = sum((p.maxlon - p.minlon) * (p.maxlat - p.minlat) for p in parts if p.roi_id == 1)
    assert area == pytest.approx(4.0)
    assert fetch.split_parts(spark.createDataFrame([(1, 0.0, 0.0, 4.0, 1.0)], "roi_id int, minlon double, minlat double, maxlon double, maxlat double"), 100, 10.0, 2).filter("error is not null").count() == 4


def test_halves(spark):
    def strip(n, first):
        return spark.createDataFrame([(0, "b", 0, x, float(first + x)) for x in range(n)], "point_index int, band string, y int, x int, value double")

    def joined(a, b, target):
        t = spark.createDataFrame([(0, target)], "point_index int, target int")
        return [r["value"] for r in fetch.joined_halves(a, b, "x", t, fill=-1.0).orderBy("x").collect()]

    assert joined(strip(4, 0), strip(4, 4), 8) == list(range(8))
    assert joined(strip(5, 0), strip(4, 10), 6) == [0, 1, 2, 3, 12, 13]
    assert joined(strip(2, 0), strip(2, 10), 6) == [0, 1, -1, -1, 10, 11]
    with pytest.raises(Exception, match="halves"):
        joined(strip(9, 0), strip(9, 0), 6)


def test_manifest_edges(spark):
    r = spark.createDataFrame([("a", 0, "ok", None, [1.0]), ("a", 2, "failed", "x", None), ("b", 0, "ok", None, [1.0, 2.0]), ("b", 1, "ok", None, [1.0, 2.0])], "model string, point_index int, status string, error string, embedding array<double>")
    got = {x.model: x for x in manifests.packed(r).collect()}
    assert got["a"].layout == "ragged" and got["a"].errors_by_index == {2: "x"} and got["a"].status == "partial" and got["a"].indices == [0]
    assert got["b"].layout == "stacked" and got["b"].dim == 2 and got["b"].status == "ok"
    assert manifests.embedding_of(r, "a").count() == 3
    with pytest.raises(ValueError):
        manifests.embedding_of(r.filter("embedding is null"), "a")
    twice = spark.createDataFrame([("p00001.npz", None), ("other.npz", 1)], "name string, manifest_index int")
    with pytest.raises(Exception, match="two files"):
        manifests.per_item(twice).collect()
    left = manifests.in_request_order(spark.createDataFrame([("c", 0), ("a", 1), ("b", 2)], "model string, pos int"), spark.createDataFrame([("a",)], "model string"))
    assert [x.model for x in left.collect()] == ["c", "b"]
    q = spark.createDataFrame([(1, "f"), (2, "g")], "point_index int, fingerprint string")
    assert [x.status for x in manifests.resumed(q, q.filter("point_index = 2"), ["point_index", "fingerprint"]).collect()] == ["skipped"]
    assert [x.point_index for x in spark.createDataFrame([(3,), (None,), (0,)], "point_index int").orderBy(manifests.manifest_order()).collect()] == [None, 0, 3]


def test_products(spark):
    import pyspark.sql.functions as F

    t = spark.createDataFrame([(10.0, 0.0, 0.0, -10.0), (10.0, 0.1, 0.0, -10.0), (10.0, 0.0, 0.0, 10.0)], "a double, b double, d double, e double")
    assert [r.ok for r in t.select(products.north_up(*[F.col(c) for c in "abde"]).alias("ok")).collect()] == [True, False, False]
    k = products.kelvin(spark.createDataFrame([(1, 15_000.0), (2, 300.0)], "p int, value double"), ["p"])
    assert {r.p: r["value"] for r in k.collect()} == {1: 300.0, 2: 300.0}


def test_targets_and_points(tmp_path):
    from rasterloom.sources import labels, npz

    assert labels.targets(2, "/a/b", "npz") == ["/a/b.npz"] and labels.targets(2, "/a/b.nc", "netcdf") == ["/a/b.nc"]
    assert labels.targets(2, "/a", "npz", "per_item") == ["/a/p00000.npz", "/a/p00001.npz"] and labels.targets(1, "/a", "npz", "per_item", ["x y"]) == ["/a/x_y.npz"]
    for bad in (lambda: labels.targets(2, "/a", "npz", "per_item", ["x"]), lambda: labels.targets(2, "/a", "npz", "per_item", ["x", "x!"]), lambda: labels.targets(1, "/a", "zip"), lambda: labels.targets(1, "/a", "npz", "cube")):
        with pytest.raises(ValueError):
            bad()
    d = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        labels.export_points(d)
    storage.write_json(f"{d}/p00003/m.json", {})
    assert labels.export_points(d) == [(3, "m", f"{d}/p00003/m.json")]
    storage.write_json(f"{d}/p00001.json", {"point_index": 7})
    assert labels.export_points(d) == [(7, "p00001", f"{d}/p00001.json")]
    storage.write_json(f"{d}/manifest.json", {"items": [{"point_index": 1}, {"point_index": 0, "item": "q"}]})
    assert [p[:2] for p in labels.export_points(d)] == [(0, "q"), (1, "p00000")]
    a = {"x": np.arange(3, dtype=np.float32)}
    storage.write(f"{d}/a.npz", npz.as_npz(a))
    storage.write(f"{d}/a.nc", netcdf.encode(a))
    assert all(np.array_equal(npz.arrays_of(f"{d}/a.{e}")["x"], a["x"]) for e in ("npz", "nc")) and npz.arrays_of(f"{d}/none.npz") == {}


def test_lists_switches_counts_and_grid_tables(spark):
    from pyspark.sql import functions as F

    from rasterloom.functions import strings
    from rasterloom.plans import inference

    df = spark.createDataFrame([("a, b", "Yes"), ("c", None)], "l string, s string")
    assert [(r.l, r.s) for r in df.select(strings.wanted_list(F.col("l"), "bands").alias("l"), strings.wanted_switch(F.col("s"), "flag").alias("s")).collect()] == [(["a", "b"], True), (["c"], None)]
    for c in (strings.wanted_list(F.lit(" , "), "bands"), strings.wanted_switch(F.lit("perhaps"), "flag")):
        with pytest.raises(Exception, match="no bands|no switch"):
            df.select(c.alias("v")).collect()
    seen, o = guards.counted(df, "c1", F.col("s").isNull(), F.col("l") == "c")
    seen.collect()
    assert o.get == {"total": 2, "completed": 1, "failed": 1, "cache_hits": 1} and guards.counted_text(o.get).startswith("2 fetched")
    g = spark.createDataFrame([(0, "m", [float(i) for i in range(12)], [2, 2, 3]), (1, "m", [1.0], None)], "point_index int, model string, embedding array<double>, shape array<int>")
    rows = {(r.d, r.y, r.x): r["value"] for r in inference.grid_table(g).collect()}
    assert len(rows) == 12 and rows[1, 0, 2] == 8.0 and rows[0, 1, 0] == 3.0
