"""Inputs by the catalog, shared scans, weights, chunks."""

from datetime import date

import numpy as np
import pytest

from rasterloom.plans import api, catalog, inputs, pipeline, providers, weights
from rasterloom.plans.errors import ModelError, SpecError


class Recorder(providers.Provider):
    def __init__(self, fail=()):
        self.asked, self.fail = [], fail

    def images(self, requests, sensor=None):
        self.asked.append(sensor)
        if sensor.collection in self.fail:
            raise OSError("no such collection")
        n = len(sensor.bands)
        return requests.selectExpr("point_index", f"{n} AS c", "1 AS h", "2 AS w", f"transform(sequence(0, {2 * n - 1}), i -> cast(i AS float)) AS pixels")


@pytest.fixture
def requests(spark):
    return api.requests_of(spark, [api.BBox(0, 0, 4, 1), api.BBox(10, 10, 11, 11)], api.Period.range("2022-01-01", "2022-12-31"))


def test_squares_and_windows(spark, requests):
    p = Recorder()
    got = {r.point_index: r for r in inputs.model_input(p, requests, "clay").collect()}
    assert p.asked[0].bands == catalog.S2_10 and got[0].c == 10 and 0 < got[0].y0 < got[0].y1 < 1 and (got[0].x0, got[0].x1) == (0.0, 1.0)
    with pytest.raises(ModelError):
        inputs.model_input(p, requests, "gse")


def test_models_share_a_scan(spark, requests):
    s = {"a": catalog.Sensor("X", ("B1", "B2")), "b": catalog.Sensor("X", ("B2", "B3")), "c": catalog.Sensor("Y", ("B1",)), "d": catalog.Sensor("X", ("B2",), 20)}
    plan = inputs.shared_scans(s)
    assert [(p.bands, m) for p, m in plan] == [(("B1", "B2", "B3"), {"a": (0, 1), "b": (1, 2)}), (("B1",), {"c": (0,)}), (("B2",), {"d": (0,)})]
    assert len(inputs.shared_scans({"a": s["a"], "b": s["b"]}, {"a": 1, "b": 8})) == 2
    p = Recorder(fail=("Y",))
    f = inputs.Prefetched(p, requests, s)
    assert f.of("b").first().pixels == [2.0, 3.0, 4.0, 5.0] and f.of("a").first().pixels == [0.0, 1.0, 2.0, 3.0]
    bad = f.of("c").collect()
    assert len(bad) == 2 and "no such collection" in bad[0].error and f.of("d").count() == 2
    assert len(p.asked) == 3 and inputs.summary(f) == {"total": 3, "completed": 2, "failed": 1, "cache_hits": 1}
    assert inputs.taken(f.of("d"), (1,)).first().error == "no channel 1"


def test_settings(monkeypatch):
    e = catalog.entry("prithvi")
    assert inputs.temporal_mode({}, 92, e) == ("multi", 3) and inputs.temporal_mode({"temporal_mode": "single"}, 92, e) == ("single", 1) and inputs.temporal_mode({"n_frames": 2}, 1, e) == ("multi", 2)
    monkeypatch.setenv("RASTERLOOM_TEMPORAL_MODE", "multi")
    with pytest.raises(SpecError):
        inputs.temporal_mode(None, 5, e)
    assert inputs.setting({"x": "yes"}, "x", "NOPE", False) is True and inputs.setting(None, "x", "NOPE", 5) == 5 and inputs.setting({"x": "7"}, "x", "NOPE", 5) == 7
    for bad in (lambda: inputs.setting({"x": "seven"}, "x", "NOPE", 5), lambda: inputs.setting({"x": "maybe"}, "x", "NOPE", True), lambda: inputs.setting({"x": "z"}, "x", "NOPE", "a", ("a", "b"))):
        with pytest.raises(SpecError):
            bad()
    assert inputs.fitted([1, 2], 4) == [1, 2, 2, 2] and inputs.fitted([1, 2, 3], 2) == [1, 2]


def test_what_goes_in_beside_the_pixels(spark, requests):
    r = inputs.beside(requests, 3).orderBy("point_index").first()
    assert len(r.dates) == len(r.doy0) == len(r.month0) == 3 and r.dates[0] == date(2022, 3, 2) and r.month0[0] == 2 and r.years_doys[0].doy == 61 and r.centre.lon == 2.0 and len(r.place) == 4


def test_weights(tmp_path, monkeypatch):
    a = np.ones((2, 3))
    state = {"state_dict": {"model": {f"module.encoder.blocks.{i}.w": a * i for i in (1, 2)}}}
    flat = weights.unwrapped(state)
    assert weights.stripped(flat).keys() == {"blocks.1.w", "blocks.2.w"}
    best, missing, rest = weights.best_match(flat, {"blocks.1.w": (2, 3), "blocks.9.w": (2, 3)})
    assert list(best) == ["blocks.1.w"] and missing == ["blocks.9.w"] and rest == ["blocks.2.w"]
    assert set(weights.shifted(weights.stripped(flat), "blocks", -1)) == {"blocks.0.w", "blocks.1.w"} and weights.depth_of(weights.stripped(flat), "blocks") == 3
    for bad in (lambda: weights.unwrapped({"x": 1}), lambda: weights.best_match(flat, {"q": (1,)}), lambda: weights.verified({}, "m"), lambda: weights.verified({"a": a * np.nan}, "m"), lambda: weights.verified({"a": a * 1e-9}, "m", True), lambda: weights.located("none.bin", cache=str(tmp_path)), lambda: weights.located("x", path="/nowhere")):
        with pytest.raises(ModelError):
            bad()
    (tmp_path / "w.bin").write_bytes(b"123")
    assert weights.located("w.bin", cache=str(tmp_path)).endswith("w.bin")
    with pytest.raises(ModelError):
        weights.located("w.bin", cache=str(tmp_path), least_bytes=4)
    monkeypatch.setenv("CUDA_VISIBLE_DEVICES", "0")
    assert weights.device() == "cuda" and weights.device("CPU") == "cpu"


def test_chunks(spark):
    df = spark.range(10).withColumnRenamed("id", "point_index")
    seen = []

    def store(c):
        ids = sorted(r.point_index for r in c.collect())
        if 4 in ids:
            raise ValueError("four")
        seen.append(ids)

    with pipeline.Progress(spark, seconds=0.05):
        got = pipeline.in_chunks(df, 4, lambda r: r, store, go_on=True)
    assert seen == [[0, 1, 2, 3], [8, 9]] and [k for k, e in got if e] == [1]
    with pytest.raises(ValueError):
        pipeline.in_chunks(df, 4, lambda r: r, store)
    assert pipeline.in_chunks(df.limit(0), 4, lambda r: r, store) == []


def test_lazy_models_and_what_they_accept(spark):
    from rasterloom.plans import models

    models.register_lazy("far", "rasterloom.plans.nowhere:Far")
    with pytest.raises(KeyError, match="nowhere"):
        models.get("FAR")
    models.register_lazy("near", "rasterloom.plans.models:BandMax")
    assert isinstance(models.get("near"), models.BandMax)
    assert models.accepts(models.BandMax, "embed", "batch") and not models.accepts(models.BandMax, "embed", "window") and not models.accepts(models.BandMax, "grid", "batch")

    class Says:
        capabilities = {"window": True}

    assert models.accepts(Says, "embed", "window")
    for name in ("near", "far"):
        models._factories.pop(name, None)
        models._lazy.pop(name)
    models.reset()


def test_a_catalog_model_gets_its_square_and_is_cropped_back(spark):
    from rasterloom.plans import models

    class Grid(providers.Provider):
        def images(self, requests, sensor=None):
            return requests.selectExpr("point_index", "1 AS c", "4 AS h", "4 AS w", "transform(sequence(0, 15), i -> cast(i AS float)) AS pixels")

    kept = dict(models._factories)
    models.register("fomo", pool_kind="grid")(models.Cells)
    try:
        providers.register_provider("grid", Grid)
        row = api.get_embeddings_batch(spark, "fomo", [api.BBox(0, -0.9, 4, 0.9)], provider="grid", output=api.Output("grid"), prep="resize").first()
        assert row.shape == [1, 2, 4] and row.embedding == [float(i) for i in range(4, 12)]
    finally:
        models._factories.clear()
        models._factories.update(kept)
        models.register("cells", pool_kind="grid")(models.Cells)
