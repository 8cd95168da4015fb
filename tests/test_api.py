import json
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import analytics, export
from rasterloom.plans import api, models
from rasterloom.plans.errors import ProviderError
from rasterloom.sources import npz
from rasterloom.streaming import composite


@pytest.fixture(scope="module")
def pixels(spark):
    rows = [(p, b, y, x, float(100 * y + x + 1000 * b + 10_000 * p)) for p in range(3) for b in range(2) for y in range(2) for x in range(3)]
    df = spark.createDataFrame(rows, "point_index bigint, band int, y int, x int, value double")
    api.register_provider("default", api.from_pixels(df))
    return df


SPOTS = [api.BBox(0, 0, 4, 1), api.PointBuffer(5, 5, 100), api.PointBuffer(6, 6, 100)]


def test_requests_are_checked():
    for bad in (lambda: api.BBox(1, 0, 0, 1), lambda: api.PointBuffer(0, 0, 0), lambda: api.BBox(0, 0, 1, 1, "EPSG:3857"), lambda: api.Period(date(2020, 1, 2), date(2020, 1, 2)), lambda: api.Period.year(0), lambda: api.Output("cube"), lambda: api.InputPrep("cut"), lambda: api.InputPrep(max_tiles=9, max_tiles_hard=8)):
        with pytest.raises(ValueError):
            bad()
    assert api.Period.year(2021) == api.Period(date(2021, 1, 1), date(2022, 1, 1), "year")
    assert api.InputPrep("auto").resolved(api.Output("grid"), 65) == "resize" and api.InputPrep().resolved(api.Output(), 65) == "tile"


def test_embeddings_keep_the_order(spark, pixels):
    got = api.get_embeddings_batch(spark, "band_mean", SPOTS).orderBy("point_index").collect()
    assert [r.status for r in got] == ["ok"] * 3
    assert got[1].embedding == [10_051.0, 11_051.0]
    assert api.Model(spark, "band_max").get_embedding(SPOTS[0]) == [102.0, 1102.0]
    with pytest.raises(KeyError):
        api.get_embedding(spark, "nothing", SPOTS[0])
    with pytest.raises(ProviderError):
        api.resolve_provider("nowhere")


def test_a_failing_image_is_a_failed_row(spark):
    class Picky:
        def embed(self, batch):
            if any(x.min() < 0 for x in batch):
                raise ValueError("negative")
            return [x.mean(axis=(1, 2)) for x in batch]

    rows = [(0, 1, 1, 2, [1.0, 3.0]), (1, 1, 1, 2, [-1.0, 0.0]), (2, 1, 2, 2, [1.0]), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, "point_index bigint, c int, h int, w int, pixels array<double>")
    got = {r.point_index: r for r in models.infer(df, ["picky"], factories={"picky": Picky}).collect()}
    assert got[0].embedding == [2.0] and "negative" in got[1].error and got[2].status == got[3].status == "failed"


def test_export_resumes(spark, pixels, tmp_path):
    path = f"file://{tmp_path}/out"
    first = api.export_batch(spark, SPOTS[:2], ["band_mean"], path)
    assert first.count() == 2
    files = sum(1 for _ in (tmp_path / "out").rglob("*.parquet"))
    assert api.export_batch(spark, SPOTS[:2], ["band_mean"], path).count() == 2
    again = [p for p in (tmp_path / "out").rglob("*.parquet")]
    assert spark.read.parquet(path).count() == 2 and len(again) <= files + 4
    both = api.export_batch(spark, SPOTS, ["band_mean", "band_max"], path)
    assert both.count() == 6 and spark.read.parquet(path).count() == 6
    assert api.load_export(spark, path).rows.count() == 6
    with pytest.raises(ValueError):
        api.export_batch(spark, SPOTS, ["flat", "FLAT"], path)


def test_status_and_alignment(spark):
    df = spark.createDataFrame([(1, "ok"), (1, "failed"), (2, "failed"), (3, "partial"), (4, " OK ")], "e int, status string")
    assert {r.e: r.status for r in export.rollup(df, ["e"]).collect()} == {1: "partial", 2: "failed", 3: "partial", 4: "ok"}
    p = spark.createDataFrame([("m", 0, 1.0), ("m", 3, 2.0)], "model string, point_index int, v double")
    assert [(r.point_index, r.v) for r in export.aligned(p, ["model"]).orderBy("point_index").collect()] == [(0, 1.0), (1, None), (2, None), (3, 2.0)]
    m = spark.createDataFrame([(1, "failed", "old"), (2, "open", None)], "i int, status string, error string")
    r = spark.createDataFrame([(1, "ok", None), (2, "ok", None)], "i int, status string, error string")
    assert {x.i: x.status for x in export.injected(m, r, ["i"]).collect()} == {1: "failed", 2: "ok"}


def test_npz(spark, tmp_path):
    npz.register(spark)
    rows = [("a", i, "ok", None, [float(i), 1.0], json.dumps({"i": i})) for i in range(5)] + [("a", 5, "failed", "why", None, None), ("b", 0, "ok", None, [1.0], None), ("b", 1, "ok", None, [1.0, 2.0], None)]
    df = spark.createDataFrame(rows, npz.SCHEMA)
    df.coalesce(2).write.format("npz").mode("append").save(str(tmp_path / "e"))
    got = spark.read.format("npz").load(str(tmp_path / "e"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    df.limit(1).write.format("npz").mode("overwrite").save(str(tmp_path / "e"))
    assert spark.read.format("npz").load(str(tmp_path / "e")).count() == 1
    next((tmp_path / "e").glob("*.json")).unlink()
    with pytest.raises(Exception, match="manifest"):
        spark.read.format("npz").load(str(tmp_path / "e")).count()


def test_stream_of_late_scenes(spark, tmp_path):
    src = tmp_path / "src"
    rows = [("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 12:00:00", 3.0), ("a", "2024-01-20 00:00:00", 5.0), ("a", "2024-02-20 00:00:00", 5.0)]
    df = spark.createDataFrame(rows, "band string, ts string, value double").withColumn("ts", F.to_timestamp_ntz("ts"))
    df.coalesce(1).write.parquet(str(src))
    s = composite.read_scenes(spark, str(src), df.schema)
    composite.drain(composite.windowed(s, ["band"]), str(tmp_path / "out"), str(tmp_path / "mark"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("start").collect()
    assert got[0]["mean"] == 2.0 and got[0]["n"] == 2 and len(got) == 2  # the last bin is still open
    composite.export_stream(composite.read_scenes(spark, str(src), df.schema), lambda b: b, str(tmp_path / "b"), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == 4


def test_analytics(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(60, None)], "vec_id bigint, embedding array<double>")
    got = analytics.cosine_nearest(v.filter("vec_id % 20 = 0"), v, 3, block_rows=2).orderBy("query", "rank").collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 20, 40):
        s = u @ u[q]
        s[q] = -2
        assert [r.other for r in got if r.query == q] == np.argsort(-s)[:3].tolist()
    c = {(r.i, r.j): r["cov"] for r in analytics.covariance(v, "embedding").collect()}
    assert c[1, 2] == pytest.approx(np.cov(x.T, bias=True)[1, 2])
    pc = np.array([r.pc for r in analytics.pca(v, "vec_id", "embedding").orderBy("vec_id").collect()])
    assert pc.var(0)[0] == pytest.approx(np.linalg.eigvalsh(np.cov(x.T, bias=True)).max())
    labels = spark.createDataFrame([(1, 0.0, 0.0, 5.0), (2, 0.0, 2.0, 7.0), (3, None, 0.0, 1.0), (4, 0.0, 2.0, 9.0)], "label_id bigint, lon double, lat double, label double")
    pts = spark.createDataFrame([(1, 0.1, 0.1), (2, 0.0, 1.0), (3, 0.0, 9.0)], "id bigint, lon double, lat double")
    for n in (1, 100):
        assert {r.id: r.label_id for r in analytics.nearest_label(pts, labels, n).collect()} == {1: 1, 2: 1, 3: 2}


def test_inspection_report(spark, pixels):
    got = api.inspect_images(pixels, 0.0, 10_000.0)
    assert got.count() == 6 and got.filter("point_index = 2 and not ok").count() == 2


def test_command_line(spark, capsys):
    assert api.main(["nothing"]) == 2
    assert api.main(["models"]) == 0
    assert {json.loads(x)["model"] for x in capsys.readouterr().out.strip().split("\n")} >= {"band_mean", "flat"}
