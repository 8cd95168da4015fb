from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from rasterloom.functions import radiometry, spatial, strings, temporal, tiles
from rasterloom.operators import catalog, inspection, pooling, scan
from rasterloom.plans import models


def one(spark, *cols, row=None, schema=None):
    df = spark.createDataFrame([row], schema) if row else spark.range(1)
    return df.select(*cols).first()


def d(s):
    return F.lit(s).cast("date")


def bins_of(spark, col):
    return [(b.start.isoformat(), b.end.isoformat()) for b in one(spark, col.alias("b")).b]


@pytest.mark.parametrize("days,n", [(10, 3), (1, 4), (7, 7), (365, 8), (3, 5)])
def test_equal_bins(spark, days, n):
    s, e = date(2022, 1, 1), date(2022, 1, 1) + timedelta(days)
    want = []
    for i in range(n):
        a, b = s + timedelta(days * i // n), e if i == n - 1 else s + timedelta(days * (i + 1) // n)
        b = b if b > a else min(e, a + timedelta(1))
        if a < b:
            want.append((a.isoformat(), b.isoformat()))
    assert bins_of(spark, temporal.equal_bins(d(str(s)), d(str(e)), n)) == want


def test_fixed_bins_and_stretching(spark):
    s, e = d("2022-01-01"), d("2022-03-10")
    assert bins_of(spark, temporal.fixed_bins(s, e, 30)) == [("2022-01-01", "2022-01-31"), ("2022-01-31", "2022-03-02"), ("2022-03-02", "2022-03-10")]
    assert len(bins_of(spark, temporal.fixed_bins(s, e, 30, 2))) == 2
    assert one(spark, F.size(temporal.fixed_bins(s, s, 30)).alias("n")).n == 0
    short = one(spark, temporal.fixed_or_equal_bins(s, e, 30, 2).alias("x")).x
    long = one(spark, temporal.fixed_or_equal_bins(s, d("2022-12-31"), 30, 2).alias("x")).x
    assert not short.stretched and long.stretched and len(long.bins) == 2 and long.bins[-1].end == date(2022, 12, 31)


def test_calendar(spark):
    r = one(spark, temporal.day_of_year0(d("2024-12-31")).alias("a"), temporal.day_of_year0(d("2024-12-30")).alias("b"), temporal.month0(d("2024-05-05"), F.lit(13)).alias("c"), temporal.auto_frames(d("2022-01-01"), d("2022-02-26")).alias("f"), temporal.midpoint(d("2022-01-01"), d("2022-01-04")).alias("m"))
    assert (r.a, r.b, r.c, r.f, r.m) == (364, 364, 11, 2, date(2022, 1, 2))


def test_mercator_and_squares(spark):
    box = [F.lit(v) for v in (-88.23131, 40.09466, -88.22436, 40.09767)]
    s = one(spark, spatial.square_roi(*box).alias("s"), spatial.lat_of(spatial.mercator_y(F.lit(51.5))).alias("lat")).asDict()
    assert s["lat"] == pytest.approx(51.5)
    s = s["s"]
    assert s.minlon == pytest.approx(-88.23131) and s.minlat < 40.09466 and s.maxlat > 40.09767 and s.x0 == 0 and s.x1 == 1 and s.y0 + s.y1 == pytest.approx(1, abs=2e-6)
    edge = one(spark, spatial.square_roi(*[F.lit(v) for v in (179.99, 0.0, 179.999, 10.0)]).alias("s")).s
    assert (edge.minlon, edge.y0, edge.y1, edge.x0, edge.x1) == (179.99, 0.0, 1.0, 0.0, 1.0)
    halves = one(spark, spatial.split_box(*[F.lit(v) for v in (0.0, 0.0, 1.0, 10.0)]).alias("h")).h
    assert [h.part for h in halves] == ["south", "north"] and halves[0].maxlat == halves[1].minlat


@pytest.mark.parametrize("dim,tile,want", [(4, 4, [0]), (3, 4, [0]), (6, 4, [0, 2]), (300, 224, [0, 76]), (40, 4, list(range(0, 40, 4))), (400, 256, [0, 144])])
def test_tile_starts(spark, dim, tile, want):
    assert one(spark, tiles.starts(F.lit(dim), tile).alias("s")).s == want


def test_ownership_and_stitching(spark):
    axis = lambda n, t: spark.createDataFrame([(1, n)], "roi_id int, n int").select("roi_id", F.posexplode(tiles.starts(F.col("n"), t)).alias("i", "start")).withColumn("end", F.least(F.lit(n), F.col("start") + t))
    own = tiles.owned(axis(7, 4)).orderBy("i").collect()
    assert [r.own_end - r.own_start for r in own] == [3, 4]
    c = tiles.crops(axis(400, 256), 16, 256).orderBy("i").collect()
    assert sum(r.fe - r.fs for r in c) == 25 and c[1].offset == c[0].fe - c[0].fs
    assert tiles.gaps(spark.createDataFrame([(1, 0, 0, 4), (1, 1, 6, 9)], "roi_id int, i int, start int, end int")).count() == 1


def test_stitching_an_identity_gives_the_image_back(spark):
    h, w, t = 6, 7, 4
    img = spark.createDataFrame([(1, h, w)], "roi_id int, h int, w int")
    lay = tiles.layout(img, t)
    cells = lay.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(t - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(t - 1)))).withColumn("d", F.lit(0))
    cells = cells.withColumn("value", ((F.col("y0") + F.col("y")) * w + F.col("x0") + F.col("x")).cast("double"))
    rows = lay.select("roi_id", F.col("row").alias("i"), F.col("y0").alias("start"), F.col("y1").alias("end")).distinct()
    cols = lay.select("roi_id", F.col("col").alias("i"), F.col("x0").alias("start"), F.col("x1").alias("end")).distinct()
    got = pooling.stitched(cells, tiles.crops(rows, t, t), tiles.crops(cols, t, t)).collect()
    assert {(r.y, r.x): r.value for r in got} == {(y, x): y * w + x for y in range(h) for x in range(w)} and len(got) == h * w


def test_windows_and_sides():
    assert tiles.token_box((0.0, 0.0, 0.5, 0.51), 4, 4) == (0, 1, 2, 3)
    assert tiles.full((0, 1, 0, 1)) and not tiles.full((0, 0.9, 0, 1))
    assert tiles.side_unit(10, 16, [10, 20, 60]) == 96
    assert pooling.split_stitch(5, 6, 8) == (1, 2, 0) and pooling.split_stitch(4, 4, 9) == (0, 0, 1)
    with pytest.raises(ValueError):
        pooling.split_stitch(10, 10, 10)


def test_strings(spark):
    r = one(spark, strings.sanitized(F.lit("--a b//c__d!")).alias("a"), strings.sanitized(F.lit("!!")).alias("b"), strings.dim_suffix(F.lit("a--b")).alias("c"), strings.value_range(F.lit("1, 2.5")).alias("v"), strings.value_range(F.lit("1")).alias("n"), strings.switch(F.lit(" ON ")).alias("s"), strings.switch(F.lit("7")).alias("t"), strings.input_key(F.lit("k"), F.lit("multi:8")).alias("k"), strings.or_auto(F.lit(" ")).alias("o"))
    assert (r.a, r.b, r.c, r.v.lo, r.v.hi, r.n, r.s, r.t, r.k, r.o) == ("a_b_c_d", "item", "a__b", 1.0, 2.5, None, True, True, "k--multi_8", "auto")


def test_scenes(spark):
    px = spark.createDataFrame([(1, "B", "2024-01-01", 1.0, 1), (1, "B", "2024-01-01", 5.0, 2), (1, "B", "2024-01-09", None, 3), (1, "B", "2024-01-20", 9.0, 4)], "roi int, band string, ts string, value double, id int").withColumn("ts", F.to_timestamp("ts"))
    assert scan.mosaic_composite(px.filter("id < 4"), ["roi"]).first().value == 5.0
    w = spark.createDataFrame([(1,)], "roi int").withColumn("bins", temporal.fixed_bins(d("2024-01-01"), d("2024-02-01"), 7))
    b = scan.binned(px, w, ["roi", "band"])
    got = {r.k: (r.value, r.empty) for r in b.collect()}
    assert got[0] == (3.0, False) and got[1] == (None, False) and got[2] == (9.0, False) and got[3] == (None, True)
    f = {r.k: (r.filled, r.source) for r in scan.backfilled(b, ["roi", "band"]).collect()}
    assert f[1] == (3.0, "nearest") and f[4] == (9.0, "nearest")


def test_radiometry_and_inspection(spark):
    px = spark.createDataFrame([(1, "a", v) for v in (0.0, 1.0, 2.0, float("nan"), None)] + [(1, "b", 5.0)] * 3, "roi int, band string, value double")
    f = {r.band: r for r in inspection.flags(px, ["roi", "band"], 0.0, 1.5, 0.0).collect()}
    assert f["a"].issues == "not_finite,out_of_range" and f["b"].issues == "constant,out_of_range" and not f["b"].ok
    s = {r.band: r for r in inspection.statistics(px, ["roi", "band"]).collect()}
    assert s["a"].finite_share == pytest.approx(0.6) and s["a"].std == pytest.approx((2 / 3) ** 0.5)
    h = {r.bin: r.n for r in inspection.histogram(px.filter("band = 'a'"), ["roi", "band"], 0.0, 2.0).collect()}
    assert len(h) == 32 and (h[0], h[16], h[31]) == (1, 1, 1)
    z = radiometry.log_p99(spark.createDataFrame([(1, 0.0), (1, -3.0)], "roi int, value double"), ["roi"]).collect()
    assert [r.scaled for r in z] == [0.0, 0.0]


def test_tokens(spark):
    rows = [(1, p, 0, float(p)) for p in range(5)] + [(2, p, 0, float(p)) for p in range(4)] + [(3, 0, 0, 7.0)]
    t = spark.createDataFrame(rows, "id int, pos int, d int, value double")
    assert {r.id: r.value for r in pooling.pooled_tokens(t, ["id"]).collect()} == {1: 2.5, 2: 1.5, 3: 7.0}
    assert {(r.id, r.y, r.x): r.value for r in pooling.token_grid(t, ["id"]).filter("id = 1").collect()} == {(1, 0, 0): 1.0, (1, 0, 1): 2.0, (1, 1, 0): 3.0, (1, 1, 1): 4.0}


def test_fetch_plan(spark):
    m = spark.createDataFrame([("p", "c", "s", 0, ["B1", "B2"]), ("q", "c", "s", 1, ["B3", "B2"]), ("r", "c", "t", 2, ["B2"])], "model string, collection string, semantics string, pos int, bands array<string>")
    got = {r.model: (r.fetch_bands, r.channels) for r in catalog.fetch_plan(m).collect()}
    assert got == {"p": (["B1", "B2", "B3"], [0, 1]), "q": (["B1", "B2", "B3"], [2, 1]), "r": (["B2"], [0])}
    assert catalog.duplicates(spark.createDataFrame([("a b",), ("a-b",), ("c",)], "n string"), "n").count() == 1


def test_images():
    import numpy as np

    x = np.arange(12, dtype=float).reshape(1, 3, 4)
    assert models.squared(x).shape == (1, 4, 4) and models.squared(x, "crop").shape == (1, 3, 3)
    assert (models.bilinear(x, 3, 4) == x).all() and models.bilinear(x, 6, 8).shape == (1, 6, 8)
    assert models.frames(x, 3).shape == (3, 1, 3, 4) and models.padded(x, 4).shape == (1, 4, 4)
    t = models.tiles(np.arange(18).reshape(1, 3, 6), 4)
    assert [(r, c) for r, c, _ in t] == [(0, 0), (0, 1)] and (t[0][2][0, 3] == t[0][2][0, 2]).all()


def test_own_normalisers_and_channel_statistics(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "point_index int, band string, value double")
    radiometry.register_normaliser("external", lambda rows, value: rows.withColumn("z", F.col(value) * 2))
    assert radiometry.normalised(df, "external", spark).first().z == 4.0
    radiometry._own.clear()
    for bad in (lambda: radiometry.normalised(df, "external", spark), lambda: radiometry.zscore_channels(F.lit(None), 5)):
        with pytest.raises(ValueError):
            bad()
    assert [len(m) for m, s in radiometry.CHANNEL_STATS.values()] == list(radiometry.CHANNEL_STATS) == [len(s) for m, s in radiometry.CHANNEL_STATS.values()]
    assert radiometry.normalised(df, "none", spark).first().z == 2.0 and radiometry.normalised(df, "raw", spark).first().z == 2.0
