"""More of the engine's operators as queries with their SQL: scans, products, scaling, tiled inference, exports.

``events`` stand for pixels of scenes (an event is a pixel of a scene of its own), ``embeddings`` for images of 8 x 8 pixels
and for products, ``lineitem`` for digital numbers, ``orders`` for results of an export.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.common import table
from rasterloom.functions import radiometry, spatial, strings, temporal
from rasterloom.operators import export, fetch, inspection, manifests, products
from rasterloom.plans import catalog, inference
from rasterloom.plans.catalog import Sensor

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[name or f.__name__] = f
        if sql is not None:
            _sql[name or f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _r(c: Column | str, n: int = 6) -> Column:
    return F.round(c, n)


# Scans.

_BANDS = {"view": "B2", "click": "B3", "purchase": "B4", "signup": "B8"}
_CASE = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _BANDS.items()) + " ELSE 'B11' END"
_PIXELS = f"""e AS (SELECT user_id AS point_index, {_CASE} AS band, event_id AS scene_id, ts, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS cloud,
  CAST(event_id % 2 AS INTEGER) AS y, CAST((event_id // 2) % 2 AS INTEGER) AS x, value FROM events)"""
_WINDOW = "ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-24'"


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    band = F.lit(None)
    for a, b in reversed(_BANDS.items()):
        band = F.when(F.col("event_type") == a, b).otherwise(band)
    i = F.col("event_id")
    return e.select(
        F.col("user_id").alias("point_index"), F.lit(catalog.S2).alias("collection"), F.coalesce(band, F.lit("B11")).alias("band"), i.alias("scene_id"), "ts", F.get_json_object("props", "$.k").try_cast("double").alias("cloud"),
        F.when(i % 3 == 0, "EW").otherwise("IW").alias("mode"), F.when(i % 2 == 0, "ASCENDING").otherwise("DESCENDING").alias("orbit"), (i % 2).cast("int").alias("y"), (F.floor(i / 2) % 2).cast("int").alias("x"), "value",
    )


def _requests(spark: SparkSession, d: str) -> DataFrame:
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    return table(spark, d, "events").select(F.col("user_id").alias("point_index")).distinct().select("point_index", day("2024-01-03").alias("start"), day("2024-01-24").alias("end"))


@query(f"WITH {_PIXELS} SELECT point_index, band, y, x, round(median(value), 6) AS value FROM e WHERE {_WINDOW} AND cloud <= 30 AND band IN ('B2', 'B3', 'B8') GROUP BY ALL")
def sensor_patch(spark: SparkSession, d: str) -> DataFrame:
    s = Sensor(catalog.S2, ("BLUE", "green", "B8"))
    return fetch.patch(_pixels(spark, d), _requests(spark, d), s).withColumn("value", _r("value"))


@query(f"""WITH {_PIXELS}, m AS (SELECT point_index, band, y, x, arg_max(value, (ts, scene_id)) AS value FROM e WHERE {_WINDOW} AND cloud <= 60 AND band IN ('B4', 'B3', 'B2') GROUP BY ALL),
s AS (SELECT point_index, CAST(max(y) + 1 AS INTEGER) AS h, CAST(max(x) + 1 AS INTEGER) AS w, count(DISTINCT band) AS n FROM m GROUP BY 1),
k AS (SELECT point_index, h, w, unnest(range(3 * h * w)) AS k FROM s WHERE n = 3)
SELECT k.point_index, k.h, k.w, CAST(k.k AS INTEGER) AS k, coalesce(m.value, 0.0) AS value FROM k LEFT JOIN m ON m.point_index = k.point_index AND m.y = (k.k // k.w) % k.h AND m.x = k.k % k.w AND m.band = ['B4', 'B3', 'B2'][k.k // (k.h * k.w) + 1]""")
def rgb_patch(spark: SparkSession, d: str) -> DataFrame:
    s = Sensor(catalog.S2, catalog.RGB, 10, 60, composite="mosaic")
    images = fetch.assembled(fetch.patch(_pixels(spark, d), _requests(spark, d), s), s.bands)
    return images.filter("error is null").select("point_index", "h", "w", F.posexplode("pixels").alias("k", "value"))


@query(f"""WITH {_PIXELS}, m AS (SELECT point_index, band, y, x, median(value) AS value FROM e WHERE {_WINDOW} GROUP BY ALL),
s AS (SELECT point_index, list_sort(list(DISTINCT band)) AS bands, max(y) + 1 AS h, max(x) + 1 AS w FROM m GROUP BY 1), k AS (SELECT *, unnest(range(len(bands) * h * w)) AS k FROM s)
SELECT k.point_index, k.bands[k.k // (h * w) + 1] AS band, CAST(k.k AS INTEGER) AS k, round(coalesce(m.value, 0.0), 6) AS value FROM k LEFT JOIN m ON m.point_index = k.point_index AND m.band = k.bands[k.k // (h * w) + 1] AND m.y = (k.k // w) % h AND m.x = k.k % w""")
def all_bands_patch(spark: SparkSession, d: str) -> DataFrame:
    images = fetch.every_band(_pixels(spark, d), _requests(spark, d), catalog.S2)
    rows = images.select("point_index", "bands", "h", "w", F.posexplode("pixels").alias("k", "value"))
    return rows.select("point_index", F.element_at("bands", (F.floor(F.col("k") / (F.col("h") * F.col("w"))) + 1).cast("int")).alias("band"), "k", _r("value").alias("value"))


# Radar: a scene is an hour, both polarisations stand in most.
_RADAR = """r AS (SELECT user_id % 7 AS point_index, CASE WHEN event_id % 5 < 2 THEN 'VV' WHEN event_id % 5 < 4 THEN 'VH' ELSE 'HH' END AS band, CAST(floor(epoch(ts) / 7200) AS BIGINT) AS scene_id,
  ts, CAST(event_id % 2 AS INTEGER) AS y, CAST((event_id // 2) % 2 AS INTEGER) AS x, value FROM events),
q AS (SELECT *, CASE WHEN (scene_id + point_index) % 4 = 0 OR point_index = 3 THEN 'EW' ELSE 'IW' END AS mode, CASE WHEN scene_id % 2 = 0 THEN 'ASCENDING' ELSE 'DESCENDING' END AS orbit FROM r),
s AS (SELECT point_index, scene_id, mode, orbit, bool_or(band = 'VV') AS vv, bool_or(band = 'VH') AS vh FROM q WHERE orbit = 'ASCENDING' GROUP BY ALL),
f AS (SELECT point_index, max(mode = 'IW') AS iw FROM s WHERE vv AND vh GROUP BY 1),
g AS (SELECT s.point_index, s.scene_id FROM s JOIN f USING (point_index) WHERE vv AND vh AND (mode = 'IW' OR NOT iw))"""
_RADAR_SENSOR = Sensor(catalog.S1_FLOAT, fetch.RADAR, cloudy_pct=None, modality="s1", orbit="ascending")


def _radar(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events")
    i, hour = F.col("event_id"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 7200).cast("bigint")
    p = e.select((F.col("user_id") % 7).alias("point_index"), F.lit(catalog.S1_FLOAT).alias("collection"), F.when(i % 5 < 2, "VV").when(i % 5 < 4, "VH").otherwise("HH").alias("band"), hour.alias("scene_id"), "ts", F.lit(None).cast("double").alias("cloud"), (i % 2).cast("int").alias("y"), (F.floor(i / 2) % 2).cast("int").alias("x"), "value")
    p = p.withColumn("mode", F.when(((F.col("scene_id") + F.col("point_index")) % 4 == 0) | (F.col("point_index") == 3), "EW").otherwise("IW")).withColumn("orbit", F.when(F.col("scene_id") % 2 == 0, "ASCENDING").otherwise("DESCENDING"))
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    return p, p.select("point_index").distinct().select("point_index", day("2000-01-01").alias("start"), day("2100-01-01").alias("end"))


@query(f"WITH {_RADAR} SELECT point_index, band, y, x, round(median(value), 6) AS value FROM q JOIN g USING (point_index, scene_id) WHERE band IN ('VV', 'VH') GROUP BY ALL")
def radar_patch(spark: SparkSession, d: str) -> DataFrame:
    return fetch.patch(*_radar(spark, d), _RADAR_SENSOR).withColumn("value", _r("value"))


@query(f"""WITH {_RADAR}, n AS (SELECT point_index, count(*) AS base, count(*) FILTER (mode = 'IW') AS iw, count(*) FILTER (mode = 'IW' AND vv) AS vv, count(*) FILTER (mode = 'IW' AND vv AND vh) AS vh, count(*) FILTER (vv AND vh) AS vh_no_iw FROM s GROUP BY 1)
SELECT *, vh = 0 AND vh_no_iw > 0 AS iw_relaxed FROM n""")
def radar_meta(spark: SparkSession, d: str) -> DataFrame:
    return fetch.radar_meta(*_radar(spark, d), _RADAR_SENSOR).select("point_index", "base", "iw", "vv", "vh", "vh_no_iw", "iw_relaxed")


@query(f"""WITH {_RADAR}, b AS (SELECT CAST(k AS INTEGER) AS k, DATE '2024-01-01' + CAST(k * 6 AS INTEGER) AS a, least(DATE '2024-01-31', DATE '2024-01-01' + CAST((k + 1) * 6 AS INTEGER)) AS z FROM range(5) t(k)),
v AS (SELECT q.* FROM q JOIN g USING (point_index, scene_id) WHERE band IN ('VV', 'VH')), m AS (SELECT point_index, band, y, x, k, median(value) AS value FROM v JOIN b ON CAST(ts AS DATE) >= a AND CAST(ts AS DATE) < z GROUP BY ALL)
SELECT c.point_index, c.band, c.y, c.x, b.k, round(m.value, 6) AS value, m.value IS NULL AS empty FROM (SELECT DISTINCT point_index, band, y, x FROM v) c CROSS JOIN b LEFT JOIN m USING (point_index, band, y, x, k)""")
def radar_binned(spark: SparkSession, d: str) -> DataFrame:
    pixels, requests = _radar(spark, d)
    day = lambda s: F.lit(s).cast("date")
    b = fetch.binned(pixels, requests, _RADAR_SENSOR, temporal.fixed_bins(day("2024-01-01"), day("2024-01-31"), 6))
    return b.select("point_index", "band", "y", "x", "k", _r("value").alias("value"), "empty")


@query(f"""WITH {_PIXELS}, c AS (SELECT * FROM e WHERE {_WINDOW} AND cloud <= 30 AND band IN ('B2', 'B3')), w AS (SELECT point_index, band, y, x, median(value) AS whole FROM c GROUP BY ALL),
b AS (SELECT CAST(k AS INTEGER) AS k, DATE '2024-01-03' + CAST((21 * k) // 4 AS INTEGER) AS a, DATE '2024-01-03' + CAST((21 * (k + 1)) // 4 AS INTEGER) AS z FROM range(4) t(k)),
m AS (SELECT point_index, band, y, x, k, median(value) AS value FROM c JOIN b ON CAST(ts AS DATE) >= a AND CAST(ts AS DATE) < z GROUP BY ALL)
SELECT w.point_index, w.band, w.y, w.x, b.k, round(greatest(least(coalesce(m.value, whole), 10000), 0), 6) AS value, CASE WHEN m.value IS NULL THEN 'window' ELSE 'own' END AS source FROM w CROSS JOIN b LEFT JOIN m USING (point_index, band, y, x, k)""")
def series_patch(spark: SparkSession, d: str) -> DataFrame:
    requests = _requests(spark, d).withColumns({c: F.to_date(c) for c in ("start", "end")})
    s = fetch.series(_pixels(spark, d), requests, Sensor(catalog.S2, ("B2", "B3")), 4)
    return s.withColumn("value", _r("value"))


_GRID = "t AS (SELECT vec_id AS id, unnest(range(len(embedding))) AS pos, unnest(embedding) AS f FROM embeddings), g AS (SELECT id, CAST(pos // 8 AS INTEGER) AS y, CAST(pos % 8 AS INTEGER) AS x, CAST(pos AS INTEGER) AS pos, CAST(f AS DOUBLE) AS value FROM t)"


def _grid(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("point_index"), F.posexplode("embedding").alias("pos", "v"))
    return v.select("point_index", F.lit("b").alias("band"), F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).alias("x"), F.col("v").cast("double").alias("value"))


@query(f"WITH {_GRID} SELECT id AS point_index, y, x, value FROM g")
def halves_joined(spark: SparkSession, d: str) -> DataFrame:
    """Halves that overlap by two columns, cut back to the whole."""
    g = _grid(spark, d)
    b = g.filter("x >= 3").withColumn("x", F.col("x") - 3)
    target = g.select("point_index").distinct().withColumn("target", F.lit(8))
    return fetch.joined_halves(g.filter("x < 5"), b, "x", target).select("point_index", "y", "x", "value")


@query("""WITH RECURSIVE c AS (SELECT c_custkey AS roi_id, CAST(-170 + (c_custkey * 37) % 330 AS DOUBLE) + 0.5 AS minlon, CAST(-60 + (c_custkey * 17) % 110 AS DOUBLE) + 0.25 AS minlat, CAST(0.01 AS DOUBLE) + (c_custkey % 50) / 400.0 AS w, CAST(0.01 AS DOUBLE) + (c_custkey % 31) / 500.0 AS h FROM customer),
b AS (SELECT roi_id, minlon, minlat, minlon + w AS maxlon, minlat + h AS maxlat, '' AS path, 0 AS depth FROM c
  UNION ALL SELECT roi_id, CASE WHEN wide AND i = 1 THEN mx ELSE minlon END, CASE WHEN NOT wide AND i = 1 THEN my ELSE minlat END, CASE WHEN wide AND i = 0 THEN mx ELSE maxlon END, CASE WHEN NOT wide AND i = 0 THEN my ELSE maxlat END, path || i, depth + 1
  FROM (SELECT *, degrees((x0 + x1) / 2 / 6378137.0) AS mx, degrees(2 * atan(exp((y0 + y1) / 2 / 6378137.0)) - pi() / 2) AS my, (x1 - x0) >= (y1 - y0) AS wide,
    ceil(abs(y1 - y0) / 100) * ceil(abs(x1 - x0) / 100) AS n FROM (SELECT *, 6378137.0 * radians(minlon) AS x0, 6378137.0 * radians(maxlon) AS x1, 6378137.0 * ln(tan(pi() / 4 + radians(minlat) / 2)) AS y0, 6378137.0 * ln(tan(pi() / 4 + radians(maxlat) / 2)) AS y1 FROM b)) CROSS JOIN (VALUES (0), (1)) t(i) WHERE n > 2000 AND depth < 12),
s AS (SELECT *, CAST(ceil(abs(6378137.0 * (ln(tan(pi() / 4 + radians(maxlat) / 2)) - ln(tan(pi() / 4 + radians(minlat) / 2)))) / 100) AS INTEGER) AS ph, CAST(ceil(abs(6378137.0 * radians(maxlon) - 6378137.0 * radians(minlon)) / 100) AS INTEGER) AS pw FROM b)
SELECT roi_id, path, round(minlon, 9) AS minlon, round(minlat, 9) AS minlat, round(maxlon, 9) AS maxlon, round(maxlat, 9) AS maxlat FROM s WHERE ph * pw <= 2000""")
def pixel_limit_parts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(k.alias("roi_id"), (-170 + (k * 37) % 330 + 0.5).alias("minlon"), (-60 + (k * 17) % 110 + 0.25).alias("minlat"), (0.01 + (k % 50) / 400.0).alias("w"), (0.01 + (k % 31) / 500.0).alias("h"))
    boxes = c.select("roi_id", "minlon", "minlat", (F.col("minlon") + F.col("w")).alias("maxlon"), (F.col("minlat") + F.col("h")).alias("maxlat"))
    return fetch.split_parts(boxes, 2000, 100.0).select("roi_id", "path", *[_r(x, 9).alias(x) for x in ("minlon", "minlat", "maxlon", "maxlat")])


# Products.

_CELLS = "t AS (SELECT vec_id AS point_index, label, unnest(range(len(embedding))) AS pos, unnest(embedding) AS f FROM embeddings), c AS (SELECT point_index, 2019 + label % 3 AS year, pos // 16 AS d, (pos // 4) % 4 AS y, pos % 4 AS x, CASE WHEN f < -0.1 THEN NULL ELSE CAST(f AS DOUBLE) END AS value FROM t)"


def _annual(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("point_index"), (2019 + F.col("label") % 3).alias("year"), F.posexplode("embedding").alias("pos", "f"))
    cells = v.select("point_index", "year", F.floor(F.col("pos") / 16).cast("int").alias("d"), (F.floor(F.col("pos") / 4) % 4).cast("int").alias("y"), (F.col("pos") % 4).alias("x"), F.when(F.col("f") < -0.1, products.NODATA).otherwise(F.col("f").cast("double")).alias("value"))
    asked = table(spark, d, "embeddings").select(F.col("vec_id").alias("point_index"), F.when(F.col("vec_id") % 11 != 0, 2019 + F.col("vec_id") % 3).alias("year"))
    return products.annual(cells, asked)


@query(f"""WITH {_CELLS}, a AS (SELECT vec_id AS point_index, CASE WHEN vec_id % 11 <> 0 THEN 2019 + vec_id % 3 END AS year FROM embeddings), n AS (SELECT point_index, avg(CAST(value IS NULL AS INTEGER)) FILTER (d = 0) AS share FROM c GROUP BY 1)
SELECT a.point_index, CAST(c.d AS INTEGER) AS d, CAST(c.y AS INTEGER) AS y, CAST(c.x AS INTEGER) AS x, c.value, round(CASE WHEN c.d IS NOT NULL THEN n.share END, 6) AS nodata_share, CASE WHEN a.year IS NULL THEN 'a year is needed' WHEN c.d IS NULL THEN 'no cells of that year' END AS error
FROM a LEFT JOIN c ON c.point_index = a.point_index AND c.year = a.year LEFT JOIN n ON n.point_index = a.point_index""")
def annual_product(spark: SparkSession, d: str) -> DataFrame:
    return _annual(spark, d).select("point_index", "d", "y", "x", "value", _r("nodata_share").alias("nodata_share"), "error")


@query(f"""WITH {_CELLS}, m AS (SELECT point_index, d, max(value) AS v FROM c WHERE point_index % 11 <> 0 AND year = 2019 + point_index % 3 GROUP BY 1, 2)
SELECT point_index, CAST(d AS INTEGER) AS d, CASE WHEN bool_and(v IS NOT NULL) OVER (PARTITION BY point_index) THEN v END AS value FROM m""")
def annual_pooled(spark: SparkSession, d: str) -> DataFrame:
    p = products.product_pooled(_annual(spark, d), "max")
    size = F.sequence(F.lit(0), F.lit(3))
    return p.select("point_index", "embedding", F.explode(size).alias("d")).select("point_index", "d", F.element_at("embedding", F.col("d") + 1).alias("value"))


_BOXES = "b AS (SELECT c_custkey AS roi_id, -10 + (c_custkey * 37) % 20 + 0.3 AS minx, 40 + (c_custkey * 17) % 10 + 0.4 AS miny, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 2020 + c_custkey % 3 END AS year FROM customer)"
_TILES = "r AS (SELECT i * 1000 + j * 10 + y AS tile_id, 2019 + y AS year, i - 20.0 AS minx, j + 30.0 AS miny FROM range(40) a(i), range(30) b(j), range(4) c(y))"


def _rois(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    b = table(spark, d, "customer").select(k.alias("roi_id"), (-10 + (k * 37) % 20 + 0.3).alias("minx"), (40 + (k * 17) % 10 + 0.4).alias("miny"), F.when(k % 5 != 0, (2020 + k % 3).cast("int")).alias("year"))
    return b.withColumn("maxx", F.col("minx") + 1.2).withColumn("maxy", F.col("miny") + 0.5)


@query(f"WITH {_BOXES}, {_TILES} SELECT roi_id, tile_id, CAST(r.year AS INTEGER) AS year FROM b JOIN r ON r.year = coalesce(b.year, 2021) AND r.minx < b.minx + 1.2 AND b.minx < r.minx + 1 AND r.miny < b.miny + 0.5 AND b.miny < r.miny + 1")
def tile_registry(spark: SparkSession, d: str) -> DataFrame:
    n = spark.range(40 * 30 * 4).select((F.floor(F.col("id") / 120)).alias("i"), (F.floor(F.col("id") / 4) % 30).alias("j"), (F.col("id") % 4).alias("y"))
    r = n.select((F.col("i") * 1000 + F.col("j") * 10 + F.col("y")).alias("tile_id"), (2019 + F.col("y")).cast("int").alias("year"), (F.col("i") - 20.0).alias("minx"), (F.col("j") + 30.0).alias("miny"), (F.col("i") - 19.0).alias("maxx"), (F.col("j") + 31.0).alias("maxy"))
    return products.tiles_for(r, _rois(spark, d)).select("roi_id", "tile_id", "year")


@query("""WITH t AS (SELECT l_suppkey AS roi_id, CASE WHEN l_suppkey % 5 = 1 AND l_linenumber = 2 THEN 'EPSG:32632' ELSE 'EPSG:32633' END AS crs, CASE WHEN l_suppkey % 5 = 2 AND l_linenumber = 1 THEN 20.0 ELSE 10.0 END AS a,
  CASE WHEN l_suppkey % 5 = 3 AND l_linenumber = 3 THEN 0.1 ELSE 0.0 END AS b, CASE WHEN l_suppkey % 5 = 4 AND l_linenumber = 4 THEN 64 ELSE 128 END AS dims FROM lineitem)
SELECT roi_id, CASE WHEN bool_or(b > 1e-12) THEN 'a tile is turned' WHEN count(DISTINCT crs) > 1 THEN 'tiles of several projections' WHEN count(DISTINCT a) > 1 THEN 'tiles of several resolutions' WHEN count(DISTINCT dims) > 1 THEN 'tiles of several dimensions' END AS error FROM t GROUP BY 1""")
def tiles_compatible(spark: SparkSession, d: str) -> DataFrame:
    s, n = F.col("l_suppkey"), F.col("l_linenumber")
    t = table(spark, d, "lineitem").select(s.alias("roi_id"), F.when((s % 5 == 1) & (n == 2), "EPSG:32632").otherwise("EPSG:32633").alias("crs"), F.when((s % 5 == 2) & (n == 1), 20.0).otherwise(10.0).alias("a"), F.when((s % 5 == 3) & (n == 3), 0.1).otherwise(0.0).alias("b"), F.lit(0.0).alias("d"), F.lit(-10.0).alias("e"), F.when((s % 5 == 4) & (n == 4), 64).otherwise(128).alias("dims"))
    return products.compatible(t)


@query(f"""WITH {_GRID}, c AS (SELECT id % 50 AS roi_id, id AS tile_order, y + CAST(id // 50 % 3 AS INTEGER) * 4 AS gy, x + CAST(id // 50 % 2 AS INTEGER) * 5 AS gx, value FROM g), m AS (SELECT roi_id, gy, gx, arg_max(value, tile_order) AS value FROM c GROUP BY ALL)
SELECT r.roi_id, CAST(a.y AS INTEGER) AS y, CAST(b.x AS INTEGER) AS x, coalesce(m.value, 0.0) AS value FROM (SELECT DISTINCT roi_id FROM c) r CROSS JOIN range(12) a(y) CROSS JOIN range(14) b(x) LEFT JOIN m ON m.roi_id = r.roi_id AND m.gy = a.y + 2 AND m.gx = b.x + 1""")
def strict_mosaic(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("point_index")
    cells = _grid(spark, d).select((i % 50).alias("roi_id"), i.alias("tile_order"), F.lit(0).alias("d"), (F.col("y") + F.floor(i / 50) % 3 * 4).cast("int").alias("gy"), (F.col("x") + F.floor(i / 50) % 2 * 5).cast("int").alias("gx"), "value")
    w = cells.select("roi_id").distinct().select("roi_id", F.lit(2).alias("row0"), F.lit(14).alias("row1"), F.lit(1).alias("col0"), F.lit(15).alias("col1"))
    return products.mosaic(cells, w).select("roi_id", "y", "x", "value")


@query(f"""WITH {_BOXES}, k AS (SELECT (i - 60) * 0.25 + 0.125 AS cell_lon, (j + 150) * 0.25 + 0.125 AS cell_lat, i * 100 + j + 0.5 AS value FROM range(100) a(i), range(60) b(j)), x AS (SELECT * FROM b WHERE coalesce(year, 2021) = 2021)
SELECT b.roi_id, k.cell_lat, k.cell_lon, k.value, CASE WHEN coalesce(b.year, 2021) <> 2021 THEN 'only 2021 is there' END AS error FROM b LEFT JOIN x USING (roi_id) LEFT JOIN k ON k.cell_lon BETWEEN x.minx AND x.minx + 1.2 AND k.cell_lat BETWEEN x.miny AND x.miny + 0.5""")
def degree_grid(spark: SparkSession, d: str) -> DataFrame:
    n = spark.range(6000).select(F.floor(F.col("id") / 60).alias("i"), (F.col("id") % 60).alias("j"))
    cells = n.select(((F.col("i") - 60) * 0.25 + 0.125).alias("cell_lon"), ((F.col("j") + 150) * 0.25 + 0.125).alias("cell_lat"), F.lit(0).alias("d"), (F.col("i") * 100 + F.col("j") + 0.5).alias("value"))
    r = _rois(spark, d)
    boxes = r.select("roi_id", F.col("minx").alias("minlon"), F.col("miny").alias("minlat"), F.col("maxx").alias("maxlon"), F.col("maxy").alias("maxlat"), "year")
    return products.degree_grid(cells, boxes).select("roi_id", "cell_lat", "cell_lon", "value", "error")


_RANGES = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(products.EMISSIVE))


@query(f"""WITH {_GRID}, r AS (SELECT id, y, x, least(greatest(value * 20000 / 10000, 0), 1) AS v, 280 + value * 40 AS k FROM g), e AS (SELECT * FROM (VALUES {_RANGES}) t(i, lo, hi)),
c AS (SELECT id, y, x, CAST(p - 1 AS INTEGER) AS channel, CASE WHEN nm[1] = 'r' THEN v ELSE least(greatest((k - e.lo) / (e.hi - e.lo), 0), 1) END AS value FROM r CROSS JOIN (SELECT unnest({list(products.PROXY)}) AS nm, unnest(range(1, 15)) AS p) n LEFT JOIN e ON nm[1] = 't' AND e.i = CAST(nm[2:] AS INTEGER))
SELECT id AS point_index, y, x, channel, round(value, 9) AS value FROM c""")
def proxy_channels(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d).drop("band")
    r = g.select("point_index", "y", "x", (F.col("value") * 20000).alias("value"), F.explode(F.array(*map(F.lit, products.REFLECTIVE))).alias("band"))
    t = g.select("point_index", "y", "x", ((280 + F.col("value") * 40)).alias("value"))
    return products.proxy_channels(r, t).select("point_index", "y", "x", F.posexplode("channels").alias("channel", "value")).withColumn("value", _r("value", 9))


# Scaling, a row per pixel.

_DN = "p AS (SELECT l_orderkey AS point_index, l_linenumber AS n, {bands}[(l_linenumber + l_partkey) % {k} + 1] AS band, l_extendedprice / 8 - 300 AS value FROM lineitem)"


def _numbers(spark: SparkSession, d: str, bands: tuple[str, ...]) -> DataFrame:
    which = ((F.col("l_linenumber") + F.col("l_partkey")) % len(bands) + 1).cast("int")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("point_index"), F.col("l_linenumber").alias("n"), F.element_at(F.array(*map(F.lit, bands)), which).alias("band"), (F.col("l_extendedprice") / 8 - 300).alias("value"))


def _scaling(name: str, how: str, x: str) -> None:
    bands, mean, std = radiometry.BAND_STATS[how]
    values = ", ".join(f"('{b}', {m}, {s})" for b, m, s in zip(bands, mean, std))

    def run(spark: SparkSession, d: str) -> DataFrame:
        z = radiometry.normalised(_numbers(spark, d, bands), how, spark)
        return z.select("point_index", "n", "band", _r("z").alias("z"))

    query(f"WITH {_DN.format(bands=list(bands), k=len(bands))} SELECT point_index, n, p.band, round(({x} - mean) / std, 6) AS z FROM p JOIN (VALUES {values}) t(band, mean, std) ON p.band = t.band", name)(run)


_CLIPPED = "greatest(least(value, 10000), 0)"
_scaling("normalise_agri", "s2_ten_agri", _CLIPPED)
_scaling("normalise_nine", "s2_nine_255", f"{_CLIPPED} / 10000 * 255")
_scaling("normalise_twelve_v1", "s2_twelve_v1", _CLIPPED)
_scaling("normalise_twelve_v01", "s2_twelve_v01", _CLIPPED)
_scaling("normalise_ten_unit", "s2_ten_unit", f"{_CLIPPED} / 10000")
_scaling("normalise_imagenet", "imagenet", f"floor({_CLIPPED} / 10000 * 255) / 255")
_scaling("normalise_fmow", "fmow", f"floor({_CLIPPED} / 10000 * 255) / 255")


@query(f"""WITH {_DN.format(bands=list(catalog.RGB), k=3)}, w AS (SELECT *, min(value) OVER (PARTITION BY point_index) AS lo, max(value) OVER (PARTITION BY point_index) AS hi FROM p)
SELECT point_index, n, band, CASE WHEN hi > lo THEN floor((value - lo) / (hi - lo) * 255) ELSE 0.0 END AS z FROM w""")
def normalise_rgb8_minmax(spark: SparkSession, d: str) -> DataFrame:
    return radiometry.normalised(_numbers(spark, d, catalog.RGB), "rgb8_minmax", spark).select("point_index", "n", "band", "z")


@query(f"""WITH w AS (SELECT * FROM (VALUES {', '.join(f"('{b}', {v})" for b, v in radiometry.WAVELENGTHS.items())}) t(band, um)), p AS (SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN ['B2', 'nir', 'B8'] WHEN p_size % 4 = 1 THEN ['B8A', 'B12'] ELSE ['B1', 'B9', 'B11'] END AS bands FROM part),
u AS (SELECT id, unnest(bands) AS band, unnest(range(len(bands))) AS i FROM p), j AS (SELECT id, CAST(i AS INTEGER) AS i, um, bool_and(um IS NOT NULL) OVER (PARTITION BY id) AS ok FROM u LEFT JOIN w USING (band)) SELECT id, i, CAST(um AS DOUBLE) AS um FROM j WHERE ok""")
def band_wavelengths(spark: SparkSession, d: str) -> DataFrame:
    a = lambda *b: F.array(*map(F.lit, b))
    bands = F.when(F.col("p_size") % 4 == 0, a("B2", "nir", "B8")).when(F.col("p_size") % 4 == 1, a("B8A", "B12")).otherwise(a("B1", "B9", "B11"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.posexplode(radiometry.wavelengths(bands)).alias("i", "um"))


_CHANNELS = ", ".join(f"({i}, CAST({m} AS DOUBLE), CAST({d} AS DOUBLE))" for i, (m, d) in enumerate(zip(*radiometry.CHANNEL_STATS[16])))


@query(f"WITH {_GRID} SELECT id, CAST(pos // 16 AS INTEGER) AS part, CAST(pos % 16 AS INTEGER) AS channel, round((value * 1000 - mean) / std, 7) AS z FROM g JOIN (VALUES {_CHANNELS}) t(i, mean, std) ON i = pos % 16")
def normalise_channels(spark: SparkSession, d: str) -> DataFrame:
    """A vector as four groups of 16 channels."""
    e = F.transform("embedding", lambda v: v.cast("double") * 1000)
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode(F.array(*[F.slice(e, 1 + 16 * k, 16) for k in range(4)])).alias("part", "v"))
    return rows.select("id", "part", F.posexplode(radiometry.zscore_channels(F.col("v"), 16)).alias("channel", "z")).withColumn("z", _r("z", 7))


# Tiled inference: images of 8 x 8 pixels, tiles of 5 that overlap by 2.


def _images(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("point_index"), F.lit(1).alias("c"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.col("embedding").alias("pixels"))


_PREP = inference.InputPrep(tile_size=5, snap=0.0)


def _cells(made: DataFrame) -> DataFrame:
    rows = made.select("point_index", F.col("shape")[2].alias("w"), F.posexplode("embedding").alias("k", "value"))
    return rows.select("point_index", F.floor(F.col("k") / F.col("w")).cast("int").alias("y"), (F.col("k") % F.col("w")).cast("int").alias("x"), "value")


@query(f"""WITH {_GRID}, u AS (SELECT g.id, i, j, avg(value) AS v FROM g CROSS JOIN (VALUES (0), (3)) a(i) CROSS JOIN (VALUES (0), (3)) b(j) WHERE y >= i AND y < i + 5 AND x >= j AND x < j + 5 GROUP BY ALL)
SELECT id AS point_index, round(avg(v), 5) AS value FROM u GROUP BY 1""")
def tiled_pooled(spark: SparkSession, d: str) -> DataFrame:
    made = inference.embed(_images(spark, d), ["band_mean"], prep=_PREP)
    return made.select("point_index", _r(F.element_at("embedding", 1), 5).alias("value"))


@query(f"WITH {_GRID} SELECT id AS point_index, y, x, value FROM g")
def tiled_grid(spark: SparkSession, d: str) -> DataFrame:
    return _cells(inference.embed(_images(spark, d), ["cells"], inference.Output("grid"), _PREP))


@query(f"WITH {_GRID} SELECT id AS point_index, max(value) AS value FROM g GROUP BY 1")
def output_max(spark: SparkSession, d: str) -> DataFrame:
    made = inference.embed(_images(spark, d), ["cells"], inference.Output("pooled", "max"), _PREP)
    return made.select("point_index", F.element_at("embedding", 1).alias("value"))


@query(f"WITH {_GRID} SELECT id AS point_index, y, x, value FROM g")
def output_grid(spark: SparkSession, d: str) -> DataFrame:
    """A model whose rows run from the south, turned north up."""
    return _cells(inference.embed(_images(spark, d), ["cells_south"], inference.Output("grid"), "resize"))


@query(f"WITH {_GRID} SELECT id AS point_index, CAST(7 - y AS INTEGER) AS y, x, value FROM g")
def output_native(spark: SparkSession, d: str) -> DataFrame:
    return _cells(inference.embed(_images(spark, d), ["cells_south"], inference.Output("grid", orientation="native"), "resize"))


@query(f"WITH {_GRID} SELECT id AS point_index, round(avg(value), 5) AS value FROM g WHERE y >= 2 AND y < 6 AND x >= 1 AND x < 8 GROUP BY 1")
def output_window(spark: SparkSession, d: str) -> DataFrame:
    """The region asked for is smaller than the square that was fetched."""
    images = _images(spark, d).select("*", *[F.lit(v).alias(c) for c, v in (("y0", 0.25), ("y1", 0.75), ("x0", 0.2), ("x1", 1.0))])
    made = inference.embed(images, ["cells"], prep="resize")
    return made.select("point_index", _r(F.element_at("embedding", 1), 5).alias("value"))


# Exports: an order is a point, its priority the model.

_RESULTS = """r AS (SELECT o_custkey AS point_index, o_orderpriority AS model, CASE WHEN max(o_orderstatus) = 'P' THEN 'failed' ELSE 'ok' END AS status, CASE WHEN max(o_orderstatus) = 'P' THEN 'permission denied' END AS error, CAST(2 + (o_custkey % 40 = 0 AND o_orderpriority LIKE '1%')::INTEGER AS INTEGER) AS n FROM orders GROUP BY 1, 2)"""


def _results(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("point_index"), F.col("o_orderpriority").alias("model")).agg((F.max("o_orderstatus") == "P").alias("bad"))
    n = F.when((F.col("point_index") % 40 == 0) & F.col("model").startswith("1"), 3).otherwise(2)
    return r.select("point_index", "model", F.when(F.col("bad"), "failed").otherwise("ok").alias("status"), F.when(F.col("bad"), "permission denied").alias("error"), F.when(~F.col("bad"), F.array_repeat(F.col("point_index").cast("double"), n)).alias("embedding"))


@query(f"""WITH {_RESULTS}, a AS (SELECT model, max(point_index) + 1 AS n_items, count(*) AS n, count(*) FILTER (status = 'failed') AS n_failed, min(n) FILTER (status = 'ok') AS lo, max(n) FILTER (status = 'ok') AS hi, sum(point_index) FILTER (status = 'failed') AS fs FROM r GROUP BY 1)
SELECT model, n_items, CASE WHEN n_failed = 0 AND lo = hi AND n = n_items THEN 'stacked' ELSE 'ragged' END AS layout, CASE WHEN lo = hi THEN lo END AS dim, n - n_failed AS n_there, n_failed, CAST(coalesce(fs, 0) AS BIGINT) AS failed_sum,
CASE WHEN n_failed = 0 THEN 'ok' WHEN n_failed < n THEN 'partial' ELSE 'failed' END AS status FROM a""")
def export_packed(spark: SparkSession, d: str) -> DataFrame:
    p = manifests.packed(_results(spark, d))
    total = F.aggregate("failed_indices", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return p.select("model", "n_items", "layout", "dim", F.size("indices").cast("bigint").alias("n_there"), F.size("failed_indices").cast("bigint").alias("n_failed"), total.alias("failed_sum"), "status")


@query(f"""WITH {_RESULTS}, p AS (SELECT point_index, count(*) AS n, count(*) FILTER (status = 'failed') AS f, string_agg(model || ':' || status, ',' ORDER BY model) AS models FROM r GROUP BY 1)
SELECT point_index, models, CASE WHEN f = 0 THEN 'ok' WHEN f < n THEN 'partial' ELSE 'failed' END AS status FROM p""")
def export_manifest(spark: SparkSession, d: str) -> DataFrame:
    p = manifests.by_point(_results(spark, d))
    return p.select("point_index", F.array_join(F.transform("models", lambda m: F.concat(m["model"], F.lit(":"), m["status"])), ",").alias("models"), "status")


@query(f"WITH {_RESULTS} SELECT point_index, model, 'infer' AS stage, error, 'access' AS error_kind FROM r WHERE status = 'failed'")
def export_failures(spark: SparkSession, d: str) -> DataFrame:
    return manifests.failures(_results(spark, d), "infer")


@query(f"""WITH {_RESULTS}, s AS (SELECT model, max(point_index) AS m FROM r GROUP BY 1), e AS (SELECT model, unnest(range(m + 1)) AS point_index FROM s)
SELECT e.model, e.point_index, r.status, r.error, CASE WHEN r.status = 'ok' THEN r.n END AS dim FROM e LEFT JOIN r USING (model, point_index)""")
def load_combined(spark: SparkSession, d: str) -> DataFrame:
    a = export.aligned(_results(spark, d), ["model"])
    return a.select("model", "point_index", "status", "error", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dim"))


@query("""WITH a AS (SELECT l_suppkey AS m, l_linenumber AS no, max(l_quantity) AS v, max(CASE WHEN l_suppkey % 9 = 0 AND l_linenumber = 3 THEN 2 ELSE 1 END) AS n FROM lineitem GROUP BY 1, 2), e AS (SELECT m, bool_and(n = 1) AS even FROM a GROUP BY 1)
SELECT e.m AS model, CAST(i AS BIGINT) AS point_index, CASE WHEN even THEN a.v END AS value FROM e CROSS JOIN range(16) t(i) LEFT JOIN a ON a.m = e.m AND t.i = CASE WHEN e.m % 2 = 0 THEN a.no * 2 + 1 ELSE a.no END""")
def load_ragged(spark: SparkSession, d: str) -> DataFrame:
    """Arrays stored one by one; half of the models say by ``indices`` which point an array is of."""
    s, n = F.col("l_suppkey"), F.col("l_linenumber")
    a = table(spark, d, "lineitem").groupBy(s, n).agg(F.max("l_quantity").alias("v"))
    size = F.when((s % 9 == 0) & (n == 3), 2).otherwise(1)
    arrays = a.select(F.format_string("embeddings__m%d__%05d", s, n).alias("key"), F.array_repeat("v", size).alias("value"))
    at = F.when(s % 2 == 0, F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: i * 2 + 1)).otherwise(F.array().cast("array<int>"))
    entries = a.select(s.alias("model"), F.format_string("embeddings__m%d", s).alias("base"), F.lit(16).alias("n_items"), at.alias("indices")).distinct()
    return manifests.ragged_rows(arrays, entries).select("model", F.col("point_index").cast("bigint").alias("point_index"), F.element_at("embedding", 1).alias("value"))


@query("""WITH f AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'notes.txt' ELSE 'p' || lpad(CAST(o_orderkey AS VARCHAR), 5, '0') || '.npz' END AS name, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey + 1000000 END AS m FROM orders)
SELECT name, CAST(coalesce(m, TRY_CAST(nullif(regexp_extract(name, '^p(\\d+)', 1), '') AS BIGINT)) AS INTEGER) AS point_index FROM f WHERE m IS NOT NULL OR name LIKE 'p%'""")
def load_per_item(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    f = table(spark, d, "orders").select(F.when(k % 7 == 0, "notes.txt").otherwise(F.format_string("p%05d.npz", k)).alias("name"), F.when(k % 5 == 0, k + 1_000_000).alias("manifest_index"))
    return manifests.per_item(f).select("name", "point_index")


@query("SELECT 'embeddings__s' || l_suppkey || '__' || lpad(CAST(l_linenumber AS VARCHAR), 5, '0') AS key, count(*) AS n FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY 1")
def drop_stale(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    arrays = li.groupBy(F.format_string("embeddings__s%d__%05d", "l_suppkey", "l_linenumber").alias("key")).agg(F.count("*").alias("n"))
    removed = li.filter("l_suppkey % 3 = 0").select(F.format_string("embeddings__s%d", "l_suppkey").alias("base")).distinct()
    return manifests.without(arrays, removed)


@query("""WITH s AS (SELECT o_custkey AS model, CASE WHEN max(o_orderstatus) = 'P' THEN 'failed' ELSE 'ok' END AS status, count(*) AS n, count(*) FILTER (o_orderkey % 9 <> 0) AS have FROM orders GROUP BY 1) SELECT model FROM s WHERE status = 'ok' AND n = have""")
def resume_complete(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    key = F.concat(F.lit("k"), F.col("o_orderkey"))
    stored = o.groupBy(F.col("o_custkey").alias("model")).agg(F.when(F.max("o_orderstatus") == "P", "failed").otherwise("ok").alias("status"), F.collect_list(key).alias("keys"))
    return manifests.complete(stored, o.filter("o_orderkey % 9 <> 0").select(key.alias("key")))


@query("""SELECT o_orderkey AS id, sha1(o_orderpriority || chr(31) || o_custkey || chr(31) || CASE WHEN o_orderkey % 2 = 0 THEN 'tile' ELSE chr(0) END) AS fingerprint FROM orders""")
def resume_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    prep = F.when(F.col("o_orderkey") % 2 == 0, "tile")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), strings.fingerprint(F.col("o_orderpriority"), F.col("o_custkey"), prep).alias("fingerprint"))


# Dates, places and the catalog.


@query("""WITH o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, o_orderkey % 3 AS m FROM orders)
SELECT id, CAST(year(d) AS INTEGER) AS year, CAST(dayofyear(d) AS INTEGER) AS doy, CAST(CASE m WHEN 0 THEN 2000 + id % 20 WHEN 1 THEN year(d) ELSE 2021 END AS INTEGER) AS product_year, strftime(d, '%Y-%m-%dT00:00:00.000000+00:00Z') AS stamp,
CASE WHEN greatest(d, DATE '1995-01-01') < least(d + 90, DATE '1996-01-01') THEN CAST(greatest(d, DATE '1995-01-01') AS VARCHAR) END AS overlap_start, CASE WHEN greatest(d, DATE '1995-01-01') < least(d + 90, DATE '1996-01-01') THEN CAST(least(d + 90, DATE '1996-01-01') AS VARCHAR) END AS overlap_end FROM o""")
def date_parts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("d"))
    mode = F.when(F.col("id") % 3 == 0, "year").when(F.col("id") % 3 == 1, "range")
    p = temporal.year_doy(F.col("d"))
    w = temporal.window_overlap(F.col("d"), F.date_add("d", 90), F.lit("1995-01-01").cast("date"), F.lit("1996-01-01").cast("date"))
    return o.select("id", p["year"].alias("year"), p["doy"].alias("doy"), temporal.start_year(mode, 2000 + F.col("id") % 20, F.col("d")).cast("int").alias("product_year"), temporal.utc_text(F.col("d").cast("timestamp")).alias("stamp"), w["start"].cast("string").alias("overlap_start"), w["end"].cast("string").alias("overlap_end"))


@query("""WITH w AS (SELECT c_custkey AS id, 1 + (c_custkey * 7) % 900 AS days FROM customer), b AS (SELECT id, days, least(12, CAST(ceil(days / 30.0) AS INTEGER)) AS n, days - 360 >= 30 AS stretched FROM w)
SELECT id, CASE WHEN n > 1 THEN 'auto' ELSE 'single' END AS mode, CAST(n AS INTEGER) AS n_bins, CASE WHEN stretched THEN round(days / n, 3) END AS effective_stride_days FROM b""")
def frame_plan(spark: SparkSession, d: str) -> DataFrame:
    start = F.lit("2022-01-01").cast("date")
    w = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), start.alias("start"), F.date_add(start, (1 + (F.col("c_custkey") * 7) % 900).cast("int")).alias("end"))
    return fetch.frame_plan(w).select("id", "mode", F.size("bins").alias("n_bins"), "effective_stride_days")


@query("""WITH l AS (SELECT l_suppkey AS roi, CAST(l_linenumber AS INTEGER) AS k, bool_and(l_quantity < 25) AS empty FROM lineitem GROUP BY 1, 2), d AS (SELECT roi, count(*) FILTER (empty) AS n FROM l GROUP BY 1)
SELECT roi, k, CAST(k - (SELECT count(*) FROM l x WHERE x.roi = l.roi AND x.empty AND x.k < l.k) AS INTEGER) AS t, CAST(n AS INTEGER) AS n_dropped FROM l JOIN d USING (roi) WHERE NOT empty""")
def frames_dropped(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("roi"), F.col("l_linenumber").cast("int").alias("k")).agg(F.min((F.col("l_quantity") < 25).cast("int")).cast("boolean").alias("empty"))
    return fetch.without_empty(f, ["roi"]).select("roi", "k", "t", F.size("dropped").alias("n_dropped"))


@query("""WITH c AS (SELECT c_custkey AS id, CAST(-179 + (c_custkey * 37) % 358 AS DOUBLE) + 0.25 AS lon, CAST(-70 + (c_custkey * 13) % 140 AS DOUBLE) + 0.5 AS lat FROM customer), z AS (SELECT *, CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + CAST(floor((lon + 180) / 6) AS INTEGER) + 1 AS epsg FROM c),
p AS (SELECT *, radians(lat) AS phi, radians(lon - ((epsg % 100) * 6 - 183)) AS lam, CAST(0.0016792203863837047 AS DOUBLE) AS n, CAST(2 * sqrt(0.0016792203863837047) / 1.0016792203863837 AS DOUBLE) AS c2 FROM z),
t AS (SELECT *, sinh(atanh(sin(phi)) - c2 * atanh(c2 * sin(phi))) AS t FROM p), x AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta, n / 2 - 2 * n * n / 3 + 5 * n * n * n / 16 AS a1, 13 * n * n / 48 - 3 * n * n * n / 5 AS a2, 61 * n * n * n / 240 AS a3, 0.9996 * 6378137.0 / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64) AS s FROM t)
SELECT id, CAST(epsg AS INTEGER) AS epsg, round(500000 + s * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)), 3) AS x,
round(CASE WHEN epsg >= 32700 THEN 10000000 ELSE 0 END + s * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)), 3) AS y FROM x""")
def utm_project(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(k.alias("id"), (-179 + (k * 37) % 358 + 0.25).alias("lon"), (-70 + (k * 13) % 140 + 0.5).alias("lat"))
    z = c.withColumn("epsg", spatial.utm_zone(F.col("lon"), F.col("lat")))
    p = spatial.utm(F.col("lon"), F.col("lat"), F.col("epsg"))
    return z.select("id", "epsg", _r(p["x"], 3).alias("x"), _r(p["y"], 3).alias("y"))


@query("WITH p AS (SELECT l_suppkey AS point_index, l_returnflag AS band, l_orderkey AS y, l_linenumber AS x, l_extendedprice AS value FROM lineitem), n AS (SELECT point_index, greatest(ceil(sqrt(count(*) / 50.0)), 1) AS s FROM p GROUP BY 1) SELECT point_index, band, count(*) AS n, round(avg(value), 6) AS mean FROM p JOIN n USING (point_index) WHERE y % s = 0 AND x % s = 0 GROUP BY 1, 2")
def stats_sampled(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("point_index"), F.col("l_returnflag").alias("band"), F.col("l_orderkey").alias("y"), F.col("l_linenumber").alias("x"), F.col("l_extendedprice").alias("value"))
    s = inspection.statistics(inspection.sampled(p, ["point_index"], 50), ["point_index", "band"])
    return s.select("point_index", "band", "n", _r("mean", 6).alias("mean"))


_CATALOG = ", ".join(f"('{n}', '{of}', '{e.sensor.collection}', {len(e.sensor.bands)}, {e.image_size or 'NULL'}, '{e.normalisation}', '{e.pool_kind}', {str(e.max_honoured).upper()})" for n, of, e in [(m.name, "", m) for m in catalog.MODELS.values()] + [(a, m, catalog.MODELS[m]) for a, m in catalog.ALIASES.items()])


@query(f"SELECT model, nullif(alias_of, '') AS alias_of, collection, CAST(n_bands AS INTEGER) AS n_bands, CAST(image_size AS INTEGER) AS image_size, normalisation, pool_kind, max_honoured FROM (VALUES {_CATALOG}) t(model, alias_of, collection, n_bands, image_size, normalisation, pool_kind, max_honoured)")
def model_catalog_listing(spark: SparkSession, d: str) -> DataFrame:
    return catalog.list_models(spark, True).select("model", "alias_of", "collection", "n_bands", "image_size", "normalisation", "pool_kind", "max_honoured")


# Names, overrides and small shapes.


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN p_size ELSE 10 END AS scale_m, CASE WHEN p_size % 2 = 0 THEN p_size + 5 ELSE 30 END AS cloudy_pct, CASE WHEN p_size % 5 = 0 THEN 'mosaic' ELSE 'median' END AS composite FROM part""")
def fetch_overrides(spark: SparkSession, d: str) -> DataFrame:
    from rasterloom.operators import catalog as small

    s = F.col("p_size")
    over = F.struct(F.when(s % 3 == 0, s).alias("scale_m"), F.when(s % 2 == 0, s + 5).alias("cloudy_pct"), F.lit(None).cast("double").alias("fill_value"), F.when(s % 5 == 0, "mosaic").alias("composite"))
    base = F.struct(F.lit(10).alias("scale_m"), F.lit(30).alias("cloudy_pct"), F.lit(0.0).alias("fill_value"), F.lit("median").alias("composite"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), over.alias("o"), base.alias("b"))
    return rows.select("id", small.overridden("o", "b").alias("r")).select("id", "r.scale_m", "r.cloudy_pct", "r.composite")


@query("""WITH m AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'failed' ELSE 'open' END AS status, CASE WHEN o_orderkey % 7 = 0 THEN 'old' END AS error FROM orders), r AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'ok' END AS status, CASE WHEN o_orderstatus = 'P' THEN 'new' END AS error FROM orders WHERE o_orderkey % 3 <> 0)
SELECT m.id, CASE WHEN m.status = 'failed' THEN m.status ELSE coalesce(r.status, m.status) END AS status, CASE WHEN m.status = 'failed' THEN m.error ELSE coalesce(r.error, m.error) END AS error FROM m LEFT JOIN r USING (id)""")
def result_injection(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    old = F.col("o_orderkey") % 7 == 0
    m = o.select(F.col("o_orderkey").alias("id"), F.when(old, "failed").otherwise("open").alias("status"), F.when(old, "old").alias("error"))
    bad = F.col("o_orderstatus") == "P"
    r = o.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), F.when(bad, "failed").otherwise("ok").alias("status"), F.when(bad, "new").alias("error"))
    return export.injected(m, r, ["id"])


@query("""WITH n AS (SELECT p_name AS name, CASE WHEN trim(regexp_replace(regexp_replace(p_type, '[^0-9a-zA-Z_]+', '_', 'g'), '_+', '_', 'g'), '_') = '' THEN 'item' ELSE trim(regexp_replace(regexp_replace(p_type, '[^0-9a-zA-Z_]+', '_', 'g'), '_+', '_', 'g'), '_') END AS key FROM part)
SELECT key, count(*) AS n FROM n GROUP BY 1 HAVING count(*) > 1""")
def duplicate_names(spark: SparkSession, d: str) -> DataFrame:
    from rasterloom.operators import catalog as small

    return small.duplicates(table(spark, d, "part"), "p_type").select("key", "n")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'year' ELSE 'range' END AS mode, strftime(o_orderdate, '%Y-%m-%d') AS start, strftime(CAST(o_orderdate AS DATE) + 30, '%Y-%m-%d') AS "end", CAST(CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate) END AS INTEGER) AS year FROM orders""")
def temporal_meta(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("s"))
    m = temporal.temporal_meta(F.when(F.col("id") % 2 == 0, "year").otherwise("range"), F.col("s"), F.date_add("s", 30))
    return o.select("id", m.alias("m")).select("id", "m.mode", "m.start", "m.end", "m.year")


@query("""WITH p AS (SELECT p_partkey AS id, p_size * 7 + 1 AS h, p_size * 5 + 3 AS w, p_partkey % 400 AS side FROM part) SELECT id, round(10.0 * least(h, w) / 224, 6) AS gsd, CAST(greatest(CASE WHEN side - side // 48 * 48 > 48 - (side - side // 48 * 48) THEN side // 48 * 48 + 48 ELSE side // 48 * 48 END, 48) AS INTEGER) AS snapped FROM p""")
def model_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Effective resolution of an image, and its side snapped to what resolutions of 10, 20 and 60 m and patches of 8 allow."""
    from rasterloom.functions import tiles

    h, w = F.col("p_size") * 7 + 1, F.col("p_size") * 5 + 3
    unit = tiles.side_unit(10, 8, [10, 20, 60])
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), _r(spatial.effective_resolution(h, w, 10.0, 224)).alias("gsd"), tiles.snapped_side(F.col("p_partkey") % 400, unit).alias("snapped"))


@query("""SELECT p_partkey AS id, CASE WHEN trim(regexp_replace(p_type, '[^0-9a-zA-Z]', '_', 'g'), '_') = '' THEN 'var' ELSE trim(regexp_replace(p_type, '[^0-9a-zA-Z]', '_', 'g'), '_') END AS suffix,
CASE WHEN p_size % 3 = 0 THEN 'abc' || p_size ELSE 'abc' || p_size || '--multi_' || p_size END AS input_key, CASE WHEN p_size % 4 = 0 THEN 'B4,B8' ELSE '' END AS missing FROM part""")
def input_names(spark: SparkSession, d: str) -> DataFrame:
    from rasterloom.operators import catalog as small

    s = F.col("p_size")
    key = strings.input_key(F.concat(F.lit("abc"), s), F.when(s % 3 == 0, "single").otherwise(F.concat(F.lit("multi:"), s)))
    have = F.when(s % 4 == 0, F.array(F.lit("B2"))).otherwise(F.array(*map(F.lit, ("B8", "B4", "B2"))))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), strings.dim_suffix(F.col("p_type")).alias("suffix"), key.alias("input_key"), F.array_join(small.missing_bands(F.array(*map(F.lit, ("B4", "B8", "B2"))), have), ",").alias("missing"))


@query("SELECT l_orderkey AS id, l_linenumber AS n, CAST(floor(greatest(least((l_extendedprice / 10 - (3000 - 2 * 900)) / (4 * 900) * 255, 255), 0)) AS INTEGER) AS v FROM lineitem")
def sigma_bytes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), radiometry.sigma8(F.col("l_extendedprice") / 10, F.lit(3000.0), F.lit(900.0)).alias("v"))


def _shaped(spark: SparkSession, d: str, make: Callable) -> DataFrame:
    """``make`` applied to the 8 x 8 images, as ``point_index, y, x, value``."""
    import numpy as np
    import pandas as pd

    def run(batches):
        for b in batches:
            out = [make(np.asarray(p, np.float64).reshape(1, 8, 8)) for p in b["pixels"]]
            yield pd.DataFrame({"point_index": b["point_index"], "w": [o.shape[2] for o in out], "v": [o.ravel() for o in out]})

    rows = _images(spark, d).select("point_index", "pixels").mapInPandas(run, "point_index bigint, w int, v array<double>")
    rows = rows.select("point_index", "w", F.posexplode("v").alias("k", "value"))
    return rows.select("point_index", F.floor(F.col("k") / F.col("w")).cast("int").alias("y"), (F.col("k") % F.col("w")).cast("int").alias("x"), _r("value", 5).alias("value"))


@query(f"WITH {_GRID} SELECT id AS point_index, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, round(avg(value), 5) AS value FROM g GROUP BY ALL")
def resize_bilinear(spark: SparkSession, d: str) -> DataFrame:
    """Half the size: every pixel is the mean of four."""
    from rasterloom.plans import models

    return _shaped(spark, d, lambda x: models.bilinear(x, 4, 4))


@query(f"WITH {_GRID}, p AS (SELECT DISTINCT id FROM g) SELECT p.id AS point_index, CAST(a.y AS INTEGER) AS y, CAST(b.x AS INTEGER) AS x, round(coalesce(g.value, 0), 5) AS value FROM p CROSS JOIN range(10) a(y) CROSS JOIN range(10) b(x) LEFT JOIN g ON g.id = p.id AND g.y = a.y AND g.x = b.x")
def pad_multiple(spark: SparkSession, d: str) -> DataFrame:
    from rasterloom.plans import models

    return _shaped(spark, d, lambda x: models.padded(x, 5))


@query(f"WITH {_GRID}, p AS (SELECT DISTINCT id FROM g) SELECT p.id AS point_index, CAST(a.y AS INTEGER) AS y, CAST(b.x AS INTEGER) AS x, round(g.value, 5) AS value FROM p CROSS JOIN range(8) a(y) CROSS JOIN range(8) b(x) JOIN g ON g.id = p.id AND g.y = a.y AND g.x = CASE WHEN b.x = 0 THEN 4 WHEN b.x = 1 THEN 3 WHEN b.x = 6 THEN 4 WHEN b.x = 7 THEN 3 ELSE b.x END")
def square_reflected(spark: SparkSession, d: str) -> DataFrame:
    """Columns 2 to 5 of an image, mirrored to a square."""
    from rasterloom.plans import shapes

    return _shaped(spark, d, lambda x: shapes.squared(x[:, :, 2:6], 8, "pad")[0])


@query(f"WITH {_GRID} SELECT g.id AS point_index, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, CAST(y - 3 * r AS INTEGER) AS y, CAST(x - 3 * c AS INTEGER) AS x, round(value, 5) AS value FROM g CROSS JOIN (VALUES (0), (1)) a(r) CROSS JOIN (VALUES (0), (1)) b(c) WHERE y >= 3 * r AND y < 3 * r + 5 AND x >= 3 * c AND x < 3 * c + 5")
def tile_slices(spark: SparkSession, d: str) -> DataFrame:
    t = inference.cut(_images(spark, d), 5, inference.Output("grid"), _PREP)
    rows = t.select("point_index", "row", "col", "w", F.posexplode("pixels").alias("k", "value"))
    return rows.select("point_index", "row", "col", F.floor(F.col("k") / F.col("w")).cast("int").alias("y"), (F.col("k") % F.col("w")).cast("int").alias("x"), _r(F.col("value").cast("double"), 5).alias("value"))


@query("""WITH s AS (SELECT event_id, user_id % 40 AS point_index, event_id % 97 / 96.0::DOUBLE * 0.02 AS dx, event_id % 89 / 88.0::DOUBLE * 0.01 AS dy, value FROM events),
q AS (SELECT DISTINCT point_index, 10.0::DOUBLE + point_index AS lon, -20.0::DOUBLE + point_index AS lat FROM s),
m AS (SELECT s.point_index, CAST(floor((6378137.0 * radians(lon + dx) - 6378137.0 * radians(lon)) / 200) AS INTEGER) AS x, CAST(floor((6378137.0 * ln(tan(pi() / 4 + radians(lat + 0.01) / 2)) - 6378137.0 * ln(tan(pi() / 4 + radians(lat + dy) / 2))) / 200) AS INTEGER) AS y, value,
  ceil((6378137.0 * radians(lon + 0.02) - 6378137.0 * radians(lon)) / 200) AS w, ceil((6378137.0 * ln(tan(pi() / 4 + radians(lat + 0.01) / 2)) - 6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2))) / 200) AS h FROM s JOIN q USING (point_index))
SELECT point_index, y, x, round(avg(value), 6) AS value FROM m WHERE x >= 0 AND y >= 0 AND x < w AND y < h GROUP BY ALL""")
def rectangle_sample(spark: SparkSession, d: str) -> DataFrame:
    """Samples by place, brought to the pixels of each region's rectangle, north up."""
    i, p = F.col("event_id"), F.col("user_id") % 40
    lon, lat = 10.0 + p, -20.0 + p
    s = table(spark, d, "events").select(p.alias("point_index"), (lon + i % 97 / F.lit(96.0) * 0.02).alias("lon"), (lat + i % 89 / F.lit(88.0) * 0.01).alias("lat"), F.lit("b").alias("band"), "value")
    q = table(spark, d, "events").select(p.alias("point_index")).distinct()
    q = q.select("point_index", (10.0 + F.col("point_index")).alias("minlon"), (-20.0 + F.col("point_index")).alias("minlat"), (10.02 + F.col("point_index")).alias("maxlon"), (-19.99 + F.col("point_index")).alias("maxlat"))
    return fetch.gridded(s, q, 200.0).select("point_index", "y", "x", _r("value").alias("value"))
