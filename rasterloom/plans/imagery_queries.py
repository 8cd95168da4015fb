"""The engine's own operators as queries over the star-schema tables, with their SQL.

``events`` stands for scenes (``ts`` acquisition, ``user_id`` region, ``event_type`` band, ``props.k`` cloud share),
``embeddings`` for 8 x 8 feature grids, ``lineitem`` and ``orders`` for series, keys give coordinates and image sizes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.common import scratch, table
from rasterloom.functions import radiometry, spatial, strings, temporal, tiles
from rasterloom.operators import analytics, catalog, export, guards, inspection, pooling, scan
from rasterloom.plans import models

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _r(c: Column | str, n: int = 6) -> Column:
    return F.round(c, n)


def _text(df: DataFrame, *dates: str) -> DataFrame:
    """Dates as ISO text, which compares alike everywhere."""
    return df.withColumns({c: F.col(c).cast("string") for c in dates})


# Scenes, composites and bins.

_SCENES = "s AS (SELECT event_id AS id, user_id AS roi, event_type AS band, ts, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS cloud FROM events)"


def _scenes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    cloud = F.get_json_object("props", "$.k").try_cast("double")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("roi"), F.col("event_type").alias("band"), "ts", "value", cloud.alias("cloud"))


def _clear(spark: SparkSession, d: str, most: float) -> DataFrame:
    s = _scenes(spark, d)
    return s.filter(scan.in_window(F.col("ts"), "2024-01-03", "2024-01-24") & scan.cloud_ok(F.col("cloud"), most))


_CLEAR = "c AS (SELECT * FROM s WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-24' AND cloud <= {0})"


@query(f"WITH {_SCENES}, {_CLEAR.format(50)} SELECT roi, band, round(median(value), 6) AS value, count(value) AS n_scenes FROM c GROUP BY 1, 2")
def composite_median(spark: SparkSession, d: str) -> DataFrame:
    return scan.median_composite(_clear(spark, d, 50), ["roi", "band"]).withColumn("value", _r("value"))


@query(f"WITH {_SCENES}, {_CLEAR.format(50)} SELECT roi, band, arg_max(value, (ts, id)) AS value FROM c WHERE value IS NOT NULL GROUP BY 1, 2")
def composite_mosaic(spark: SparkSession, d: str) -> DataFrame:
    return scan.mosaic_composite(_clear(spark, d, 50), ["roi", "band"])


@query(f"""WITH {_SCENES} SELECT id, band IN ('view', 'click') AS filtered FROM s
WHERE CASE WHEN band IN ('view', 'click') THEN coalesce(cloud <= 20, FALSE) ELSE TRUE END""")
def cloud_filter(spark: SparkSession, d: str) -> DataFrame:
    known = ("view", "click")
    return _scenes(spark, d).filter(scan.cloud_ok(F.col("cloud"), 20, F.col("band"), known)).select("id", F.col("band").isin(*known).alias("filtered"))


@query("""WITH s AS (SELECT o_custkey AS roi, list_distinct(list(CASE o_orderstatus WHEN 'F' THEN 'VV' WHEN 'O' THEN 'VH' ELSE 'HH' END)) AS bands,
  CASE WHEN o_custkey % 3 = 0 THEN 'EW' ELSE 'IW' END AS mode FROM orders GROUP BY o_custkey)
SELECT roi, mode <> 'IW' AS iw_relaxed FROM s WHERE list_contains(bands, 'VV') AND list_contains(bands, 'VH')""")
def dual_pol_scan(spark: SparkSession, d: str) -> DataFrame:
    band = F.when(F.col("o_orderstatus") == "F", "VV").when(F.col("o_orderstatus") == "O", "VH").otherwise("HH")
    s = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("roi")).agg(F.collect_set(band).alias("bands"))
    s = s.withColumn("mode", F.when(F.col("roi") % 3 == 0, "EW").otherwise("IW"))
    return scan.dual_pol_relaxed(s, ["roi"]).select("roi", "iw_relaxed")


def _windows(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    start = F.date_add(F.lit("2022-01-01").cast("date"), (F.col("id") % 200).cast("int"))
    return c.select("id", start.alias("s"), F.date_add(start, (1 + F.col("id") % 400).cast("int")).alias("e"))


_WINDOWS = "w AS (SELECT c_custkey AS id, DATE '2022-01-01' + CAST(c_custkey % 200 AS INTEGER) AS s, DATE '2022-01-01' + CAST(c_custkey % 200 + 1 + c_custkey % 400 AS INTEGER) AS e FROM customer)"
_EQUAL = """equal AS (SELECT id, k, s + CAST(((e - s) * k) // {n} AS INTEGER) AS a, CASE WHEN k = {n} - 1 THEN e ELSE s + CAST(((e - s) * (k + 1)) // {n} AS INTEGER) END AS b, e
  FROM w, range({n}) t(k)), eq AS (SELECT id, CAST(k AS INTEGER) AS k, a AS start, CASE WHEN b > a THEN b ELSE least(e, a + 1) END AS "end" FROM equal)"""
_FIXED = """fx AS (SELECT id, CAST(k AS INTEGER) AS k, s + CAST(k * 30 AS INTEGER) AS start, least(e, s + CAST((k + 1) * 30 AS INTEGER)) AS "end", e
  FROM w, range(12) t(k) WHERE s + CAST(k * 30 AS INTEGER) < e)"""


def _bins(rows: DataFrame, bins: Column) -> DataFrame:
    return _text(rows.select("id", F.explode(bins).alias("b")).select("id", "b.k", "b.start", "b.end"), "start", "end")


@query(f"WITH {_WINDOWS}, {_EQUAL.format(n=7)} SELECT id, k, CAST(start AS VARCHAR) AS start, CAST(\"end\" AS VARCHAR) AS \"end\" FROM eq WHERE start < \"end\"")
def bins_equal(spark: SparkSession, d: str) -> DataFrame:
    return _bins(_windows(spark, d), temporal.equal_bins(F.col("s"), F.col("e"), 7))


@query(f"WITH {_WINDOWS}, {_FIXED} SELECT id, k, CAST(start AS VARCHAR) AS start, CAST(\"end\" AS VARCHAR) AS \"end\" FROM fx")
def bins_fixed(spark: SparkSession, d: str) -> DataFrame:
    return _bins(_windows(spark, d), temporal.fixed_bins(F.col("s"), F.col("e"), 30, 12))


@query(f"""WITH {_WINDOWS}, {_EQUAL.format(n=12)}, {_FIXED}, l AS (SELECT id, max(e) - max("end") >= 30 AS stretched FROM fx GROUP BY id)
SELECT id, k, CAST(start AS VARCHAR) AS start, CAST("end" AS VARCHAR) AS "end", stretched FROM fx JOIN l USING (id) WHERE NOT stretched
UNION ALL SELECT id, k, CAST(start AS VARCHAR) AS start, CAST("end" AS VARCHAR) AS "end", stretched FROM eq JOIN l USING (id) WHERE stretched AND start < "end" """)
def bins_fixed_or_equal(spark: SparkSession, d: str) -> DataFrame:
    b = temporal.fixed_or_equal_bins(F.col("s"), F.col("e"), 30, 12)
    return _text(_windows(spark, d).select("id", b.alias("p")).select("id", "p.stretched", F.explode("p.bins").alias("b")).select("id", "b.k", "b.start", "b.end", "stretched"), "start", "end")


_BINNED = f"""{_SCENES}, c AS (SELECT * FROM s WHERE cloud <= 20), b AS (SELECT CAST(k AS INTEGER) AS k, DATE '2024-01-01' + CAST(k * 6 AS INTEGER) AS a,
  least(DATE '2024-01-31', DATE '2024-01-01' + CAST((k + 1) * 6 AS INTEGER)) AS z FROM range(5) t(k)),
f AS (SELECT roi, band, k, median(value) AS value FROM c JOIN b ON CAST(ts AS DATE) >= a AND CAST(ts AS DATE) < z GROUP BY ALL),
g AS (SELECT roi, band, b.k, a, z, value FROM (SELECT DISTINCT roi, band FROM c) CROSS JOIN b LEFT JOIN f USING (roi, band, k))"""


def _binned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = _scenes(spark, d).filter(scan.cloud_ok(F.col("cloud"), 20))
    day = lambda s: F.lit(s).cast("date")
    w = c.select("roi").distinct().withColumn("bins", temporal.fixed_bins(day("2024-01-01"), day("2024-01-31"), 6))
    return c, scan.binned(c, w, ["roi", "band"])


@query(f"WITH {_BINNED} SELECT roi, band, k, CAST(a AS VARCHAR) AS start, CAST(z AS VARCHAR) AS \"end\", round(value, 6) AS value, value IS NULL AS empty FROM g")
def binned_composite(spark: SparkSession, d: str) -> DataFrame:
    return _text(_binned(spark, d)[1].withColumn("value", _r("value")), "start", "end")


@query(f"""WITH {_BINNED}, n AS (SELECT x.roi, x.band, x.k, arg_min(y.value, (abs(x.k - y.k), y.k)) AS near FROM g x JOIN g y USING (roi, band) WHERE y.value IS NOT NULL GROUP BY ALL)
SELECT roi, band, k, round(coalesce(value, near), 6) AS filled, CASE WHEN value IS NOT NULL THEN 'own' WHEN near IS NOT NULL THEN 'nearest' ELSE 'none' END AS source FROM g LEFT JOIN n USING (roi, band, k)""")
def backfill_nearest(spark: SparkSession, d: str) -> DataFrame:
    return scan.backfilled(_binned(spark, d)[1], ["roi", "band"]).select("roi", "band", "k", _r("filled").alias("filled"), "source")


@query(f"""WITH {_BINNED}, a AS (SELECT roi, band, median(value) AS whole FROM c GROUP BY ALL)
SELECT roi, band, k, round(coalesce(value, whole), 6) AS filled, CASE WHEN value IS NOT NULL THEN 'own' WHEN whole IS NOT NULL THEN 'window' ELSE 'none' END AS source FROM g LEFT JOIN a USING (roi, band)""")
def backfill_window(spark: SparkSession, d: str) -> DataFrame:
    c, b = _binned(spark, d)
    whole = scan.median_composite(c, ["roi", "band"]).select("roi", "band", F.col("value").alias("whole"))
    return scan.backfilled(b, ["roi", "band"], whole).select("roi", "band", "k", _r("filled").alias("filled"), "source")


_FRAMES = "f AS (SELECT l_partkey AS roi, CAST(l_shipdate AS DATE) AS t, to_json(list(CAST(l_linenumber AS INTEGER) ORDER BY l_linenumber)) AS frame FROM lineitem GROUP BY ALL)"


def _frames(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    frame = F.to_json(F.array_sort(F.collect_list(F.col("l_linenumber").cast("int"))))
    return li.groupBy(F.col("l_partkey").alias("roi"), F.to_date("l_shipdate").alias("t")).agg(frame.alias("frame"))


@query(f"WITH {_FRAMES} SELECT roi, count(*) AS n_frames, count(DISTINCT frame) AS n_distinct FROM f GROUP BY 1")
def distinct_frames(spark: SparkSession, d: str) -> DataFrame:
    return scan.frames_meta(_frames(spark, d))


@query(f"WITH {_FRAMES} SELECT roi, frame, CAST(min(t) AS VARCHAR) AS t FROM f GROUP BY 1, 2")
def duplicate_frames(spark: SparkSession, d: str) -> DataFrame:
    return _text(scan.first_frames(_frames(spark, d)).select("roi", "frame", "t"), "t")


@query("""WITH x AS (SELECT DISTINCT l_partkey AS part, CAST(l_shipdate AS DATE) AS d FROM lineitem), g AS (SELECT part, d - lag(d) OVER (PARTITION BY part ORDER BY d) AS g FROM x)
SELECT part, CAST(coalesce(max(g), 0) AS INTEGER) AS max_gap_days, coalesce(max(g), 0) > 184 AS out_of_range FROM g GROUP BY 1""")
def max_gap(spark: SparkSession, d: str) -> DataFrame:
    dates = table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.to_date("l_shipdate").alias("d"))
    return scan.spacing(dates, "part", "d")


@query("""SELECT o_orderkey AS id, CAST(least(364, dayofyear(o_orderdate) - 1) AS INTEGER) AS doy0, CAST(month(o_orderdate) - 1 AS INTEGER) AS month0, CAST(weekofyear(o_orderdate) AS INTEGER) AS week,
CAST(year(o_orderdate) AS INTEGER) AS year, CAST(day(o_orderdate) AS INTEGER) AS day, round(sin(weekofyear(o_orderdate) * 2 * pi() / 52), 6) + 0.0 AS sin_week, round(cos(weekofyear(o_orderdate) * 2 * pi() / 52), 6) + 0.0 AS cos_week FROM orders""")
def frame_meta(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("o_orderdate")
    p, c = temporal.calendar_parts(F.to_date(t)), temporal.cyclic_time(t)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), temporal.day_of_year0(t).cast("int").alias("doy0"), temporal.month0(t).alias("month0"), F.weekofyear(t).alias("week"), p["year"].alias("year"), p["day"].alias("day"), _r(c[0]).alias("sin_week"), _r(c[1]).alias("cos_week"))


@query(f"WITH {_WINDOWS} SELECT id, CAST(s + CAST((e - s) // 2 AS INTEGER) AS VARCHAR) AS mid, CAST(least(greatest((e - s) // 28, 1), 4) AS INTEGER) AS frames, s < e AS valid FROM w")
def window_plan(spark: SparkSession, d: str) -> DataFrame:
    s, e = F.col("s"), F.col("e")
    return _windows(spark, d).select("id", temporal.midpoint(s, e).cast("string").alias("mid"), temporal.auto_frames(s, e).alias("frames"), temporal.valid_window(s, e).alias("valid"))


@query("""SELECT c_custkey AS id, CAST(CASE c_custkey % 3 WHEN 0 THEN make_date(2000 + c_custkey % 20, 1, 1) WHEN 1 THEN DATE '2022-01-01' + CAST(c_custkey % 200 AS INTEGER) ELSE DATE '2022-06-01' END AS VARCHAR) AS start,
CAST(CASE c_custkey % 3 WHEN 0 THEN make_date(2001 + c_custkey % 20, 1, 1) WHEN 1 THEN DATE '2022-01-01' + CAST(c_custkey % 200 + 1 + c_custkey % 400 AS INTEGER) ELSE DATE '2022-09-01' END AS VARCHAR) AS "end" FROM customer""")
def window_resolution(spark: SparkSession, d: str) -> DataFrame:
    mode = F.when(F.col("id") % 3 == 0, "year").when(F.col("id") % 3 == 1, "range")
    w = temporal.window_of(mode, (2000 + F.col("id") % 20).cast("int"), F.col("s"), F.col("e"))
    return _text(_windows(spark, d).select("id", w.alias("w")).select("id", "w.start", "w.end"), "start", "end")


# Grids and tokens.

_GRID = "t AS (SELECT vec_id AS id, unnest(range(len(embedding))) AS pos, unnest(embedding) AS f FROM embeddings), g AS (SELECT id, pos // 8 AS y, pos % 8 AS x, pos, CAST(f AS DOUBLE) AS value FROM t)"


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return pooling.as_grid(table(spark, d, "embeddings"), 8, "vec_id", "embedding").withColumnRenamed("vec_id", "id")


@query(f"WITH {_GRID} SELECT id, round(avg(value), 6) AS mean, max(value) AS max FROM g GROUP BY 1")
def pool_grid(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d)
    both = pooling.pooled(g, ["id"]).withColumnRenamed("value", "mean").join(pooling.pooled(g, ["id"], "max"), "id")
    return both.select("id", _r("mean").alias("mean"), F.col("value").alias("max"))


@query(f"WITH {_GRID} SELECT id, round(avg(value) FILTER (value >= 0), 6) AS value, count(*) FILTER (value >= 0) AS n_valid, round(avg(CAST(value < 0 AS INTEGER)), 6) AS nodata_share FROM g GROUP BY 1")
def pool_nodata(spark: SparkSession, d: str) -> DataFrame:
    p = pooling.pooled_valid(_grid(spark, d), ["id"], F.col("value") < 0)
    return p.select("id", _r("value").alias("value"), "n_valid", _r("nodata_share").alias("nodata_share"))


# Tokens: the 64 values of a vector as tokens of one dimension, in half of the vectors behind a leading token.
_TOKENS = f"""{_GRID}, k AS (SELECT id, pos + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS pos, 0 AS d, value FROM g UNION ALL SELECT DISTINCT id, 0, 0, 9.0 FROM g WHERE id % 2 = 0),
n AS (SELECT *, max(pos) OVER (PARTITION BY id) + 1 AS n FROM k)"""


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    v = v.select("id", F.posexplode(F.when(F.col("id") % 2 == 0, F.concat(F.array(F.lit(9.0)), "e")).otherwise(F.col("e"))).alias("pos", "value"))
    return v.select("id", "pos", F.lit(0).alias("d"), "value")


@query(f"WITH {_TOKENS} SELECT id, CAST(d AS INTEGER) AS d, round(avg(value), 6) AS value FROM n WHERE n = 64 OR pos > 0 GROUP BY 1, 2")
def pool_tokens(spark: SparkSession, d: str) -> DataFrame:
    return pooling.pooled_tokens(_tokens(spark, d), ["id"]).select("id", "d", _r("value").alias("value"))


@query(f"WITH {_TOKENS} SELECT id, CAST(d AS INTEGER) AS d, CAST((pos - n + 64) // 8 AS INTEGER) AS y, CAST((pos - n + 64) % 8 AS INTEGER) AS x, value FROM n WHERE n = 64 OR pos > 0")
def tokens_to_grid(spark: SparkSession, d: str) -> DataFrame:
    return pooling.token_grid(_tokens(spark, d), ["id"]).select("id", "d", "y", F.col("x").cast("int").alias("x"), "value")


@query(f"WITH {_TOKENS} SELECT id, CAST((pos - n + 64) % 16 AS INTEGER) AS cell, CAST(d AS INTEGER) AS d, max(value) AS value FROM n WHERE n = 64 OR pos > 0 GROUP BY 1, 2, 3")
def pool_frames(spark: SparkSession, d: str) -> DataFrame:
    p = pooling.frame_tokens(_tokens(spark, d), ["id"], 4, True, "max")
    return p.select("id", F.col("cell").cast("int").alias("cell"), "d", "value")


@query(f"WITH {_GRID} SELECT id, CAST(pos % 16 AS INTEGER) AS cell, round(avg(value), 6) AS value FROM g GROUP BY 1, 2")
def group_merge_mean(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("pos", "v")).withColumn("value", F.col("v").cast("double"))
    return pooling.group_merged(v, ["id"], 16).select("id", "cell", _r("value").alias("value"))


_ROI = (0.2, 0.7, 0.3, 0.95)


@query(f"WITH {_GRID} SELECT id, CAST(y - 1 AS INTEGER) AS y, CAST(x - 2 AS INTEGER) AS x, value FROM g WHERE y >= 1 AND y < 6 AND x >= 2 AND x < 8")
def grid_crop_roi(spark: SparkSession, d: str) -> DataFrame:
    return pooling.cropped(_grid(spark, d), _ROI, 8, 8).select("id", "y", F.col("x").cast("int").alias("x"), "value")


@query(f"WITH {_GRID} SELECT id, max(value) AS value FROM g WHERE y >= 1 AND y < 6 AND x >= 2 AND x < 8 GROUP BY 1")
def roi_pool(spark: SparkSession, d: str) -> DataFrame:
    return pooling.pooled(pooling.cropped(_grid(spark, d), _ROI, 8, 8), ["id"], "max")


@query(f"WITH {_GRID} SELECT id, CAST(CASE WHEN id % 2 = 0 THEN 7 - y ELSE y END AS INTEGER) AS y, CAST(x AS INTEGER) AS x, value FROM g")
def grid_flip_north_up(spark: SparkSession, d: str) -> DataFrame:
    return pooling.north_up(_grid(spark, d), F.lit(8), F.col("id") % 2 == 0).select("id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "value")


# Tiles.

_IMAGES = "i AS (SELECT p_partkey AS roi_id, CAST(1 + (p_partkey * 37) % 399 AS INTEGER) AS h, CAST(1 + (p_partkey * 53) % 399 AS INTEGER) AS w FROM part)"
_AXIS = """s AS (SELECT roi_id, h, unnest(list_sort(list_distinct(list_transform(range(greatest(1, CAST(ceil(h / 64.0) AS BIGINT))), lambda k: least(k * 64, greatest(h - 64, 0)))))) AS start FROM i),
a AS (SELECT roi_id, h, CAST(row_number() OVER (PARTITION BY roi_id ORDER BY start) - 1 AS INTEGER) AS i, CAST(start AS INTEGER) AS start, CAST(least(h, start + 64) AS INTEGER) AS "end" FROM s),
o AS (SELECT *, coalesce((lag("end") OVER x + start) // 2, start) AS own_start, coalesce(("end" + lead(start) OVER x) // 2, "end") AS e FROM a WINDOW x AS (PARTITION BY roi_id ORDER BY start))"""


def _images(spark: SparkSession, d: str) -> DataFrame:
    size = lambda m: (1 + (F.col("p_partkey") * m) % 399).cast("int")
    return table(spark, d, "part").select(F.col("p_partkey").alias("roi_id"), size(37).alias("h"), size(53).alias("w"))


def _axis(images: DataFrame, side: str) -> DataFrame:
    rows = images.select("roi_id", side, F.posexplode(tiles.starts(F.col(side), 64)).alias("i", "start"))
    return rows.select("roi_id", "i", "start", F.least(F.col(side), F.col("start") + 64).alias("end"))


@query(f"WITH {_IMAGES}, {_AXIS} SELECT roi_id, i, start, \"end\" FROM a")
def tile_starts(spark: SparkSession, d: str) -> DataFrame:
    return _axis(_images(spark, d), "h")


@query(f"WITH {_IMAGES}, {_AXIS} SELECT roi_id, i, CAST(own_start AS INTEGER) AS own_start, CAST(greatest(e, own_start + 1) AS INTEGER) AS own_end FROM o")
def tile_ownership(spark: SparkSession, d: str) -> DataFrame:
    return tiles.owned(_axis(_images(spark, d), "h")).select("roi_id", "i", "own_start", "own_end")


@query(f"""WITH {_IMAGES}, n AS (SELECT *, (CASE WHEN h <= 64 THEN 1 ELSE ceil((h - 64) / 64.0) + 1 END) * (CASE WHEN w <= 64 THEN 1 ELSE ceil((w - 64) / 64.0) + 1 END) AS n FROM i)
SELECT roi_id, CAST(n AS INTEGER) AS n, CASE WHEN n > 30 THEN 'error' WHEN n > 10 THEN 'warn' ELSE 'ok' END AS budget,
CAST(CASE WHEN h > 64 AND h % 64 > 0 AND h % 64 <= 6 THEN h - h % 64 ELSE h END AS INTEGER) AS snapped FROM n""")
def tile_plan(spark: SparkSession, d: str) -> DataFrame:
    n = tiles.count(F.col("h"), F.col("w"), 64, 64)
    return _images(spark, d).select("roi_id", n.alias("n"), tiles.budget(n, 10, 30).alias("budget"), tiles.snapped(F.col("h"), 64, 0.1).cast("int").alias("snapped"))


def _tile_values(spark: SparkSession, d: str) -> DataFrame:
    """Along the vertical axis: a tile's value is its row number plus one, its width the image's."""
    o = tiles.owned(_axis(_images(spark, d), "h")).join(_images(spark, d), "roi_id")
    return o.withColumn("value", (F.col("i") + 1).cast("double"))


@query(f"""WITH {_IMAGES}, {_AXIS}, v AS (SELECT o.roi_id, i + 1.0 AS value, greatest(1, greatest(e, own_start + 1) - own_start) * greatest(1, i.w) AS weight FROM o JOIN i USING (roi_id))
SELECT roi_id, round(sum(weight * value) / greatest(1, sum(weight)), 6) AS value FROM v GROUP BY 1""")
def tile_pooled_merge(spark: SparkSession, d: str) -> DataFrame:
    v = _tile_values(spark, d)
    v = v.withColumn("weight", tiles.overlap_weight(F.col("own_start"), F.col("own_end"), F.lit(0), F.col("w"), None, F.col("h"), F.col("w")))
    return pooling.tile_merged(v, ["roi_id"]).select("roi_id", _r("value").alias("value"))


@query(f"""WITH {_IMAGES}, {_AXIS}, v AS (SELECT o.roi_id, i + 1.0 AS value, greatest(0.0, least(greatest(e, own_start + 1), 0.75 * i.h) - greatest(own_start, 0.25 * i.h)) * (0.5 * i.w) AS weight FROM o JOIN i USING (roi_id))
SELECT roi_id, coalesce(max(value) FILTER (weight > 0), max(value)) AS value FROM v GROUP BY 1""")
def tile_roi_merge(spark: SparkSession, d: str) -> DataFrame:
    v = _tile_values(spark, d)
    v = v.withColumn("weight", tiles.overlap_weight(F.col("own_start"), F.col("own_end"), F.lit(0), F.col("w"), (0.25, 0.75, 0.0, 0.5), F.col("h"), F.col("w")))
    return pooling.tile_merged(v, ["roi_id"], "max")


_CROPS = """sx AS (SELECT roi_id, 'h' AS side, h AS n FROM i UNION ALL SELECT roi_id, 'w', w FROM i),
st AS (SELECT roi_id, side, n, unnest(list_sort(list_distinct(list_transform(range(greatest(1, CAST(ceil(n / 64.0) AS BIGINT))), lambda k: least(k * 64, greatest(n - 64, 0)))))) AS start FROM sx),
ax AS (SELECT roi_id, side, row_number() OVER v - 1 AS i, start, least(n, start + 64) AS e, count(*) OVER (PARTITION BY roi_id, side) AS m FROM st WINDOW v AS (PARTITION BY roi_id, side ORDER BY start)),
ow AS (SELECT *, coalesce((lag(e) OVER v + start) // 2, start) AS os, coalesce((e + lead(start) OVER v) // 2, e) AS oe FROM ax WINDOW v AS (PARTITION BY roi_id, side ORDER BY i)),
ox AS (SELECT roi_id, side, i, m, start, CAST(os AS DOUBLE) AS os, greatest(oe, os + 1) AS oe, (greatest(oe, os + 1) - start) / 64.0 * 4 AS x FROM ow),
f AS (SELECT roi_id, side, i, m, greatest(least(CAST(floor((os - start) / 64.0 * 4) AS INTEGER), 3), 0) AS fs, x, start, 0 AS fo FROM ox WHERE i = 0
  UNION ALL SELECT o.roi_id, o.side, o.i, o.m, greatest(least(CAST(floor((f.start + least(greatest(CAST(floor(f.x + 0.5) AS INTEGER), f.fs + 1), 4) * 16.0 - o.start) / 64.0 * 4) AS INTEGER), 3), 0), o.x, o.start,
    f.fo + least(greatest(CAST(floor(f.x + 0.5) AS INTEGER), f.fs + 1), 4) - f.fs FROM f JOIN ox o ON o.roi_id = f.roi_id AND o.side = f.side AND o.i = f.i + 1),
c AS (SELECT roi_id, side, i, fo, fs, unnest(range(fs, least(greatest(CAST(CASE WHEN i = m - 1 THEN ceil(x) ELSE floor(x + 0.5) END AS INTEGER), fs + 1), 4))) AS k FROM f)"""


@query(f"""WITH RECURSIVE {_IMAGES}, {_CROPS} SELECT r.roi_id, 0 AS d, CAST(r.k - r.fs + r.fo AS INTEGER) AS y, CAST(s.k - s.fs + s.fo AS INTEGER) AS x, r.i * 100.0 + s.i AS value FROM c r JOIN c s ON r.roi_id = s.roi_id AND r.side = 'h' AND s.side = 'w'""")
def tile_stitch(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of 4 x 4 feature cells, each holding its own number, put together per image."""
    img = _images(spark, d)
    ys, xs = _axis(img, "h"), _axis(img, "w")
    cells = ys.select("roi_id", F.col("i").alias("row")).join(xs.select("roi_id", F.col("i").alias("col")), "roi_id")
    cells = cells.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("d", F.lit(0))
    cells = cells.withColumn("value", (F.col("row") * 100 + F.col("col")).cast("double"))
    return pooling.stitched(cells, tiles.crops(ys, 4, 64), tiles.crops(xs, 4, 64))


@query(f"""WITH {_IMAGES}, p AS (SELECT roi_id, h, w, unnest(range(CAST(ceil(h / 100.0) AS BIGINT))) AS i FROM i), q AS (SELECT roi_id, h, w, i, unnest(range(CAST(ceil(w / 100.0) AS BIGINT))) AS j FROM p)
SELECT roi_id, CAST(i * ceil(w / 100.0) + j AS INTEGER) AS part, CAST(i * 100 AS INTEGER) AS y0, CAST(least(h, (i + 1) * 100) AS INTEGER) AS y1, CAST(j * 100 AS INTEGER) AS x0, CAST(least(w, (j + 1) * 100) AS INTEGER) AS x1 FROM q""")
def scan_parts(spark: SparkSession, d: str) -> DataFrame:
    return scan.scan_parts(_images(spark, d), 10_000)


# Radiometry and inspection: quantities of line items as digital numbers, by ship mode of a part (band) and order.

_PIXELS = "p AS (SELECT l_suppkey AS roi, l_returnflag AS band, l_extendedprice / 10 AS value, l_orderkey AS y, l_linenumber AS x FROM lineitem)"


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("roi"), F.col("l_returnflag").alias("band"), (F.col("l_extendedprice") / 10).alias("value"), F.col("l_orderkey").alias("y"), F.col("l_linenumber").alias("x"))


_PK = ["roi", "band", "y", "x", "value"]


def _rows(df: DataFrame, c: str, n: int = 5) -> DataFrame:
    """Every pixel's value, rounded."""
    return df.select("roi", "band", "y", "x", _r(c, n).alias("scaled"))


_ROWS = "SELECT roi, band, y, x, round({0}, 5) AS scaled FROM {1}"


@query(f"WITH {_PIXELS}, z AS (SELECT *, (value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-6) AS z FROM p WINDOW w AS (PARTITION BY roi, band)) {_ROWS.format('z', 'z')}")
def zscore_tile(spark: SparkSession, d: str) -> DataFrame:
    return _rows(radiometry.zscore_tile(_pixels(spark, d), ["roi", "band"]), "z")


@query(f"WITH {_PIXELS}, u AS (SELECT *, greatest(least(value, 10000), 0) / 10000 AS v FROM p), z AS (SELECT *, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w + 1e-6) AS z FROM u WINDOW w AS (PARTITION BY roi, band)) {_ROWS.format('z', 'z')}")
def minmax_tile(spark: SparkSession, d: str) -> DataFrame:
    return _rows(radiometry.minmax_tile(_pixels(spark, d), ["roi", "band"], radiometry.unit(F.col("value"))), "scaled")


@query(f"WITH {_PIXELS}, l AS (SELECT *, ln(1 + greatest(value, 0)) AS v FROM p), z AS (SELECT *, greatest(least(v / quantile_cont(v, 0.99) OVER (PARTITION BY roi), 1), 0) AS z FROM l) {_ROWS.format('z', 'z')}")
def s1_log_p99(spark: SparkSession, d: str) -> DataFrame:
    return _rows(radiometry.log_p99(_pixels(spark, d), ["roi"]), "scaled")


_STATS = "st AS (SELECT * FROM (VALUES " + ", ".join(f"('{b}', {m}, {s})" for b, m, s in zip(*radiometry.BAND_STATS["s2_ten_a"])) + ") t(band, mean, std))"
_S2 = f"b AS (SELECT l_suppkey AS roi, {list(radiometry.BAND_STATS['s2_ten_a'][0])}[l_partkey % 10 + 1] AS band, l_orderkey AS y, l_linenumber AS x, l_extendedprice / 10 AS value FROM lineitem)"


def _s2(spark: SparkSession, d: str) -> DataFrame:
    bands = F.array(*[F.lit(b) for b in radiometry.BAND_STATS["s2_ten_a"][0]])
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("roi"), F.element_at(bands, (F.col("l_partkey") % 10 + 1).cast("int")).alias("band"), F.col("l_orderkey").alias("y"), F.col("l_linenumber").alias("x"), (F.col("l_extendedprice") / 10).alias("value"))


@query(f"WITH {_STATS}, {_S2}, z AS (SELECT roi, b.band, y, x, (value - mean) / std AS z FROM b LEFT JOIN st USING (band)) SELECT roi, band, y, x, round(z, 9) AS scaled FROM z")
def zscore_band_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rows(radiometry.zscore(_s2(spark, d), radiometry.band_stats(spark, "s2_ten_a"), F.col("value")), "z", 9)


@query(f"""WITH {_PIXELS}, c AS (SELECT *, greatest(least(value / 8000, 1.0), 0.0) AS reflectance, greatest(least((value - 2000) / 6000, 1.0), 0.0) AS emissive, 10 * log10(greatest(value, 1e-10)) AS db, CAST(floor(greatest(least(value / 10000, 1.0), 0.0) * 255) AS INTEGER) AS rgb FROM p)
SELECT roi, band, y, x, round(reflectance, 9) AS reflectance, round(emissive, 9) AS emissive, round(db, 6) AS db, rgb FROM c""")
def calibrate(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    kinds = {"reflectance": radiometry.reflectance(v, 8000.0), "emissive": radiometry.emissive(v, 2000.0, 8000.0), "db": radiometry.decibel(v)}
    return _pixels(spark, d).select("roi", "band", "y", "x", *[_r(c, 6 if k == "db" else 9).alias(k) for k, c in kinds.items()], radiometry.rgb8(v).alias("rgb"))


@query("WITH p AS (SELECT c_nationkey AS roi, c_acctbal - 4000 AS value FROM customer) SELECT roi, coalesce(avg(CAST(value < 0 AS INTEGER)) FILTER (value <> 0) > 0.5, FALSE) AS rejected FROM p GROUP BY 1")
def db_guard(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "customer").select(F.col("c_nationkey").alias("roi"), (F.col("c_acctbal") - 4000).alias("value"))
    return radiometry.looks_decibel(p, ["roi"])


@query(f"WITH {_PIXELS}, q AS (SELECT *, quantile_cont(value, 0.02) OVER w AS a, quantile_cont(value, 0.98) OVER w AS b FROM p WINDOW w AS (PARTITION BY roi, band)), z AS (SELECT *, greatest(least((value - a) / greatest(b - a, 1e-8), 1.0), 0.0) AS z FROM q) {_ROWS.format('z', 'z')}")
def stretch_percentile(spark: SparkSession, d: str) -> DataFrame:
    return _rows(radiometry.stretch(_pixels(spark, d), ["roi", "band"]), "stretched")


@query(f"WITH {_PIXELS} SELECT roi, band, min(value) AS min, max(value) AS max, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, 1.0 AS finite_share, count(*) AS n FROM p GROUP BY 1, 2")
def band_stats(spark: SparkSession, d: str) -> DataFrame:
    s = inspection.statistics(_pixels(spark, d), ["roi", "band"])
    return s.withColumn("mean", _r("mean", 4)).withColumn("std", _r("std", 4))


@query(f"WITH {_PIXELS} SELECT roi, band, round(quantile_cont(value, 0.01), 7) AS p01, round(quantile_cont(value, 0.5), 7) AS p50, round(quantile_cont(value, 0.99), 7) AS p99 FROM p GROUP BY 1, 2")
def band_quantiles(spark: SparkSession, d: str) -> DataFrame:
    q = inspection.quantiles(_pixels(spark, d), ["roi", "band"])
    return q.select("roi", "band", *[_r(c, 7).alias(c) for c in ("p01", "p50", "p99")])


@query(f"""WITH {_PIXELS}, h AS (SELECT roi, band, least(CAST(floor((value - 1000) / 250) AS INTEGER), 31) AS bin, count(*) AS n FROM p WHERE value >= 1000 AND value <= 9000 GROUP BY ALL)
SELECT e.roi, e.band, e.bin, coalesce(h.n, 0) AS n FROM (SELECT DISTINCT roi, band, CAST(k AS INTEGER) AS bin FROM p CROSS JOIN range(32) t(k)) e LEFT JOIN h ON h.roi = e.roi AND h.band = e.band AND h.bin = e.bin""")
def band_hist(spark: SparkSession, d: str) -> DataFrame:
    return inspection.histogram(_pixels(spark, d), ["roi", "band"], 1000.0, 9000.0)


@query(f"""WITH {_PIXELS}, f AS (SELECT roi, band, stddev_pop(value) AS std, avg(CAST(value < 200 OR value > 9000 AS INTEGER)) AS out FROM p GROUP BY 1, 2)
SELECT roi, band, concat_ws(',', CASE WHEN std < 1e-6 THEN 'constant' END, CASE WHEN out > 0.001 THEN 'out_of_range' END) AS issues, NOT (std < 1e-6 OR out > 0.001) AS ok FROM f""")
def band_flags(spark: SparkSession, d: str) -> DataFrame:
    return inspection.flags(_pixels(spark, d), ["roi", "band"], 200.0, 9000.0, 0.0)


# Bands, sensors and catalog.

_NAMES = "n AS (SELECT p_partkey AS id, ['S2', 'L89', 'L457', 'MODIS'][1 + p_partkey % 4] AS family, ['red', 'NIR', 'Swir_1', 'B4', 'BLUE'][1 + p_size % 5] AS band FROM part)"


@query(f"""WITH {_NAMES}, a AS (SELECT * FROM (VALUES {', '.join(f"('{f}', '{x}', '{y}')" for f, m in catalog.FAMILIES.items() for x, y in m.items())}) t(family, alias, native))
SELECT id, n.family, band, coalesce(native, band) AS native FROM n LEFT JOIN a ON a.family = n.family AND a.alias = upper(band)""")
def band_alias_join(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (1 + i).cast("int"))
    n = table(spark, d, "part").select(F.col("p_partkey").alias("id"), pick(["S2", "L89", "L457", "MODIS"], F.col("p_partkey") % 4).alias("family"), pick(["red", "NIR", "Swir_1", "B4", "BLUE"], F.col("p_size") % 5).alias("band"))
    return catalog.native_bands(n)


_MEMBERS = "m AS (SELECT p_partkey AS pos, p_brand AS collection, p_type AS semantics, ['B' || (p_size % 5), 'B' || (5 + p_partkey % 4)] AS bands FROM part)"


@query(f"""WITH {_MEMBERS}, u AS (SELECT collection, semantics, band, min((pos, i)) AS first_use FROM (SELECT *, unnest(bands) AS band, unnest([1, 2]) AS i FROM m) GROUP BY ALL),
f AS (SELECT collection, semantics, list(band ORDER BY first_use) AS b FROM u GROUP BY ALL)
SELECT pos, array_to_string(b, ',') AS fetch_bands, array_to_string(list_transform(bands, lambda x: list_position(b, x) - 1), ',') AS channels FROM m JOIN f USING (collection, semantics)""")
def band_union_plan(spark: SparkSession, d: str) -> DataFrame:
    b = lambda c: F.concat(F.lit("B"), c)
    m = table(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("collection"), F.col("p_type").alias("semantics"), F.array(b(F.col("p_size") % 5), b(5 + F.col("p_partkey") % 4)).alias("bands"))
    p = catalog.fetch_plan(m)
    return p.select("pos", F.array_join("fetch_bands", ",").alias("fetch_bands"), F.array_join(F.transform("channels", lambda c: c.cast("string")), ",").alias("channels"))


@query("SELECT vec_id, round(CAST(embedding[8] AS DOUBLE), 6) AS a, round(CAST(embedding[2] AS DOUBLE), 6) AS b FROM embeddings")
def channel_select(spark: SparkSession, d: str) -> DataFrame:
    v = catalog.select_channels(F.col("embedding"), F.array(F.lit(7), F.lit(1)))
    return table(spark, d, "embeddings").select("vec_id", v.alias("v")).select("vec_id", _r(F.col("v")[0].cast("double")).alias("a"), _r(F.col("v")[1].cast("double")).alias("b"))


@query("SELECT model, dim, model_type, collection FROM model_catalog ORDER BY model")
def list_catalog(spark: SparkSession, d: str) -> DataFrame:
    return catalog.listed(table(spark, d, "model_catalog"), "model", "dim", "model_type", "collection")


@query("""WITH r AS (SELECT DISTINCT model, ['pooled', 'grid', 'tokens'][1 + CAST(export_id % 3 AS INTEGER)] AS output FROM model_results)
SELECT r.model, r.output, CASE WHEN c.model IS NULL THEN 'unknown model' WHEN NOT (r.output = 'pooled' OR r.output = 'grid' AND c.model_type = 'onthefly') THEN 'output' ELSE 'ok' END AS support FROM r LEFT JOIN model_catalog c USING (model)""")
def capability_check(spark: SparkSession, d: str) -> DataFrame:
    out = F.element_at(F.array(F.lit("pooled"), F.lit("grid"), F.lit("tokens")), (1 + F.col("export_id") % 3).cast("int"))
    r = table(spark, d, "model_results").select("model", out.alias("output"), F.lit("auto").alias("backend")).distinct()
    outputs = F.when(F.col("model_type") == "onthefly", F.array(F.lit("pooled"), F.lit("grid"))).otherwise(F.array(F.lit("pooled")))
    c = table(spark, d, "model_catalog").select("model", outputs.alias("outputs"), F.array(F.lit("auto"), F.lit("local")).alias("backends"))
    return catalog.supported(r, c).select("model", "output", "support")


# Space.

_BOXES = "b AS (SELECT c_custkey AS id, (c_custkey * 37) % 358 - 179.5 AS a, (c_custkey * 17) % 160 - 80.25 AS b, (c_custkey * 37) % 358 - 179.5 + (1 + c_custkey % 7) * 0.05 AS c, (c_custkey * 17) % 160 - 80.25 + (1 + c_custkey % 5) * 0.04 AS d FROM customer)"
_X, _Y = "6378137.0 * radians({0})", "6378137.0 * ln(tan(pi() / 4 + radians(greatest(least({0}, 85.05112878), -85.05112878)) / 2))"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    lon, lat = (k * 37) % 358 - 179.5, (k * 17) % 160 - 80.25
    return table(spark, d, "customer").select(k.alias("id"), lon.alias("a"), lat.alias("b"), (lon + (1 + k % 7) * 0.05).alias("c"), (lat + (1 + k % 5) * 0.04).alias("d"))


def _abcd() -> tuple[Column, ...]:
    return F.col("a"), F.col("b"), F.col("c"), F.col("d")


@query(f"""WITH {_BOXES} SELECT id, round({_X.format('a')}, 3) AS x, round({_Y.format('b')}, 3) AS y, round(a, 6) AS lon, round(b, 6) AS lat FROM b""")
def mercator(spark: SparkSession, d: str) -> DataFrame:
    x, y = spatial.mercator_x(F.col("a")), spatial.mercator_y(F.col("b"))
    return _boxes(spark, d).select("id", _r(x, 3).alias("x"), _r(y, 3).alias("y"), _r(spatial.lon_of(x)).alias("lon"), _r(spatial.lat_of(y)).alias("lat"))


@query(f"""WITH {_BOXES}, m AS (SELECT *, {_X.format('a')} AS x0, {_X.format('c')} AS x1, {_Y.format('b')} AS y0, {_Y.format('d')} AS y1 FROM b),
s AS (SELECT *, greatest(x1 - x0, y1 - y0) AS side, abs((x1 - x0) - (y1 - y0)) <= 1e-4 * greatest(x1 - x0, y1 - y0) AS keep FROM m),
t AS (SELECT *, degrees(((x0 + x1) / 2 - side / 2) / 6378137.0) AS lo, degrees(((x0 + x1) / 2 + side / 2) / 6378137.0) AS hi, degrees(2 * atan(exp(((y0 + y1) / 2 - side / 2) / 6378137.0)) - pi() / 2) AS bo, degrees(2 * atan(exp(((y0 + y1) / 2 + side / 2) / 6378137.0)) - pi() / 2) AS tp FROM s),
u AS (SELECT *, keep OR lo < -180 OR hi > 180 OR bo < -90 OR tp > 90 AS k FROM t)
SELECT id, round(CASE WHEN k THEN a ELSE lo END, 5) AS minlon, round(CASE WHEN k THEN b ELSE bo END, 5) AS minlat, round(CASE WHEN k THEN c ELSE hi END, 5) AS maxlon, round(CASE WHEN k THEN d ELSE tp END, 5) AS maxlat,
round(CASE WHEN k THEN 0 ELSE (1 - (y1 - y0) / side) / 2 END, 6) AS y0, round(CASE WHEN k THEN 1 ELSE (1 + (x1 - x0) / side) / 2 END, 6) AS x1 FROM u""")
def square_roi(spark: SparkSession, d: str) -> DataFrame:
    s = _boxes(spark, d).select("id", spatial.square_roi(*_abcd()).alias("s")).select("id", "s.*")
    return s.select("id", *[_r(c, 5).alias(c) for c in ("minlon", "minlat", "maxlon", "maxlat")], "y0", "x1")


@query(f"""WITH {_BOXES} SELECT id, CAST(ceil(abs({_Y.format('d')} - {_Y.format('b')}) / 30) AS INTEGER) AS h, CAST(ceil(abs({_X.format('c')} - {_X.format('a')}) / 30) AS INTEGER) AS w,
CAST(greatest(trunc((d - b) * 111320.0 / 30), 1) AS INTEGER) AS dh, CAST(greatest(trunc((c - a) * 111320.0 * cos(radians((b + d) / 2)) / 30), 1) AS INTEGER) AS dw FROM b""")
def pixel_span(spark: SparkSession, d: str) -> DataFrame:
    p, q = spatial.pixel_span(*_abcd(), 30.0), spatial.degree_span(*_abcd(), 30.0)
    return _boxes(spark, d).select("id", p["h"].alias("h"), p["w"].alias("w"), q["h"].alias("dh"), q["w"].alias("dw"))


@query(f"""WITH {_BOXES}, m AS (SELECT *, ({_X.format('c')} - {_X.format('a')}) >= ({_Y.format('d')} - {_Y.format('b')}) AS wide, degrees(2 * atan(exp(({_Y.format('b')} + {_Y.format('d')}) / 2 / 6378137.0)) - pi() / 2) AS my, (a + c) / 2 AS mx FROM b)
SELECT id, CASE WHEN wide THEN ['west', 'east'][i] ELSE ['south', 'north'][i] END AS part, round(CASE WHEN wide AND i = 2 THEN mx ELSE a END, 5) AS minlon, round(CASE WHEN NOT wide AND i = 2 THEN my ELSE b END, 5) AS minlat,
round(CASE WHEN wide AND i = 1 THEN mx ELSE c END, 5) AS maxlon, round(CASE WHEN NOT wide AND i = 1 THEN my ELSE d END, 5) AS maxlat FROM m CROSS JOIN (VALUES (1), (2)) t(i)""")
def bbox_split(spark: SparkSession, d: str) -> DataFrame:
    rows = _boxes(spark, d).select("id", F.explode(spatial.split_box(*_abcd())).alias("p")).select("id", "p.*")
    return rows.select("id", "part", *[_r(c, 5).alias(c) for c in ("minlon", "minlat", "maxlon", "maxlat")])


@query(f"""WITH {_BOXES} SELECT id, round(a + (c - a) * 64 / 256.0, 6) AS minlon, round(d - (d - b) * 128 / 256.0, 6) AS minlat, round(a + (c - a) * 128 / 256.0, 6) AS maxlon, round(d - (d - b) * 64 / 256.0, 6) AS maxlat,
round((a + c) / 2, 6) AS lon, round((b + d) / 2, 6) AS lat, round(sin(radians((b + d) / 2)), 6) AS sin_lat, round(a - 500 / (111320.0 * greatest(1e-6, cos(radians(b)))), 6) AS west FROM b""")
def tile_extent(spark: SparkSession, d: str) -> DataFrame:
    n = F.lit(256)
    t = spatial.tile_extent(*_abcd(), n, n, F.lit(64), F.lit(128), F.lit(64), F.lit(128))
    c = spatial.centre(*_abcd())
    p, w = spatial.cyclic_place(c["lon"], c["lat"]), spatial.buffer_box(F.col("a"), F.col("b"), F.lit(500.0))
    return _boxes(spark, d).select("id", *[_r(t[x]).alias(x) for x in ("minlon", "minlat", "maxlon", "maxlat")], _r(c["lon"]).alias("lon"), _r(c["lat"]).alias("lat"), _r(p[0]).alias("sin_lat"), _r(w["minlon"]).alias("west"))


@query("""SELECT roi_id, kind, coalesce(CASE kind WHEN 'bbox' THEN crs = 'EPSG:4326' AND minlon >= -180 AND minlon < maxlon AND maxlon <= 180 AND minlat >= -90 AND minlat < maxlat AND maxlat <= 90
ELSE crs = 'EPSG:4326' AND buffer_m > 0 END, FALSE) AS valid FROM rois""")
def roi_valid(spark: SparkSession, d: str) -> DataFrame:
    ok = F.when(F.col("kind") == "bbox", spatial.valid_box(*map(F.col, ("minlon", "minlat", "maxlon", "maxlat", "crs")))).otherwise(spatial.valid_point(F.col("buffer_m"), F.col("crs")))
    return table(spark, d, "rois").select("roi_id", "kind", ok.alias("valid"))


@query(f"""SELECT DISTINCT roi_id, round(CASE kind WHEN 'bbox' THEN {_X.format('minlon')} ELSE {_X.format('lon')} - buffer_m END, 2) AS minx, round(CASE kind WHEN 'bbox' THEN {_Y.format('maxlat')} ELSE {_Y.format('lat')} + buffer_m END, 2) AS maxy
FROM rois WHERE coalesce(CASE kind WHEN 'bbox' THEN crs = 'EPSG:4326' AND minlon >= -180 AND minlon < maxlon AND maxlon <= 180 AND minlat >= -90 AND minlat < maxlat AND maxlat <= 90
ELSE crs = 'EPSG:4326' AND buffer_m > 0 AND lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 END, FALSE)""")
def roi_boxes(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "rois")
    ok = F.when(F.col("kind") == "bbox", spatial.valid_box(*map(F.col, ("minlon", "minlat", "maxlon", "maxlat", "crs")))).otherwise(spatial.valid_point(F.col("buffer_m"), F.col("crs")) & F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90))
    b = spatial.roi_box(*map(F.col, ("kind", "lon", "lat", "buffer_m", "minlon", "minlat", "maxlon", "maxlat")))
    return r.filter(ok).select("roi_id", _r(b["minx"], 2).alias("minx"), _r(b["maxy"], 2).alias("maxy")).distinct()


_FOOT = "r AS (SELECT id AS roi_id, a, b, c + 0.7 AS c, d + 0.7 AS d FROM b), f AS (SELECT s_suppkey AS scene_id, (s_suppkey * 91) % 350 - 175.0 AS a, (s_suppkey * 29) % 150 - 75.0 AS b, (s_suppkey * 91) % 350 - 170.0 AS c, (s_suppkey * 29) % 150 - 72.0 AS d FROM supplier)"


@query(f"WITH {_BOXES}, {_FOOT} SELECT roi_id, scene_id, round((least(r.c, f.c) - greatest(r.a, f.a)) * (least(r.d, f.d) - greatest(r.b, f.b)), 6) AS area FROM r JOIN f ON r.a < f.c AND f.a < r.c AND r.b < f.d AND f.b < r.d")
def roi_scene_range_join(spark: SparkSession, d: str) -> DataFrame:
    r = _boxes(spark, d).select(F.col("id").alias("roi_id"), F.col("a").alias("minx"), F.col("b").alias("miny"), (F.col("c") + 0.7).alias("maxx"), (F.col("d") + 0.7).alias("maxy"))
    k = F.col("s_suppkey")
    f = table(spark, d, "supplier").select(k.alias("scene_id"), ((k * 91) % 350 - 175.0).alias("minx"), ((k * 29) % 150 - 75.0).alias("miny"), ((k * 91) % 350 - 170.0).alias("maxx"), ((k * 29) % 150 - 72.0).alias("maxy"))
    return scan.footprint_join(r, f, 4.0).withColumn("area", _r("area"))


@query("SELECT l_partkey % 50 AS y, l_suppkey % 20 AS x, arg_max(l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice)) AS value FROM lineitem GROUP BY 1, 2")
def product_mosaic(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select((F.col("l_partkey") % 50).alias("y"), (F.col("l_suppkey") % 20).alias("x"), F.col("l_quantity").alias("value"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice").alias("o"))
    return scan.product_mosaic(t, ["y", "x"], "o")


# Exports.


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_linestatus = 'F')")
def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return export.pending(table(spark, d, "orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_linestatus = 'F')")
def resume_semi(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_linestatus") == "F", "ok").otherwise("open").alias("status"))
    return export.kept(table(spark, d, "orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


_RESULTS = "r AS (SELECT DISTINCT result_id, export_id, model, point_index, lower(trim(status)) AS status FROM model_results WHERE export_id IS NOT NULL), m AS (SELECT export_id, model, point_index, min(result_id) AS result_id FROM r WHERE point_index IS NOT NULL GROUP BY ALL)"


def _results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "model_results").filter("export_id is not null").select("result_id", "export_id", "model", "point_index", F.lower(F.trim("status")).alias("status")).distinct()


@query(f"WITH {_RESULTS} SELECT e.export_id, e.model, e.point_index, m.result_id FROM (SELECT export_id, model, unnest(range(max(point_index) + 1))::INTEGER AS point_index FROM m GROUP BY export_id, model) e LEFT JOIN m USING (export_id, model, point_index)")
def left_align(spark: SparkSession, d: str) -> DataFrame:
    m = _results(spark, d).filter("point_index is not null").groupBy("export_id", "model", "point_index").agg(F.min("result_id").alias("result_id"))
    return export.aligned(m, ["export_id", "model"])


@query(f"""WITH {_RESULTS}, n AS (SELECT export_id, count(*) AS n, count(*) FILTER (status = 'failed') AS n_failed, count(*) FILTER (status = 'partial') AS n_partial FROM r GROUP BY 1)
SELECT *, CASE WHEN n_failed = 0 AND n_partial = 0 THEN 'ok' WHEN n_failed < n THEN 'partial' ELSE 'failed' END AS status FROM n""")
def status_rollup(spark: SparkSession, d: str) -> DataFrame:
    return export.rollup(_results(spark, d), ["export_id"])


@query(f"""WITH {_RESULTS}, n AS (SELECT model, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status IS NULL OR status <> 'ok') AS n_failed FROM r GROUP BY 1)
SELECT *, CASE WHEN n_failed = 0 THEN 'ok' WHEN n_ok = 0 THEN 'failed' ELSE 'partial' END AS status FROM n""")
def model_status_rollup(spark: SparkSession, d: str) -> DataFrame:
    return export.model_rollup(_results(spark, d), ["model"])


@query("SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS owner, o_orderkey <> min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS reused FROM orders")
def input_reuse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.struct("o_custkey", "o_orderpriority").alias("k"))
    return catalog.first_by(rows, "k", "o_orderkey").select("o_orderkey", "owner", "reused")


@query("SELECT c_custkey, CAST(c_custkey // 16 AS BIGINT) AS chunk, c_custkey % 16 AS place FROM customer")
def chunked(spark: SparkSession, d: str) -> DataFrame:
    return catalog.chunks(table(spark, d, "customer").select("c_custkey"), "c_custkey").select("c_custkey", "chunk", "place")


@query("""WITH k AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(p_name || ' #' || p_brand, '[^0-9a-zA-Z_]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS key FROM part)
SELECT p_partkey, key, substr(sha1(concat_ws(chr(31), key, 'x')), 1, 12) AS hash FROM k""")
def sanitize_key(spark: SparkSession, d: str) -> DataFrame:
    k = strings.sanitized(F.concat("p_name", F.lit(" #"), "p_brand"))
    return table(spark, d, "part").select("p_partkey", k.alias("key")).withColumn("hash", F.substring(strings.fingerprint(F.col("key"), F.lit("x")), 1, 12))


@query(f"WITH {_BOXES} SELECT id, printf('%.4f|%.4f', a, b) AS key FROM b")
def point_key(spark: SparkSession, d: str) -> DataFrame:
    return _boxes(spark, d).select("id", strings.point_key(F.col("a"), F.col("b")).alias("key"))


@query("""SELECT p_partkey, substr(sha1('{"p_brand":"' || p_brand || '","p_size":' || p_size || ',"p_type":"' || p_type || '"}'), 1, 12) AS key FROM part""")
def cache_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", strings.sensor_key(["p_brand", "p_size", "p_type"]).alias("key"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'visit' WHEN 'click' THEN 'visit' ELSE event_type END AS canonical, CASE WHEN event_type = 'view' THEN 'true' WHEN event_type = 'click' THEN 'false' END AS flag,
list_filter(list_transform(string_split('a, ' || event_type || ',,b', ','), lambda x: trim(x)), lambda x: x <> '')[2] AS second FROM events""")
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    name = F.upper(F.col("event_type"))
    flag = F.when(F.col("event_type") == "view", " Yes").when(F.col("event_type") == "click", "OFF").otherwise("maybe")
    items = strings.csv_list(F.concat(F.lit("a, "), "event_type", F.lit(",,b")))
    return table(spark, d, "events").select("event_id", strings.canonical(name, {"view": "visit", "click": "visit"}).alias("canonical"), strings.switch(flag).cast("string").alias("flag"), F.element_at(items, 2).alias("second"))


# Analyses.


@query("""WITH q AS (SELECT a.vec_id AS query, b.vec_id AS other, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, other) AS rank FROM q) SELECT query, other, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    return analytics.cosine_nearest(v.filter("vec_id % 20 = 0"), v, 10).withColumn("sim", _r("sim"))


@query(f"""WITH {_BOXES}, l AS (SELECT s_suppkey AS label_id, (s_suppkey * 91) % 350 - 175.0 AS x, (s_suppkey * 29) % 150 - 75.0 AS y, s_acctbal AS label FROM supplier),
n AS (SELECT id, arg_min((label_id, label), ((a - x) * (a - x) + (b - y) * (b - y), label_id)) AS m FROM b CROSS JOIN l GROUP BY id) SELECT id, m[1] AS label_id, m[2] AS label FROM n""")
def nearest_label(spark: SparkSession, d: str) -> DataFrame:
    p = _boxes(spark, d).select("id", F.col("a").cast("double").alias("lon"), F.col("b").cast("double").alias("lat"))
    k = F.col("s_suppkey")
    labels = table(spark, d, "supplier").select(k.alias("label_id"), ((k * 91) % 350 - 175.0).cast("double").alias("lon"), ((k * 29) % 150 - 75.0).cast("double").alias("lat"), F.col("s_acctbal").alias("label"))
    return analytics.nearest_label(p, labels).select("id", "label_id", "label")


@query("""WITH a AS (SELECT o_custkey AS k, arg_min(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1), b AS (SELECT c_custkey AS k, c_acctbal AS balance FROM customer) SELECT k, price, balance FROM a JOIN b USING (k)""")
def dedup_merge(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("o"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"), F.lit(0).alias("o"))
    return analytics.deduplicated_merge(a, b, "k", "o").select("k", "price", "balance")


@query("""WITH r AS (SELECT DISTINCT ON (result_id) result_id, model, embedding FROM model_results), d AS (SELECT model, max(len(embedding)) AS dim FROM r GROUP BY 1)
SELECT model, CAST(max(dim) AS INTEGER) AS dim, count(*) FILTER (embedding IS NOT NULL AND len(embedding) = dim AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0) AS valid, count(*) AS total,
round(count(*) FILTER (embedding IS NOT NULL AND len(embedding) = dim AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0) / count(*), 6) AS coverage FROM r JOIN d USING (model) GROUP BY model""")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "model_results").groupBy("result_id").agg(F.min_by(F.struct("model", "embedding"), F.struct(F.col("ingested_at").isNull(), "ingested_at")).alias("r")).select("result_id", "r.*")
    return analytics.coverage(r, ["model"], "embedding")


@query("""WITH p AS (SELECT l_returnflag, l_extendedprice AS y, l_quantity * 2500.0 AS p FROM lineitem) SELECT l_returnflag, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(sum((y - p) * (y - p)) / count(*)), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae, count(*) AS n FROM p GROUP BY 1""")
def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2500.0).alias("p"))
    m = analytics.regression_metrics(p, ["l_returnflag"], "y", "p")
    return m.select("l_returnflag", _r("r2").alias("r2"), _r("rmse", 4).alias("rmse"), _r("mae", 4).alias("mae"), "n")


@query("""WITH v AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(covar_pop(a.v, b.v), 5) + 0.0 AS cov FROM v a JOIN v b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY 1, 2""")
def pca_cov(spark: SparkSession, d: str) -> DataFrame:
    return analytics.covariance(table(spark, d, "embeddings"), "embedding").withColumn("cov", _r("cov", 5))


@query()
def pca_components(spark: SparkSession, d: str) -> DataFrame:
    return analytics.pca(table(spark, d, "embeddings"), "vec_id", "embedding")


@query(f"WITH {_GRID}, f AS (SELECT id, y, avg(value) AS v FROM g GROUP BY 1, 2) SELECT id, CAST(y AS INTEGER) AS d, round(v, 6) AS value FROM f")
def feature_vector(spark: SparkSession, d: str) -> DataFrame:
    f = analytics.feature_vector(_grid(spark, d).withColumnRenamed("y", "d"), ["id"])
    return f.select("id", F.posexplode("features").alias("d", "value")).withColumn("value", _r("value"))


# Guards, metadata, labels.


@query("""SELECT result_id, CASE WHEN coalesce(error, '') = '' THEN 'none' WHEN contains(lower(error), 'too many pixels in sample') THEN 'too_large'
WHEN contains(lower(error), 'permission') OR contains(lower(error), 'not authorized') OR contains(lower(error), 'unauthenticated') OR contains(lower(error), 'credentials') THEN 'access' ELSE 'other' END AS kind FROM model_results""")
def error_kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "model_results").select("result_id", guards.error_kind(F.col("error")).alias("kind"))


@query("SELECT p_partkey, sha1('2:' || p_size || ',' || (p_size * 2)) AS digest FROM part")
def array_digest(spark: SparkSession, d: str) -> DataFrame:
    v = F.array("p_size", F.col("p_size") * 2)
    return table(spark, d, "part").select("p_partkey", guards.array_digest(v).alias("digest"))


@query("SELECT model, model_type AS type, CASE WHEN model_type = 'precomputed' THEN 'auto' ELSE 'local' END AS backend, CAST(image_size AS VARCHAR) AS image_size, CAST(dim AS VARCHAR) AS dim FROM model_catalog")
def result_meta(spark: SparkSession, d: str) -> DataFrame:
    back = guards.effective_backend(F.col("model_type"), F.lit(" Local "))
    m = guards.result_meta(model=F.col("model"), type=F.col("model_type"), backend=back, image_size=F.col("image_size"), dim=F.col("dim"))
    return table(spark, d, "model_catalog").select(m.alias("m")).select("m.model", "m.type", "m.backend", "m.image_size", F.col("m.extra")["dim"].alias("dim"))


@query("SELECT l_suppkey AS roi, min(l_discount) >= 0 AND max(l_discount) <= 2 AS scaled, count(*) AS n FROM lineitem GROUP BY 1")
def scaled_guard(spark: SparkSession, d: str) -> DataFrame:
    rows = guards.required(table(spark, d, "lineitem"), "pixels")
    return rows.groupBy(F.col("l_suppkey").alias("roi")).agg(guards.digital_numbers(F.col("l_discount")).alias("scaled"), F.count("*").alias("n"))


@query("SELECT s_suppkey AS id, s_acctbal AS balance FROM supplier WHERE s_nationkey = 7 AND contains(lower(s_name), 'supplier#')")
def label_scan(spark: SparkSession, d: str) -> DataFrame:
    from rasterloom.sources.labels import label_table

    path = scratch(spark, "labels")
    table(spark, d, "supplier").write.option("header", True).csv(path)
    rows = label_table(spark, path, {"s_suppkey": "id", "s_acctbal": "balance", "s_nationkey": "nation", "s_name": "name"}, ("balance",), {"nation": "7"}, {"name": "SUPPLIER#"})
    return rows.select(F.col("id").cast("bigint").alias("id"), "balance")


@query("SELECT c_custkey, printf('p%05d', c_custkey) AS item, CAST(c_custkey AS INTEGER) AS back FROM customer")
def item_names(spark: SparkSession, d: str) -> DataFrame:
    from rasterloom.sources import labels

    rows = labels.item_names(table(spark, d, "customer").select("c_custkey"), "c_custkey")
    return rows.withColumn("back", labels.item_index(F.col("item"), F.lit(None).cast("int")))


@query("SELECT p_partkey, CASE WHEN p_size % 12 = 11 THEN '11' ELSE concat_ws(',', p_size % 12, 11) END AS channels FROM part")
def channel_numbers(spark: SparkSession, d: str) -> DataFrame:
    v = F.array((F.col("p_size") % 12).cast("int"), F.lit(-1), F.lit(40), F.lit(11))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(guards.indices_in(v, 12), lambda i: i.cast("string")), ",").alias("channels"))


@query()
def kmeans_map(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of z-scored features, by the library's own k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    v = table(spark, d, "embeddings").filter("embedding is not null").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("f"))
    z = StandardScaler(inputCol="f", outputCol="features", withMean=True).fit(v).transform(v)
    return KMeans(k=6, seed=1, maxIter=10).fit(z).transform(z).select("vec_id", F.col("prediction").alias("cluster"))


# Models, storage and streams.


@query(f"""WITH {_GRID} SELECT id AS point_index, m AS model, 'ok' AS status, round(CASE m WHEN 'band_mean' THEN avg(value) ELSE max(value) END, 5) AS value FROM g CROSS JOIN (VALUES ('band_mean'), ('band_max')) t(m) GROUP BY id, m""")
def model_stub_infer(spark: SparkSession, d: str) -> DataFrame:
    img = table(spark, d, "embeddings").select(F.col("vec_id").alias("point_index"), F.lit(1).alias("c"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.col("embedding").alias("pixels"))
    made = models.infer(img, ["band_mean", "band_max"])
    return made.select("point_index", "model", "status", _r(F.element_at("embedding", 1), 5).alias("value"))


@query("SELECT model, outputs FROM (VALUES ('band_max', 'pooled'), ('band_mean', 'pooled,grid'), ('cells', 'pooled,grid'), ('cells_south', 'pooled,grid'), ('flat', 'grid')) t(model, outputs)")
def model_list(spark: SparkSession, d: str) -> DataFrame:
    own = models.list_models(spark).filter(F.col("model").isin("band_max", "band_mean", "cells", "cells_south", "flat"))  # callers may add theirs
    return own.select("model", F.array_join("outputs", ",").alias("outputs"))


@query("SELECT vec_id AS point_index, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings")
def npz_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    from rasterloom.sources import npz

    npz.register(spark)
    path = scratch(spark, "npz")
    null = F.lit(None).cast("string")
    rows = table(spark, d, "embeddings").select(F.lit("grid").alias("model"), F.col("vec_id").alias("point_index"), F.lit("ok").alias("status"), null.alias("error"), "embedding", null.alias("meta"))
    rows.write.format("npz").mode("append").save(path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return spark.read.format("npz").load(path).select("point_index", _r(total, 4).alias("total"))


@query(f"""WITH {_SCENES} SELECT band, strftime(time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start, round(avg(value), 4) AS mean, count(value) AS n FROM s GROUP BY 1, 2""")
def stream_window(spark: SparkSession, d: str) -> DataFrame:
    from rasterloom.streaming import composite

    schema = table(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_only(spark, d, "events"))
    w = composite.windowed(source.select("ts", F.col("event_type").alias("band"), "value"), ["band"])
    out, mark = scratch(spark, "stream"), scratch(spark, "mark")
    q = w.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", mark).foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return spark.read.parquet(out).select("band", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), _r("mean", 4).alias("mean"), "n")


def _only(spark: SparkSession, d: str, name: str) -> str:
    """A folder that holds one table: streams read folders, and a table may be a single file."""
    path = scratch(spark, f"scenes-{name}")
    table(spark, d, name).write.parquet(path)
    return path
