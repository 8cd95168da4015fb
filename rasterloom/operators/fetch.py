"""Scans of a table of scene pixels: one composite per request, series, bins, all bands, radar.

``pixels``: ``point_index, collection, band, scene_id, ts, cloud, mode, orbit, y, x, value``; ``requests``: ``point_index,
start, end`` and more. A scan is a join on the region, filters that reach the files, and an aggregate per pixel; images are
put together at the end. A request without scenes is a row with an ``error``, so one region cannot stop the others.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import temporal
from rasterloom.operators import catalog as bands_of
from rasterloom.operators import scan

KEYS = ["point_index", "band", "y", "x"]
#: By name of a collection: how its bands are called, and whether it is filtered by clouds.
FAMILIES = (("COPERNICUS/S2", "S2"), ("LANDSAT/LC08", "L89"), ("LANDSAT/LC09", "L89"), ("LANDSAT/LT04", "L457"), ("LANDSAT/LT05", "L457"), ("LANDSAT/LE07", "L457"))
RADAR = ("VV", "VH")


def family(collection: str) -> str | None:
    return next((f for prefix, f in FAMILIES if collection.upper().startswith(prefix)), None)


def native(collection: str, bands: tuple[str, ...]) -> tuple[str, ...]:
    """Names of bands as the collection has them: aliases in any case, others as they are."""
    known = bands_of.FAMILIES.get(family(collection), {})
    return tuple(known.get(b.upper(), b) for b in bands)


def cleaned(v: Column, fill: float = 0.0) -> Column:
    """No value is the fill value; what is not finite is 0."""
    return F.when(v.isNull(), F.lit(float(fill))).when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(v)


def scenes(pixels: DataFrame, requests: DataFrame, sensor) -> DataFrame:
    """The pixels a request's scan looks at: its region and window, the collection, its bands, and the cloud limit."""
    rows = pixels.filter(F.col("collection") == sensor.collection)
    if sensor.bands:
        rows = rows.filter(F.col("band").isin(*native(sensor.collection, sensor.bands)))
    if sensor.cloudy_pct is not None and family(sensor.collection):
        rows = rows.filter(scan.cloud_ok(F.col("cloud"), sensor.cloudy_pct))
    rows = rows.join(requests.select("point_index", "start", "end"), "point_index")
    inside = (F.col("start").isNull() | (F.col("ts") >= F.col("start"))) & (F.col("end").isNull() | (F.col("ts") < F.col("end")))
    return rows.filter(inside)


def composite(rows: DataFrame, how: str, keys: list[str] = KEYS) -> DataFrame:
    return scan.median_composite(rows, keys).drop("n_scenes") if how == "median" else scan.mosaic_composite(rows, keys, tie="scene_id")


def patch(pixels: DataFrame, requests: DataFrame, sensor) -> DataFrame:
    """``point_index, band, y, x, value`` of each request's composite, cleaned."""
    rows = radar(scenes(pixels, requests, sensor), sensor) if sensor.modality == "s1" else scenes(pixels, requests, sensor)
    return composite(rows, sensor.composite).withColumn("value", cleaned(F.col("value"), sensor.fill_value))


def radar(rows: DataFrame, sensor) -> DataFrame:
    """Dual-polarised scenes of the wanted orbit: in IW mode, or in any where a request has none and that is allowed."""
    if sensor.orbit:
        wish = sensor.orbit.strip().upper()
        if wish not in ("ASCENDING", "DESCENDING"):
            raise ValueError(f"an orbit is ascending or descending, not {sensor.orbit!r}")
        rows = rows.filter(F.upper("orbit") == wish)
    both = rows.groupBy("point_index", "scene_id").agg(F.collect_set(F.when(F.col("band").isin(*RADAR), F.col("band"))).alias("bands"), F.first("mode").alias("mode"))
    if not sensor.require_iw:
        good = both.filter(scan.dual_pol(F.col("bands"), F.col("mode"), False))
    elif sensor.relax_iw:
        good = scan.dual_pol_relaxed(both, ["point_index"])
    else:
        good = both.filter(scan.dual_pol(F.col("bands"), F.col("mode"), True))
    return rows.filter(F.col("band").isin(*RADAR)).join(good.select("point_index", "scene_id"), ["point_index", "scene_id"], "left_semi")


def radar_meta(pixels: DataFrame, requests: DataFrame, sensor) -> DataFrame:
    """``point_index, base, iw, vv, vh, vh_no_iw, iw_requested, iw_applied, iw_relaxed, orbit, collection``: how many
    scenes each condition leaves, and what was applied."""
    every = dataclasses.replace(sensor, bands=())  # scenes of other polarisations count among all
    s = scenes(pixels, requests, every).groupBy("point_index", "scene_id").agg(F.collect_set("band").alias("bands"), F.first("mode").alias("mode"), F.first("orbit").alias("orbit"))
    if sensor.orbit:
        s = s.filter(F.upper("orbit") == sensor.orbit.strip().upper())
    has = lambda b: F.array_contains("bands", b)
    iw = F.col("mode") == "IW"
    n = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    rows = s.groupBy("point_index").agg(F.count("*").alias("base"), n(iw).alias("iw"), n(iw & has("VV")).alias("vv"), n(iw & has("VV") & has("VH")).alias("vh"), n(has("VV") & has("VH")).alias("vh_no_iw"))
    rows = requests.select("point_index").join(rows, "point_index", "left").fillna(0)
    relaxed = F.lit(sensor.require_iw and sensor.relax_iw) & (F.col("vh") == 0) & (F.col("vh_no_iw") > 0)
    return rows.select("*", F.lit(sensor.require_iw).alias("iw_requested"), (F.lit(sensor.require_iw) & ~relaxed).alias("iw_applied"), relaxed.alias("iw_relaxed"), F.lit(sensor.orbit).alias("orbit"), F.lit(sensor.collection).alias("collection"))


def assembled(values: DataFrame, bands: tuple[str, ...], keys: tuple[str, ...] = ("point_index",), collection: str = "", fill: float = 0.0, flip: bool = False) -> DataFrame:
    """Images ``keys, c, h, w, pixels`` of ``keys, band, y, x, value``: bands in the order asked for, missing pixels
    ``fill``, rows turned round with ``flip``. A missing band leaves ``pixels`` null and says so in ``error``."""
    order = native(collection, bands) if collection else tuple(bands)
    at = F.array_position(F.array(*map(F.lit, order)), F.col("band")) - 1
    rows = values.withColumn("b", at.cast("int")).filter("b >= 0")
    size = rows.groupBy(*keys).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), F.collect_set("band").alias("have"))
    y = F.col("h") - 1 - F.col("y") if flip else F.col("y")
    cells = rows.join(size.select(*keys, "h", "w"), list(keys)).select(*keys, ((F.col("b") * F.col("h") + y) * F.col("w") + F.col("x")).cast("int").alias("k"), F.col("value").cast("double").alias("v"))
    flat = cells.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    missing = F.array_except(F.array(*map(F.lit, order)), F.col("have"))
    n = F.lit(len(order)) * F.col("h") * F.col("w")
    values_ = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(float(fill))))
    whole = F.size(missing) == 0
    error = F.when(~whole, F.concat(F.lit("no band "), F.array_join(missing, ", "), F.lit("; there are "), F.array_join(F.array_sort("have"), ", ")))
    return size.join(flat, list(keys)).select(*keys, F.lit(len(order)).alias("c"), F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), F.when(whole, values_).alias("pixels"), error.alias("error"))


def gridded(samples: DataFrame, requests: DataFrame, scale_m: float) -> DataFrame:
    """``point_index, band, y, x, value``: samples (``point_index, lon, lat, band, value``) on the Web Mercator pixels of
    ``scale_m`` of each request's box, row 0 in the north; several in one pixel are averaged, those outside are cut off."""
    from rasterloom.functions import spatial

    x0, x1 = spatial.mercator_x(F.col("minlon")), spatial.mercator_x(F.col("maxlon"))
    y0, y1 = spatial.mercator_y(F.col("minlat")), spatial.mercator_y(F.col("maxlat"))
    boxes = requests.select("point_index", x0.alias("__x0"), y1.alias("__y1"), F.ceil((x1 - x0) / scale_m).alias("__w"), F.ceil((y1 - y0) / scale_m).alias("__h"))
    rows = samples.join(boxes, "point_index")
    rows = rows.withColumn("x", F.floor((spatial.mercator_x(F.col("lon")) - F.col("__x0")) / scale_m).cast("int")).withColumn("y", F.floor((F.col("__y1") - spatial.mercator_y(F.col("lat"))) / scale_m).cast("int"))
    inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < F.col("__w")) & (F.col("y") < F.col("__h"))
    return rows.filter(inside).groupBy(*KEYS).agg(F.avg("value").alias("value"))


def every_band(pixels: DataFrame, requests: DataFrame, collection: str, how: str = "median", fill: float = 0.0) -> DataFrame:
    """``point_index, bands, c, h, w, pixels`` of all bands there are, sorted by name, without a cloud limit."""
    rows = pixels.filter(F.col("collection") == collection).join(requests.select("point_index", "start", "end"), "point_index")
    rows = composite(rows.filter((F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end"))), how).withColumn("value", cleaned(F.col("value"), fill))
    size = rows.groupBy("point_index").agg(F.array_sort(F.collect_set("band")).alias("bands"), (F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    k = ((F.array_position("bands", F.col("band")) - 1) * F.col("h") + F.col("y")) * F.col("w") + F.col("x")
    flat = rows.join(size, "point_index").groupBy("point_index").agg(F.map_from_entries(F.collect_list(F.struct(k.cast("int").alias("k"), "value"))).alias("m"))
    n = F.size("bands") * F.col("h") * F.col("w")
    values = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(float(fill))))
    return size.join(flat, "point_index").select("point_index", "bands", F.size("bands").alias("c"), F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), values.alias("pixels"))


def binned(pixels: DataFrame, requests: DataFrame, sensor, bins: Column) -> DataFrame:
    """``point_index, band, y, x, k, start, end, value, empty``: a composite per bin of ``bins`` (an array column of
    ``requests``); an empty bin's values are null. ``error`` where all bins are empty."""
    rows = scenes(pixels, requests, sensor)
    rows = radar(rows, sensor) if sensor.modality == "s1" else rows
    windows = requests.select("point_index", bins.alias("bins"))
    out = scan.binned(rows.drop("start", "end"), windows, KEYS, "point_index")
    any_ = out.groupBy("point_index").agg(F.min(F.col("empty").cast("int")).alias("none"))
    return out.join(any_, "point_index").withColumn("error", F.when(F.col("none") == 1, "no scene in any bin")).drop("none")


def series(pixels: DataFrame, requests: DataFrame, sensor, n: int) -> DataFrame:
    """``point_index, band, y, x, k, value, source``: ``n`` equal bins of the window; an empty one has the whole window's
    composite, else the nearest bin's. Optical values are clipped to 0..10000."""
    own = scenes(pixels, requests, sensor)
    bins = binned(pixels, requests, sensor, temporal.equal_bins(F.col("start"), F.col("end"), n)).drop("error")
    whole = composite(own.drop("start", "end"), sensor.composite).withColumnRenamed("value", "whole")
    out = scan.backfilled(bins, KEYS, whole)
    v = F.col("filled")
    v = F.least(F.greatest(v, F.lit(0.0)), F.lit(10000.0)) if family(sensor.collection) else v
    return out.select(*KEYS, "k", cleaned(v, sensor.fill_value).alias("value"), "source")


def frame_plan(windows: DataFrame, stride_days: int = 30, most: int = 12, manual: int | None = None) -> DataFrame:
    """``windows`` (``start, end``) with ``mode`` (``single``, ``manual``, ``auto``), ``bins`` and ``effective_stride_days``
    (null unless the window is too long for ``most`` bins of the stride)."""
    if manual is not None:
        bins = temporal.equal_bins(F.col("start"), F.col("end"), manual)
        return windows.withColumn("mode", F.lit("manual" if manual > 1 else "single")).withColumn("bins", bins).withColumn("effective_stride_days", F.lit(None).cast("double"))
    p = windows.withColumn("p", temporal.fixed_or_equal_bins(F.col("start"), F.col("end"), stride_days, most))
    days = F.datediff("end", "start")
    stride = F.when(F.col("p.stretched"), F.round(days / F.size("p.bins"), 3))
    return p.withColumn("bins", F.col("p.bins")).withColumn("mode", F.when(F.size("bins") > 1, "auto").otherwise("single")).withColumn("effective_stride_days", stride).drop("p")


def without_empty(frames: DataFrame, keys: list[str]) -> DataFrame:
    """``frames`` (``keys, k, empty``) that are not empty, counted anew from 0, with the list ``dropped`` of those that are."""
    gone = frames.groupBy(*keys).agg(F.array_sort(F.collect_set(F.when(F.col("empty"), F.col("k")))).alias("dropped"))
    return frames.filter(~F.col("empty")).join(gone, keys).withColumn("t", F.col("k") - F.size(F.filter("dropped", lambda d: d < F.col("k"))))


def split_parts(boxes: DataFrame, limit: int, scale_m: float, depth: int = 12) -> DataFrame:
    """``boxes`` (``roi_id, minlon, minlat, maxlon, maxlat``) halved at the Mercator midpoint of the longer side until no
    part has more than ``limit`` pixels: with ``path`` (``0`` and ``1`` per halving), ``h``, ``w`` and ``error`` beyond ``depth``."""
    from rasterloom.functions import spatial

    c = ["minlon", "minlat", "maxlon", "maxlat"]
    span = spatial.pixel_span(*[F.col(x) for x in c], scale_m)
    rows = boxes.select("roi_id", *c, F.lit("").alias("path"))
    for _ in range(depth):
        halves = spatial.split_box(*[F.col(x) for x in c])
        cut = F.transform(halves, lambda p, i: F.struct(*[p[x].alias(x) for x in c], F.concat(F.col("path"), i.cast("string")).alias("path")))
        whole = F.array(F.struct(*[F.col(x) for x in c], "path"))
        rows = rows.select("roi_id", F.explode(F.when(span["h"] * span["w"] > limit, cut).otherwise(whole)).alias("p")).select("roi_id", "p.*")
    rows = rows.withColumn("h", span["h"]).withColumn("w", span["w"])
    return rows.withColumn("error", F.when(F.col("h") * F.col("w") > limit, F.lit(f"more than {limit} pixels after {depth} halvings")))


def joined_halves(a: DataFrame, b: DataFrame, axis: str, targets: DataFrame, most: int = 4, fill: float = 0.0) -> DataFrame:
    """Two halves of images (``point_index, band, y, x, value``) put together along ``axis`` to ``target`` cells
    (``targets``: ``point_index, target``).

    Up to ``most`` cells too many are dropped, half from the end of the first and the rest from the start of the second;
    as many too few are filled; beyond that ``raise_error``.
    """
    size = lambda df, n: df.groupBy("point_index").agg((F.max(axis) + 1).alias(n))
    plan = size(a, "na").join(size(b, "nb"), "point_index").join(targets, "point_index").withColumn("over", F.col("na") + F.col("nb") - F.col("target"))
    plan = plan.withColumn("over", F.when(F.abs("over") <= most, F.col("over")).otherwise(F.raise_error(F.concat(F.lit("halves don't make the whole: "), F.col("na"), F.lit(" and "), F.col("nb"), F.lit(" for "), F.col("target")))))
    head = F.floor(F.greatest("over", F.lit(0)) / 2).cast("int")
    tail = F.greatest("over", F.lit(0)) - head
    gap = F.greatest(-F.col("over"), F.lit(0))
    cols = ["point_index", "band", "y", "x", "value"]
    left = a.join(plan, "point_index").filter(F.col(axis) < F.col("na") - head).select(*cols)
    right = b.join(plan, "point_index").filter(F.col(axis) >= tail).withColumn(axis, (F.col(axis) - tail + F.col("na") - head + gap).cast("int")).select(*cols)
    edge = a.join(plan.filter(gap > 0), "point_index").filter(F.col(axis) == F.col("na") - 1)
    filled = edge.withColumn("g", F.explode(F.sequence(F.lit(1), gap))).withColumn(axis, (F.col(axis) + F.col("g")).cast("int")).withColumn("value", F.lit(float(fill))).select(*cols)
    return left.unionByName(right).unionByName(filled)
