"""Scenes to composites: filters, time bins, back-fill, footprints.

Pixels are a long table ``roi, band, ts, value, id`` (``id`` makes orders total). Bins are an array on the window's
row, so a scene finds its bin without a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_window(ts: Column, start: Column | str, end: Column | str) -> Column:
    """``ts`` in [start, end)."""
    at = lambda v: F.lit(v).cast("timestamp_ntz") if isinstance(v, str) else v
    return (ts >= at(start)) & (ts < at(end))


def cloud_ok(cloud: Column, most: float | None, family: Column | None = None, known: tuple[str, ...] = ("S2", "LANDSAT")) -> Column:
    """Scenes of a known family need a cloud share of at most ``most``, null is out; others are not filtered."""
    if most is None:
        return F.lit(True)
    ok = F.coalesce(cloud <= most, F.lit(False))
    return ok if family is None else F.when(family.isin(*known), ok).otherwise(F.lit(True))


def dual_pol(bands: Column, mode: Column, require_iw: bool = True) -> Column:
    both = F.array_contains(bands, "VV") & F.array_contains(bands, "VH")
    return both & (mode == "IW") if require_iw else both


def dual_pol_relaxed(scenes: DataFrame, keys: list[str]) -> DataFrame:
    """Dual-polarised scenes in IW mode; where a key has none, those in any mode. ``iw_relaxed`` says which."""
    some = scenes.filter(dual_pol(F.col("bands"), F.col("mode"), False))
    have = some.groupBy(*keys).agg(F.max((F.col("mode") == "IW").cast("int")).alias("__iw"))
    return some.join(have, keys).filter((F.col("__iw") == 0) | (F.col("mode") == "IW")).withColumn("iw_relaxed", F.col("__iw") == 0).drop("__iw")


def median_composite(pixels: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return pixels.groupBy(*keys).agg(F.median(value).alias("value"), F.count(value).alias("n_scenes"))


def mosaic_composite(pixels: DataFrame, keys: list[str], value: str = "value", ts: str = "ts", tie: str = "id") -> DataFrame:
    """The latest valid value wins."""
    return pixels.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, F.struct(ts, tie)).alias("value"))


def binned(pixels: DataFrame, windows: DataFrame, keys: list[str], roi: str = "roi", ts: str = "ts", value: str = "value") -> DataFrame:
    """``keys, k, start, end, value, empty``: the median of each bin, every bin of a window for each of its keys.

    ``windows``: ``roi, bins array<struct<k,start,end>>``. A bin without a scene is empty, its value null.
    """
    d = F.to_date(ts)
    hit = F.try_element_at(F.filter("bins", lambda b: (b["start"] <= d) & (d < b["end"])), F.lit(1))
    rows = pixels.join(windows, roi).withColumn("k", hit["k"])
    found = rows.filter(F.col("k").isNotNull()).groupBy(*keys, "k").agg(F.median(value).alias("value"), F.count("*").alias("__n"))
    grid = pixels.select(*keys).distinct().join(windows, roi).select(*keys, F.explode("bins").alias("b")).select(*keys, "b.k", "b.start", "b.end")
    return grid.join(found, [*keys, "k"], "left").withColumn("empty", F.col("__n").isNull()).drop("__n")


def backfilled(bins: DataFrame, keys: list[str], whole: DataFrame | None = None) -> DataFrame:
    """``bins`` with ``filled`` and ``source``: own value, else that of the whole window (``keys, whole``), else that
    of the nearest bin with a value, the earlier of two as near; null where no bin has one."""
    some = bins.filter(F.col("value").isNotNull()).groupBy(*keys).agg(F.collect_list(F.struct("k", "value")).alias("have"))
    rows = bins.join(some, keys, "left")
    near = F.array_min(F.transform("have", lambda h: F.struct(F.abs(h["k"] - F.col("k")).alias("d"), h["k"].alias("k"), h["value"].alias("v"))))["v"]
    if whole is None:
        rows = rows.withColumn("whole", F.lit(None).cast("double"))
    else:
        rows = rows.join(whole, keys, "left")
    filled = F.coalesce("value", "whole", near)
    source = F.when(F.col("value").isNotNull(), "own").when(F.col("whole").isNotNull(), "window").when(near.isNotNull(), "nearest").otherwise("none")
    return rows.withColumn("filled", filled).withColumn("source", source).drop("have", "whole")


def footprint_join(rois: DataFrame, scenes: DataFrame, cell: float, roi: str = "roi_id", scene: str = "scene_id") -> DataFrame:
    """Pairs whose rectangles (``minx, miny, maxx, maxy``) share some area.

    Both sides go to the grid cells they touch and meet there by an equi-join; a pair in several cells counts in the
    one that holds the lower corner of its intersection, so nothing is made distinct afterwards.
    """

    def placed(df: DataFrame, key: str, p: str) -> DataFrame:
        at = lambda c: F.floor(F.col(c) / cell).cast("int")
        xs, ys = F.sequence(at("minx"), at("maxx")), F.sequence(at("miny"), at("maxy"))
        df = df.select(key, "minx", "miny", "maxx", "maxy", F.explode(xs).alias("cx")).withColumn("cy", F.explode(ys))
        return df.select(F.col(key), *[F.col(c).alias(f"{p}_{c}") for c in ("minx", "miny", "maxx", "maxy")], "cx", "cy")

    from rasterloom.functions.spatial import overlaps

    both = placed(rois, roi, "a").join(placed(scenes, scene, "b"), ["cx", "cy"]).filter(overlaps("a", "b"))
    first = (F.floor(F.greatest("a_minx", "b_minx") / cell) == F.col("cx")) & (F.floor(F.greatest("a_miny", "b_miny") / cell) == F.col("cy"))
    area = (F.least("a_maxx", "b_maxx") - F.greatest("a_minx", "b_minx")) * (F.least("a_maxy", "b_maxy") - F.greatest("a_miny", "b_miny"))
    return both.filter(first).select(roi, scene, area.alias("area"))


def product_mosaic(tiles: DataFrame, keys: list[str], order: str, value: str = "value") -> DataFrame:
    """Of overlapping product tiles the later one's pixel; a gap (null in all) is 0."""
    return tiles.groupBy(*keys).agg(F.coalesce(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))), F.lit(0.0)).alias("value"))


def scan_parts(rois: DataFrame, max_pixels: int) -> DataFrame:
    """``roi_id, part, y0, y1, x0, x1``: rows of ``roi_id, h, w`` cut beforehand so that no part has more pixels."""
    side = F.greatest(F.floor(F.sqrt(F.lit(float(max_pixels)))), F.lit(1)).cast("int")
    cuts = lambda d: F.sequence(F.lit(0), F.ceil(F.col(d) / side).cast("int") - 1)
    rows = rois.select("roi_id", "h", "w", F.explode(cuts("h")).alias("i")).withColumn("j", F.explode(cuts("w")))
    end = lambda i, d: F.least(F.col(d), (F.col(i) + 1) * side)
    return rows.select("roi_id", (F.col("i") * F.ceil(F.col("w") / side) + F.col("j")).cast("int").alias("part"), (F.col("i") * side).alias("y0"), end("i", "h").alias("y1"), (F.col("j") * side).alias("x0"), end("j", "w").alias("x1"))


def frames_meta(frames: DataFrame, key: str = "roi", t: str = "t", frame: str = "frame") -> DataFrame:
    """``key, n_frames, n_distinct``: equal frames are back-filled ones."""
    return frames.groupBy(key).agg(F.count("*").alias("n_frames"), F.countDistinct(frame).alias("n_distinct"))


def first_frames(frames: DataFrame, key: str = "roi", t: str = "t", frame: str = "frame") -> DataFrame:
    """Each distinct frame once, with its first date."""
    return frames.groupBy(key, frame).agg(F.min(t).alias(t))


def spacing(dates: DataFrame, key: str, d: str, most: int = 184) -> DataFrame:
    """``key, max_gap_days, out_of_range``: the longest gap between neighbouring dates, 0 for fewer than two."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(d)
    gap = F.datediff(F.col(d), F.lag(d).over(w))
    return dates.select(key, d).distinct().withColumn("__g", gap).groupBy(key).agg(F.coalesce(F.max("__g"), F.lit(0)).alias("max_gap_days")).withColumn("out_of_range", F.col("max_gap_days") > most)
