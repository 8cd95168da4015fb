"""Tiles that cover an image, the pixels each owns, and windows on grids, as Column expressions over integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def starts(dim: Column, tile: int) -> Column:
    """Where tiles begin along an axis: one per ``tile`` pixels, the last moved back to end with the image."""
    n = F.ceil(dim / tile).cast("int")
    at = lambda i: F.least(i * tile, F.greatest(dim - tile, F.lit(0))).cast("int")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), at))


def count(h: Column, w: Column, tile: int, stride: int) -> Column:
    side = lambda d: F.when(d <= tile, 1).otherwise(F.ceil((d - tile) / stride) + 1)
    return (side(h) * side(w)).cast("int")


def snapped(dim: Column, tile: int, share: float) -> Column:
    """The axis without a small rest beyond whole tiles: at most ``share`` of a tile, rounded half to even."""
    rest = dim % tile
    return F.when((dim > tile) & (rest > 0) & (rest <= F.bround(F.lit(share * tile), 0)), dim - rest).otherwise(dim)


def budget(n: Column, soft: int = 64, hard: int = 1024) -> Column:
    return F.when(n > hard, "error").when(n > soft, "warn").otherwise("ok")


def layout(images: DataFrame, tile: int, key: str = "roi_id") -> DataFrame:
    """``key, row, col, y0, y1, x0, x1``: the tiles of images ``key, h, w``, clipped to the image."""
    ys = images.select(key, "h", "w", F.posexplode(starts(F.col("h"), tile)).alias("row", "y0"))
    both = ys.select("*", F.posexplode(starts(F.col("w"), tile)).alias("col", "x0"))
    return both.select(key, "h", "w", "row", "col", "y0", F.least("h", F.col("y0") + tile).alias("y1"), "x0", F.least("w", F.col("x0") + tile).alias("x1"))


def owned(axis: DataFrame, key: str = "roi_id") -> DataFrame:
    """``axis`` (``key, i, start, end``) with ``own_start, own_end``: neighbours meet halfway through their overlap,
    outer edges stay; a tile always owns a pixel. Needs intervals without gaps: :func:`gaps` finds those with."""
    w = Window.partitionBy(key).orderBy("start", "end", "i")
    s = F.coalesce(F.floor((F.lag("end").over(w) + F.col("start")) / 2), F.col("start")).cast("int")
    e = F.coalesce(F.floor((F.col("end") + F.lead("start").over(w)) / 2), F.col("end")).cast("int")
    return axis.withColumn("own_start", s).withColumn("__e", e).withColumn("own_end", F.greatest("__e", F.col("own_start") + 1)).drop("__e")


def gaps(axis: DataFrame, key: str = "roi_id") -> DataFrame:
    w = Window.partitionBy(key).orderBy("start", "end", "i")
    return axis.withColumn("__p", F.lag("end").over(w)).filter(F.col("start") > F.col("__p")).drop("__p")


def crops(axis: DataFrame, out_len: int, tile: int, key: str = "roi_id") -> DataFrame:
    """``key, i, fs, fe, offset``: which of a tile's ``out_len`` feature cells it gives to the stitched axis.

    Each tile begins where the cells of the one before it ended, not at its own rounded border, so no cell is doubled
    or lost: a fold over the ordered tiles of an axis (a handful per image).
    """
    rows = owned(axis, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "i", "own_start", "own_end"))).alias("t"))
    n = F.lit(out_len)

    def step(acc: Column, t: Column) -> Column:
        begin = F.coalesce(acc["cut"], t["own_start"].cast("double"))
        span = F.lit(float(tile))
        fs = F.greatest(F.least(F.floor((begin - t["start"]) / span * n), n - 1), F.lit(0)).cast("int")
        x = (t["own_end"] - t["start"]) / span * n
        last = F.size(acc["out"]) + 1 == acc["n"]
        fe = F.when(last, F.ceil(x)).otherwise(F.floor(x + 0.5))
        fe = F.greatest(F.least(fe, n), fs + 1).cast("int")
        row = F.struct(t["i"].alias("i"), fs.alias("fs"), fe.alias("fe"), acc["offset"].alias("offset"))
        return F.struct((t["start"] + fe * span / n).alias("cut"), (acc["offset"] + fe - fs).alias("offset"), acc["n"].alias("n"), F.concat(acc["out"], F.array(row)).alias("out"))

    first = F.struct(F.lit(None).cast("double").alias("cut"), F.lit(0).alias("offset"), F.size("t").alias("n"), F.array().cast("array<struct<i:int,fs:int,fe:int,offset:int>>").alias("out"))
    return rows.select(key, F.explode(F.aggregate("t", first, step, lambda a: a["out"])).alias("c")).select(key, "c.*")


def overlap_weight(own_y0: Column, own_y1: Column, own_x0: Column, own_x1: Column, roi: tuple[float, float, float, float] | None, h: Column, w: Column) -> Column:
    """A tile's weight in a pooled merge: its owned area, or what of it lies in the window ``(y0, y1, x0, x1)``."""
    if roi is None:
        return (F.greatest(F.lit(1), own_y1 - own_y0) * F.greatest(F.lit(1), own_x1 - own_x0)).cast("double")
    side = lambda a, b, lo, hi: F.greatest(F.lit(0.0), F.least(b, hi) - F.greatest(a, lo))
    return side(own_y0, own_y1, roi[0] * h, roi[1] * h) * side(own_x0, own_x1, roi[2] * w, roi[3] * w)


def token_box(roi: tuple[float, float, float, float], h: int, w: int) -> tuple[int, int, int, int]:
    """Grid cells of a window: outwards to whole cells, at least one."""
    import math

    def side(a: float, b: float, n: int) -> tuple[int, int]:
        lo = min(max(math.floor(a * n), 0), n - 1)
        return lo, min(max(math.ceil(b * n), lo + 1), n)

    return (*side(roi[0], roi[1], h), *side(roi[2], roi[3], w))


def full(roi: tuple[float, float, float, float] | None, eps: float = 1e-6) -> bool:
    return roi is None or (roi[0] <= eps and roi[2] <= eps and roi[1] >= 1 - eps and roi[3] >= 1 - eps)


def side_unit(scale_m: int, patch: int, gsds: list[int]) -> int:
    """The side lengths valid for all resolutions are multiples of this."""
    import math

    return math.lcm(*[patch * g // math.gcd(scale_m, patch * g) for g in gsds])


def snapped_side(side: Column, unit: int) -> Column:
    """The nearest multiple of ``unit``, the lower of two as near, at least one."""
    low = F.floor(side / unit) * unit
    return F.greatest(F.when(side - low > unit - (side - low), low + unit).otherwise(low), F.lit(unit)).cast("int")
