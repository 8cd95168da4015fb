"""Pooling of grids and tokens; merging of tiles and groups. Grids are long tables ``roi, d, y, x, value``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.tiles import full, token_box


def as_grid(vectors: DataFrame, width: int, key: str, vec: str) -> DataFrame:
    """``key, y, x, value`` of flat row-major grids."""
    rows = vectors.select(key, F.posexplode(vec).alias("pos", "v"))
    return rows.select(key, F.floor(F.col("pos") / width).cast("int").alias("y"), (F.col("pos") % width).alias("x"), F.col("v").cast("double").alias("value"))


def pooled(grid: DataFrame, keys: list[str], pooling: str = "mean", value: str = "value") -> DataFrame:
    how = {"mean": F.avg, "max": F.max}[pooling]
    return grid.groupBy(*keys).agg(how(value).alias("value"))


def pooled_valid(grid: DataFrame, keys: list[str], nodata: Column, pooling: str = "mean") -> DataFrame:
    """Values that are ``nodata`` are left out; ``n_valid`` 0 and a null value where all are."""
    how = {"mean": F.avg, "max": F.max}[pooling]
    v = F.when(~nodata, F.col("value"))
    return grid.groupBy(*keys).agg(how(v).alias("value"), F.count(v).alias("n_valid"), F.avg(nodata.cast("int")).alias("nodata_share"))


def has_cls(n: Column) -> Column:
    """A first token that is no patch: without it the rest is a square."""
    root = F.floor(F.sqrt((n - 1).cast("double")) + 0.5)
    return (n > 1) & (root * root == n - 1)


def pooled_tokens(tokens: DataFrame, keys: list[str], pooling: str = "mean") -> DataFrame:
    """Of ``keys, pos, d, value`` the patch tokens by dimension; the only token where there is no patch."""
    n = tokens.groupBy(*keys).agg((F.max("pos") + 1).alias("n"))
    how = {"mean": F.avg, "max": F.max}[pooling]
    rows = tokens.join(n, keys).filter((F.col("pos") > 0) | ~has_cls(F.col("n")))
    return rows.groupBy(*keys, "d").agg(how("value").alias("value"))


def token_grid(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, d, y, x, value`` of square token matrices, without a leading token; others are left out."""
    n = tokens.groupBy(*keys).agg((F.max("pos") + 1).alias("n"))
    cls = has_cls(F.col("n")).cast("int")
    side = F.floor(F.sqrt((F.col("n") - cls).cast("double")) + 0.5).cast("int")
    rows = tokens.join(n, keys).withColumn("__p", F.col("pos") - cls).withColumn("__s", side)
    rows = rows.filter((F.col("__p") >= 0) & (F.col("__s") * F.col("__s") == F.col("n") - cls))
    return rows.select(*keys, "d", F.floor(F.col("__p") / F.col("__s")).cast("int").alias("y"), (F.col("__p") % F.col("__s")).alias("x"), "value")


def frame_tokens(tokens: DataFrame, keys: list[str], n_frames: int, per_cell: bool, pooling: str = "mean") -> DataFrame:
    """Tokens of ``n_frames`` equal frames (a leading token, where the count needs it, is left out) over all of them,
    or per grid cell over time."""
    n = tokens.groupBy(*keys).agg((F.max("pos") + 1).alias("n"))
    rows = tokens.join(n, keys)
    skip = F.when(F.col("n") % n_frames == 1, 1).otherwise(0) if n_frames > 1 else has_cls(F.col("n")).cast("int")
    rows = rows.withColumn("__p", F.col("pos") - skip).withColumn("cell", F.col("__p") % F.floor((F.col("n") - skip) / n_frames).cast("int")).filter("__p >= 0")
    how = {"mean": F.avg, "max": F.max}[pooling]
    return rows.groupBy(*keys, *(["cell"] if per_cell else []), "d").agg(how("value").alias("value"))


def group_merged(tokens: DataFrame, keys: list[str], cells: int, pooling: str = "mean") -> DataFrame:
    """Groups of ``cells`` tokens each, merged cell by cell: ``keys, cell, value``."""
    how = {"mean": F.avg, "max": F.max, "sum": F.sum}[pooling]
    return tokens.groupBy(*keys, (F.col("pos") % cells).alias("cell")).agg(how("value").alias("value"))


def cropped(grid: DataFrame, roi: tuple[float, float, float, float], h: int, w: int) -> DataFrame:
    """The cells of a window of fractions, counted anew from its corner; a full window changes nothing."""
    if full(roi):
        return grid
    y0, y1, x0, x1 = token_box(roi, h, w)
    inside = (F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1)
    return grid.filter(inside).withColumn("y", F.col("y") - y0).withColumn("x", F.col("x") - x0)


def north_up(grid: DataFrame, h: Column, flip: Column) -> DataFrame:
    """Row 0 is north: rows of grids that run from south to north are turned round."""
    return grid.withColumn("y", F.when(flip, h - 1 - F.col("y")).otherwise(F.col("y")))


def tile_merged(tiles: DataFrame, keys: list[str], pooling: str = "mean", value: str = "value", weight: str = "weight") -> DataFrame:
    """One value per key of its tiles' values: weighted mean, or the maximum of tiles of some weight (of all, where
    none has any)."""
    if pooling == "mean":
        total = F.sum(weight)
        plain = F.avg(value)
        return tiles.groupBy(*keys).agg(F.when(total > 0, F.sum(F.col(weight) * F.col(value)) / F.greatest(F.lit(1.0), total)).otherwise(plain).alias("value"))
    return tiles.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col(weight) > 0, F.col(value))), F.max(value)).alias("value"))


def stitched(cells: DataFrame, rows: DataFrame, cols: DataFrame, key: str = "roi_id") -> DataFrame:
    """``key, d, y, x, value`` from tile grids (``key, row, col, d, y, x, value``) and the crops of both axes.

    A crop says which cells of a tile count and where they go; each cell of the result comes from one tile.
    """
    r = rows.select(key, F.col("i").alias("row"), F.col("fs").alias("ys"), F.col("fe").alias("ye"), F.col("offset").alias("yo"))
    c = cols.select(key, F.col("i").alias("col"), F.col("fs").alias("xs"), F.col("fe").alias("xe"), F.col("offset").alias("xo"))
    kept = cells.join(r, [key, "row"]).filter("y >= ys and y < ye").join(c, [key, "col"]).filter("x >= xs and x < xe")
    return kept.select(key, "d", (F.col("y") - F.col("ys") + F.col("yo")).alias("y"), (F.col("x") - F.col("xs") + F.col("xo")).alias("x"), "value")


def split_stitch(a: int, b: int, target: int, most: int = 4) -> tuple[int, int, int]:
    """Two halves of ``a`` and ``b`` cells for ``target``: cells to drop from the end of the first and the start of
    the second, or to fill between. ValueError beyond ``most``."""
    over = a + b - target
    if abs(over) > most:
        raise ValueError(f"halves of {a} and {b} don't make {target}")
    return (over // 2, over - over // 2, 0) if over > 0 else (0, 0, -over)


def square(n: int) -> bool:
    return math.isqrt(n) ** 2 == n
