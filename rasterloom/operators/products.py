"""Embedding products that are read, not computed: annual composites, tile registries, degree grids; and proxy channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import radiometry
from rasterloom.operators import scan

NODATA = -9999.0
DEFAULT_YEAR = 2021
# Least and greatest brightness temperatures (K) of the emissive channels, and the order of all channels.
EMISSIVE = ((223.1222, 352.7182), (178.9174, 261.2920), (204.3739, 282.5529), (204.7677, 319.0373), (194.8686, 295.0209), (202.1759, 324.0677), (201.3823, 321.5254), (203.3537, 285.9848))
REFLECTIVE = ("sur_refl_b01", "sur_refl_b02", "sur_refl_b03", "sur_refl_b04", "sur_refl_b06", "sur_refl_b07")
PROXY = ("r0", "r1", "r2", "r3", "r4", "t0", "r5", "t1", "t2", "t3", "t4", "t5", "t6", "t7")


def product_year(start: Column, year: Column | None = None, default: int = DEFAULT_YEAR) -> Column:
    """A request's year: its own, else that of its start, else the default."""
    own = F.year(start)
    return F.coalesce(own if year is None else F.coalesce(year, own), F.lit(default)).cast("int")


def annual(cells: DataFrame, requests: DataFrame, nodata: float = NODATA) -> DataFrame:
    """``point_index, year, d, y, x, value, nodata_share`` of the annual product (``point_index, year, d, y, x, value``).

    Fill values are null; ``nodata_share`` is that of dimension 0. A request without a year is a row with an ``error``.
    """
    asked = requests.select("point_index", F.col("year").cast("int").alias("year"))
    v = F.when(F.col("value") != nodata, F.col("value"))
    share = F.avg(F.when(F.col("d") == 0, F.isnull(v).cast("int")))
    rows = cells.join(asked, ["point_index", "year"]).withColumn("value", v)
    bare = rows.groupBy("point_index").agg(share.alias("nodata_share"))
    out = asked.join(rows.join(bare, "point_index"), ["point_index", "year"], "left")
    return out.withColumn("error", F.when(F.col("year").isNull(), "a year is needed").when(F.col("d").isNull(), "no cells of that year"))


def product_pooled(cells: DataFrame, pooling: str = "mean") -> DataFrame:
    """``point_index, embedding, error`` of :func:`annual`: per dimension over what is no fill value; an error where a
    dimension has nothing else."""
    how = {"mean": F.avg, "max": F.max}[pooling]
    by = cells.filter("d is not null").groupBy("point_index", "d").agg(how("value").alias("v"))
    rows = by.groupBy("point_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda s: s["v"]).alias("e"))
    lost = F.exists("e", lambda v: v.isNull())
    return rows.select("point_index", F.when(~lost, F.col("e")).alias("embedding"), F.when(lost, "nothing but fill values").alias("error"))


def north_up(a: Column, b: Column, d: Column, e: Column, eps: float = 1e-12) -> Column:
    """An affine transform (x = a·col + b·row + c, y = d·col + e·row + f) that neither turns nor shears."""
    return (F.abs(b) <= eps) & (F.abs(d) <= eps) & (a > 0) & (e < 0)


def tile_bounds(a: Column, c: Column, e: Column, f: Column, w: Column, h: Column) -> Column:
    return F.struct(c.alias("minx"), (f + e * h).alias("miny"), (c + a * w).alias("maxx"), f.alias("maxy"))


def tiles_for(registry: DataFrame, rois: DataFrame, cell: float = 1.0) -> DataFrame:
    """``roi_id, tile_id, year, tile_order`` of the tiles (``tile_id, year, minx … maxy``) that share area with a region
    (``roi_id, year, minx … maxy``) in its year; the order is that in which later tiles overwrite earlier ones."""
    pairs = scan.footprint_join(rois, registry, cell, "roi_id", "tile_id")
    pairs = pairs.join(rois.select("roi_id", F.coalesce("year", F.lit(DEFAULT_YEAR)).alias("year")), "roi_id").join(registry.select("tile_id", F.col("year").alias("tile_year")), "tile_id")
    return pairs.filter("year = tile_year").select("roi_id", "tile_id", "year", F.col("tile_id").alias("tile_order"))


def compatible(tiles: DataFrame) -> DataFrame:
    """``roi_id, error`` of regions whose tiles (``roi_id, crs, a, b, d, e, dims``) cannot be one mosaic: other projections,
    resolutions or dimensions, or a turned transform. Null where all is well."""
    differ = lambda c: F.min(c) != F.max(c)
    turned = F.max((~north_up(F.col("a"), F.col("b"), F.col("d"), F.col("e"))).cast("int")) == 1
    return tiles.groupBy("roi_id").agg(
        F.when(turned, "a tile is turned").when(differ("crs"), "tiles of several projections").when(differ("a") | differ("e"), "tiles of several resolutions").when(differ("dims"), "tiles of several dimensions").alias("error")
    )


def mosaic(cells: DataFrame, windows: DataFrame) -> DataFrame:
    """``roi_id, d, y, x, value`` of the window ``row0, row1, col0, col1`` (pixels of the common grid) of each region:
    of tiles' cells (``roi_id, tile_order, d, gy, gx, value``) the later one's, 0 where there is none."""
    rows = cells.join(windows, "roi_id").filter("gy >= row0 and gy < row1 and gx >= col0 and gx < col1")
    found = scan.product_mosaic(rows.select("roi_id", "tile_order", "d", (F.col("gy") - F.col("row0")).alias("y"), (F.col("gx") - F.col("col0")).alias("x"), "value"), ["roi_id", "d", "y", "x"], "tile_order")
    dims = cells.groupBy("roi_id").agg(F.collect_set("d").alias("ds"))
    every = windows.join(dims, "roi_id").select("roi_id", F.explode("ds").alias("d"), "row0", "row1", "col0", "col1")
    every = every.select("roi_id", "d", "col0", "col1", F.explode(F.sequence(F.lit(0), F.col("row1") - F.col("row0") - 1)).alias("y"))
    every = every.select("roi_id", "d", "y", F.explode(F.sequence(F.lit(0), F.col("col1") - F.col("col0") - 1)).alias("x"))
    return every.join(found, ["roi_id", "d", "y", "x"], "left").fillna({"value": 0.0})


def degree_grid(cells: DataFrame, boxes: DataFrame, year: int = DEFAULT_YEAR, step: float = 0.25) -> DataFrame:
    """``roi_id, cell_lat, cell_lon, d, value, error``: the cells (``cell_lat, cell_lon`` centres, ``d``) of a degree grid
    inside each box, found by equi-join on cell numbers. A box of another year is a row with an error."""
    number = lambda c: F.floor(F.col(c) / step).cast("int")
    some = boxes.filter(F.coalesce("year", F.lit(year)) == year)
    want = some.select("roi_id", "minlon", "minlat", "maxlon", "maxlat", F.explode(F.sequence(number("minlon"), number("maxlon"))).alias("i")).withColumn("j", F.explode(F.sequence(number("minlat"), number("maxlat"))))
    grid = cells.withColumn("i", number("cell_lon")).withColumn("j", number("cell_lat"))
    inside = F.col("cell_lon").between(F.col("minlon"), F.col("maxlon")) & F.col("cell_lat").between(F.col("minlat"), F.col("maxlat"))
    found = want.join(grid, ["i", "j"]).filter(inside).select("roi_id", "cell_lat", "cell_lon", "d", "value")
    bad = boxes.filter(F.coalesce("year", F.lit(year)) != year).select("roi_id", F.lit(f"only {year} is there").alias("error"))
    return boxes.select("roi_id").join(found, "roi_id", "left").join(bad, "roi_id", "left")


def kelvin(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Temperatures of an image in kelvin: those beyond 1000 are in steps of 0.02."""
    top = rows.groupBy(*keys).agg((F.max(F.abs(value)) > 1000).alias("__s"))
    return rows.join(top, keys).withColumn(value, F.when(F.col("__s"), F.col(value) * 0.02).otherwise(F.col(value))).drop("__s")


def proxy_channels(reflectance: DataFrame, temperature: DataFrame) -> DataFrame:
    """``point_index, y, x, channels array<double>``: 14 channels of two collections joined by pixel. Reflectance
    (``point_index, y, x, band, value``) is scaled to 0..1, the one temperature (``point_index, y, x, value``) stands for all
    emissive channels, each scaled to its range."""
    pick = [F.max(F.when(F.col("band") == b, F.col("value"))).alias(f"r{i}") for i, b in enumerate(REFLECTIVE)]
    r = reflectance.groupBy("point_index", "y", "x").agg(*pick)
    t = kelvin(temperature, ["point_index"]).select("point_index", "y", "x", F.col("value").alias("k"))
    channel = lambda c: radiometry.reflectance(F.col(c), 10000.0) if c[0] == "r" else radiometry.emissive(F.col("k"), *EMISSIVE[int(c[1:])])
    return r.join(t, ["point_index", "y", "x"]).select("point_index", "y", "x", F.array(*[channel(c) for c in PROXY]).alias("channels"))
