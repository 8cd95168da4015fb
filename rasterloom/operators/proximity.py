"""Points near other points or inside regions, by a distributed slab decomposition.

Boxes and the bounding rectangles of the points' buffers are regions with two vertical and two horizontal edges.
Quantiles of the points' longitudes split the plane into strips, quantiles of the latitudes inside a strip split it
into cells. A point lies in one cell; a region is copied to the cells it meets. In a task, the region edges of a cell
cut it into slabs; slabs are joined in pairs to wider ones, and a region is kept by the few of these that make up its
width. There, regions of about one height are ordered by their lower edge, and a point is located by binary searches of
the edges. What the search returns is checked exactly (great-circle distance, closed box edges).

Hot cells: a cell with more rows than ``block_rows`` is worked off in blocks of points by blocks of regions, each
pair of blocks its own group, so no task holds more than two blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.common import materialize, once

EARTH_RADIUS_M = 6_371_008.8
#: Upper bounds of what is gathered on the driver and sent to tasks, strips x bands cuts: 16 MB, enough for cells of
#: ``cell_rows`` up to 8.6 thousand million points. Beyond that cells grow and are worked off in more blocks.
MAX_STRIPS, MAX_BANDS = 2048, 1024


def _lon(c: str) -> Column:
    return F.col(c).between(-180.0, 180.0)


def _lat(c: str) -> Column:
    return F.col(c).between(-90.0, 90.0)


def usable_points(rois: DataFrame) -> DataFrame:
    """``roi_id, lon, lat, buffer_m`` of the points fit for search, each roi once."""
    ok = (F.col("kind") == "point_buffer") & (F.col("crs") == "EPSG:4326") & _lon("lon") & _lat("lat")
    ok &= (F.col("buffer_m") > 0) & ~F.isnan("buffer_m")
    rows = rois.filter(ok).select("roi_id", "lon", "lat", "buffer_m", "added_at")
    return once(rows, "roi_id", "added_at").drop("added_at")


def usable_boxes(rois: DataFrame) -> DataFrame:
    """``roi_id, minlon, minlat, maxlon, maxlat`` of the boxes fit for search, each roi once."""
    ok = (F.col("kind") == "bbox") & (F.col("crs") == "EPSG:4326") & _lon("minlon") & _lon("maxlon") & _lat("minlat") & _lat("maxlat")
    ok &= (F.col("minlon") < F.col("maxlon")) & (F.col("minlat") < F.col("maxlat"))
    rows = rois.filter(ok).select("roi_id", "minlon", "minlat", "maxlon", "maxlat", "added_at")
    return once(rows, "roi_id", "added_at").drop("added_at")


def disk_rectangles(points: DataFrame, radius_m: float = EARTH_RADIUS_M) -> DataFrame:
    """The points' buffers as lon/lat rectangles ``x0, y0, x1, y1``: two where one crosses the date line, the whole
    circle of longitudes where it holds a pole. A hair wider than the disk, since the exact check follows."""
    ang = F.col("buffer_m") / F.lit(radius_m) * (1 + 1e-9) + 1e-12
    y0, y1 = F.col("lat") - F.degrees(ang), F.col("lat") + F.degrees(ang)
    polar = (y0 <= -90) | (y1 >= 90) | (ang >= math.pi / 2)
    half = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(ang) / F.cos(F.radians("lat"))))) * (1 + 1e-9) + 1e-9
    x0, x1 = F.col("lon") - half, F.col("lon") + half

    def span(a, b) -> Column:
        return F.struct(F.lit(a).cast("double").alias("a") if not isinstance(a, Column) else a.alias("a"), F.lit(b).cast("double").alias("b") if not isinstance(b, Column) else b.alias("b"))

    spans = (
        F.when(polar | (half >= 180), F.array(span(-180.0, 180.0)))
        .when(x0 <= -180, F.array(span(-180.0, x1), span(x0 + 360, 180.0)))
        .when(x1 >= 180, F.array(span(x0, 180.0), span(-180.0, x1 - 360)))
        .otherwise(F.array(span(x0, x1)))
    )
    return points.withColumn("__s", F.explode(spans)).select(
        "roi_id", "lon", "lat", "buffer_m", F.col("__s.a").alias("x0"), y0.alias("y0"), F.col("__s.b").alias("x1"), y1.alias("y1")
    )


def locate(points: DataFrame, regions: DataFrame, block_rows: int = 8192, cell_rows: int = 4096) -> DataFrame:
    """Candidate pairs of ``points`` (``pid, x, y`` + payload) and ``regions`` (``rid, x0, y0, x1, y1`` + payload)
    with the point in the closed rectangle, all payload columns kept (region columns prefixed ``r_``).

    ``block_rows`` bounds the rows of a task from either side, ``cell_rows`` is the size wanted for a cell; neither
    changes the result. Rows with null coordinates match nothing.
    """
    points = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    n = points.count()
    strips = max(1, min(MAX_STRIPS, math.isqrt(max(1, n // cell_rows))))
    bands = max(1, min(MAX_BANDS, -(-n // (cell_rows * strips))))
    # Fixed-size summaries: strips - 1 longitudes and strips x (bands - 1) latitudes.
    probs = [i / strips for i in range(1, strips)]
    xs = sorted(set(points.agg(F.percentile_approx("x", F.array(*map(F.lit, probs)), max(10_000, 20 * strips))).first()[0] or [])) if probs else []
    ys: list[list[float]] = [[] for _ in range(len(xs) + 1)]
    if bands > 1:
        probs = [i / bands for i in range(1, bands)]
        ship_x = points.sparkSession.sparkContext.broadcast(np.array(xs))

        def strip_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"s": np.searchsorted(ship_x.value, b["x"].to_numpy(), "right"), "y": b["y"]})

        for s, q in points.select("x", "y").mapInPandas(strip_of, "s int, y double").groupBy("s").agg(F.percentile_approx("y", F.array(*map(F.lit, probs)), max(1000, 20 * bands))).collect():
            ys[s] = sorted(set(q))
    cuts = points.sparkSession.sparkContext.broadcast((np.array(xs), [np.array(y) for y in ys]))

    pcols, rcols = points.columns, regions.columns
    where = "strip int, band int"

    def place_points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        xcut, ycut = cuts.value
        for b in batches:
            s = np.searchsorted(xcut, b["x"].to_numpy(), "right")
            y = b["y"].to_numpy()
            band = np.zeros(len(b), np.int32)
            for k in np.unique(s):
                at = s == k
                band[at] = np.searchsorted(ycut[k], y[at], "right")
            yield b.assign(strip=s.astype(np.int32), band=band)

    def place_regions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        xcut, ycut = cuts.value
        for b in batches:
            s0, s1 = (np.searchsorted(xcut, b[c].to_numpy(), "right") for c in ("x0", "x1"))
            row = np.repeat(np.arange(len(b)), s1 - s0 + 1)
            s = np.arange(len(row)) - np.repeat(np.cumsum(s1 - s0 + 1) - (s1 - s0 + 1), s1 - s0 + 1) + s0[row]
            y0, y1 = b["y0"].to_numpy()[row], b["y1"].to_numpy()[row]
            b0, b1 = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
            for k in np.unique(s):
                at = s == k
                b0[at], b1[at] = np.searchsorted(ycut[k], y0[at], "right"), np.searchsorted(ycut[k], y1[at], "right")
            n_b = b1 - b0 + 1
            again = np.repeat(np.arange(len(row)), n_b)
            band = np.arange(len(again)) - np.repeat(np.cumsum(n_b) - n_b, n_b) + b0[again]
            yield b.iloc[row[again]].assign(strip=s[again].astype(np.int32), band=band.astype(np.int32))

    def ddl(df: DataFrame) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    p = points.mapInPandas(place_points, f"{ddl(points)}, {where}")
    r = materialize(regions.mapInPandas(place_regions, f"{ddl(regions)}, {where}"), "regions")
    p = materialize(p, "points")
    # Blocks per cell: a small row per cell; whether it is broadcast is left to the optimiser.
    blocks = lambda df, name: df.groupBy("strip", "band").agg(F.ceil(F.count("*") / block_rows).cast("int").alias(name))
    cells = blocks(p, "pb").join(blocks(r, "rb"), ["strip", "band"])
    # A row's block comes from its key; a side that is cut sends its rows to each block of the other side.
    p = p.join(cells, ["strip", "band"]).select(
        *[F.col(c) for c in pcols], "strip", "band", F.pmod(F.xxhash64("pid"), F.col("pb")).cast("int").alias("pblock"), F.explode(F.sequence(F.lit(0), F.col("rb") - 1)).alias("rblock")
    )
    r = r.join(cells, ["strip", "band"]).select(
        *[F.col(c).alias(f"r_{c}") for c in rcols], "strip", "band", F.pmod(F.xxhash64("rid"), F.col("rb")).cast("int").alias("rblock"), F.explode(F.sequence(F.lit(0), F.col("pb") - 1)).alias("pblock")
    )
    keys = ["strip", "band", "pblock", "rblock"]
    out = ", ".join([ddl(points), ", ".join(f"`r_{f.name}` {f.dataType.simpleString()}" for f in regions.schema)])

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        i, j = stab(*(a[c].to_numpy() for c in ("x", "y")), *(b[f"r_{c}"].to_numpy() for c in ("x0", "y0", "x1", "y1")))
        left, right = a[pcols].iloc[i].reset_index(drop=True), b[[f"r_{c}" for c in rcols]].iloc[j].reset_index(drop=True)
        return pd.concat([left, right], axis=1)

    return p.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInPandas(match, out)


def _canonical(lo: np.ndarray, hi: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and nodes of a binary tree over ``size`` leaves (a power of two, the root being node 1): the nodes whose
    leaves make up each range [lo, hi), at most two per level."""
    lo, hi = lo + size, hi + size
    rows, nodes = [], []
    at = np.arange(len(lo))
    while True:
        open_ = lo < hi
        at, lo, hi = at[open_], lo[open_], hi[open_]
        if not len(at):
            break
        left, right = (lo & 1) == 1, (hi & 1) == 1
        rows += [at[left], at[right]]
        nodes += [lo[left], hi[right] - 1]
        lo, hi = (lo + 1) >> 1, hi >> 1
    return (np.concatenate(rows), np.concatenate(nodes)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def stab(px, py, x0, y0, x1, y1, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (point, rectangle) with the point in the closed rectangle.

    The vertical edges cut the plane into slabs: each edge position and each gap between two. Slabs are the leaves of a
    binary tree, a rectangle belongs to the few nodes that make up its interval of slabs, so memory grows with rectangles
    times the tree's depth, however wide they are. Within a node, rectangles are kept by class of height (powers of two)
    and ordered by lower edge: those of one class that hold a point have their lower edge within the class's height
    below it, found by two binary searches, and of what lies in that range at least the nearer half does hold it.
    Candidates are checked ``most`` at a time.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    ok = (x0 <= x1) & (y0 <= y1)
    if not len(px) or not ok.any():
        return none
    edges = np.unique(np.concatenate([x0, x1]))
    slab_p = np.searchsorted(edges, px, "left") + np.searchsorted(edges, px, "right")
    used, slab_p = np.unique(slab_p, return_inverse=True)
    lo, hi = 2 * np.searchsorted(edges, x0) + 1, 2 * np.searchsorted(edges, x1) + 1
    lo, hi = np.searchsorted(used, lo, "left"), np.searchsorted(used, hi, "right")
    size = 1 << max(0, int(len(used) - 1).bit_length())
    rect, node = _canonical(np.where(ok, lo, 0), np.where(ok, hi, 0), size)
    if not len(rect):
        return none
    height = (y1 - y0)[rect]
    kind = np.where(height > 0, np.frexp(np.maximum(height, 1e-300))[1], -2000)  # height < 2 ** kind
    kinds, kind = np.unique(kind, return_inverse=True)
    lows, rank = np.unique(y0[rect], return_inverse=True)
    step = len(lows) + 1
    key = (node * len(kinds) + kind) * step + rank
    order = np.argsort(key, kind="stable")
    rect, key = rect[order], key[order]
    top = np.searchsorted(lows, py, "right")
    i_out, j_out = [], []
    for c, power in enumerate(kinds):
        reach = py if power == -2000 else py - np.ldexp(1.0, int(power)) * (1 + 1e-12)
        bottom = np.searchsorted(lows, reach, "left")
        up = slab_p + size
        while up[0]:  # from the leaf to the root; all points are equally deep
            base = (up * len(kinds) + c) * step
            begin, end = np.searchsorted(key, base + bottom), np.searchsorted(key, base + top)
            total = np.r_[0, np.cumsum(np.maximum(end - begin, 0))]
            for s in range(0, int(total[-1]), most):
                at = np.arange(s, min(s + most, int(total[-1])))
                i = np.searchsorted(total, at, "right") - 1
                j = rect[begin[i] + at - total[i]]
                fits = (y1[j] >= py[i]) & (y0[j] <= py[i])
                i_out.append(i[fits])
                j_out.append(j[fits])
            up = up >> 1
    if not i_out:
        return none
    i, j = np.concatenate(i_out), np.concatenate(j_out)
    order = np.lexsort((j, i))
    return i[order], j[order]


def great_circle_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * F.lit(EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def nearby(rois: DataFrame, block_rows: int = 8192, cell_rows: int = 4096) -> DataFrame:
    """``case_kind, roi_id_1, roi_id_2, distance_m``: each pair of usable points at most the larger buffer apart
    (``near``), and each usable point in a usable box, edges included (``inside``, distance null); the smaller id
    first. Each pair once: a pair of points is reported by the disk of the larger buffer, of equal ones by that of
    the smaller id.

    Unusable rows (null, swapped or out-of-range values, other crs, reversed boxes) give nothing; re-delivered rows
    count once; points at one place pair with each other; an empty table gives an empty result; other columns are
    ignored.
    """
    points = materialize(usable_points(rois), "usable-points")
    boxes = usable_boxes(rois)
    disks = disk_rectangles(points)
    null = lambda: F.lit(None).cast("double")
    regions = disks.select(F.col("roi_id").alias("rid"), "x0", "y0", "x1", "y1", F.lit(True).alias("disk"), "lon", "lat", "buffer_m").unionByName(
        boxes.select(F.col("roi_id").alias("rid"), F.col("minlon").alias("x0"), F.col("minlat").alias("y0"), F.col("maxlon").alias("x1"), F.col("maxlat").alias("y1"), F.lit(False).alias("disk"), null().alias("lon"), null().alias("lat"), null().alias("buffer_m"))
    )
    pairs = locate(points.select(F.col("roi_id").alias("pid"), F.col("lon").alias("x"), F.col("lat").alias("y"), "buffer_m"), regions, block_rows, cell_rows)
    far = great_circle_m(F.col("x"), F.col("y"), F.col("r_lon"), F.col("r_lat"))
    larger = (F.col("r_buffer_m") > F.col("buffer_m")) | ((F.col("r_buffer_m") == F.col("buffer_m")) & (F.col("r_rid") < F.col("pid")))
    pairs = pairs.withColumn("distance_m", F.when(F.col("r_disk"), far))
    return pairs.filter(~F.col("r_disk") | (larger & (F.col("distance_m") <= F.col("r_buffer_m")))).select(
        F.when(F.col("r_disk"), "near").otherwise("inside").alias("case_kind"),
        F.least("pid", "r_rid").alias("roi_id_1"),
        F.greatest("pid", "r_rid").alias("roi_id_2"),
        "distance_m",
    )
