"""Coordinates, boxes and Web Mercator as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of EPSG:3857 and of the metre-to-degree rule.
EARTH_R = 6378137.0
MAX_LAT = 85.05112878
M_PER_DEGREE = 111320.0


def _box(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    return F.struct(minx.alias("minx"), miny.alias("miny"), maxx.alias("maxx"), maxy.alias("maxy"))


def mercator_x(lon: Column) -> Column:
    return F.lit(EARTH_R) * F.radians(lon)


def mercator_y(lat: Column) -> Column:
    lat = F.greatest(F.least(lat, F.lit(MAX_LAT)), F.lit(-MAX_LAT))
    return F.lit(EARTH_R) * F.log(F.tan(F.pi() / 4 + F.radians(lat) / 2))


def lon_of(x: Column) -> Column:
    return F.degrees(x / EARTH_R)


def lat_of(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / EARTH_R)) - F.pi() / 2)


def roi_box(kind: Column, lon: Column, lat: Column, buffer_m: Column, minlon: Column, minlat: Column, maxlon: Column, maxlat: Column) -> Column:
    """A region of interest in Web Mercator: the square about a point, or a box by its corners."""
    x, y = mercator_x(lon), mercator_y(lat)
    point = _box(x - buffer_m, y - buffer_m, x + buffer_m, y + buffer_m)
    return F.when(kind == "point_buffer", point).when(kind == "bbox", _box(mercator_x(minlon), mercator_y(minlat), mercator_x(maxlon), mercator_y(maxlat)))


def valid_box(minlon: Column, minlat: Column, maxlon: Column, maxlat: Column, crs: Column) -> Column:
    ok = (crs == "EPSG:4326") & (minlon >= -180) & (minlon < maxlon) & (maxlon <= 180) & (minlat >= -90) & (minlat < maxlat) & (maxlat <= 90)
    return F.coalesce(ok, F.lit(False))


def valid_point(buffer_m: Column, crs: Column) -> Column:
    """As a request's point: the buffer is checked, the centre is not."""
    return F.coalesce((crs == "EPSG:4326") & (buffer_m > 0), F.lit(False))


def square_roi(minlon: Column, minlat: Column, maxlon: Column, maxlat: Column, tolerance: float = 1e-4) -> Column:
    """``struct(minlon, minlat, maxlon, maxlat, y0, y1, x0, x1)``: the box enlarged to a square in Web Mercator, and
    where the old one lies in it (fractions of 6 decimals). Unchanged, window 0..1, where it is square already or the
    square would leave the valid coordinates."""
    x0, x1, y0, y1 = mercator_x(minlon), mercator_x(maxlon), mercator_y(minlat), mercator_y(maxlat)
    w, h = x1 - x0, y1 - y0
    side, cx, cy = F.greatest(w, h), (x0 + x1) / 2, (y0 + y1) / 2
    lo, hi, bo, to = lon_of(cx - side / 2), lon_of(cx + side / 2), lat_of(cy - side / 2), lat_of(cy + side / 2)
    keep = (F.abs(w - h) <= tolerance * side) | (lo < -180) | (hi > 180) | (bo < -90) | (to > 90) | (lo >= hi) | (bo >= to)

    def part(size: Column) -> tuple[Column, Column]:
        f = size / side
        return F.round((1 - f) / 2, 6), F.round((1 - f) / 2 + f, 6)

    (ya, yb), (xa, xb) = part(h), part(w)
    pick = lambda a, b: F.when(keep, a).otherwise(b)
    one, zero = F.lit(1.0), F.lit(0.0)
    return F.struct(
        pick(minlon, lo).alias("minlon"), pick(minlat, bo).alias("minlat"), pick(maxlon, hi).alias("maxlon"), pick(maxlat, to).alias("maxlat"),
        pick(zero, ya).alias("y0"), pick(one, yb).alias("y1"), pick(zero, xa).alias("x0"), pick(one, xb).alias("x1"),
    )


def buffer_box(lon: Column, lat: Column, buffer_m: Column) -> Column:
    """A point's buffer in degrees, by metres per degree."""
    dy = buffer_m / M_PER_DEGREE
    dx = buffer_m / (M_PER_DEGREE * F.greatest(F.lit(1e-6), F.cos(F.radians(lat))))
    return F.struct((lon - dx).alias("minlon"), (lat - dy).alias("minlat"), (lon + dx).alias("maxlon"), (lat + dy).alias("maxlat"))


def pixel_span(minlon: Column, minlat: Column, maxlon: Column, maxlat: Column, scale_m: float) -> Column:
    """``struct(h, w)`` in pixels of ``scale_m``, in Web Mercator, rounded up."""
    s = max(1.0, scale_m)
    h = F.ceil(F.abs(mercator_y(maxlat) - mercator_y(minlat)) / s)
    w = F.ceil(F.abs(mercator_x(maxlon) - mercator_x(minlon)) / s)
    return F.struct(h.cast("int").alias("h"), w.cast("int").alias("w"))


def degree_span(minlon: Column, minlat: Column, maxlon: Column, maxlat: Column, scale_m: float) -> Column:
    """``struct(h, w)`` in pixels by metres per degree, truncated, at least 1."""
    h = ((maxlat - minlat) * M_PER_DEGREE / scale_m).cast("int")
    w = ((maxlon - minlon) * M_PER_DEGREE * F.cos(F.radians((minlat + maxlat) / 2)) / scale_m).cast("int")
    return F.struct(F.greatest(h, F.lit(1)).alias("h"), F.greatest(w, F.lit(1)).alias("w"))


def split_box(minlon: Column, minlat: Column, maxlon: Column, maxlat: Column) -> Column:
    """Both halves of a box, cut at the Mercator midpoint of its longer side: west and east, or south and north."""
    x0, x1, y0, y1 = mercator_x(minlon), mercator_x(maxlon), mercator_y(minlat), mercator_y(maxlat)
    mx, my = lon_of((x0 + x1) / 2), lat_of((y0 + y1) / 2)
    mx = F.when((mx > minlon) & (mx < maxlon), mx).otherwise((minlon + maxlon) / 2)
    my = F.when((my > minlat) & (my < maxlat), my).otherwise((minlat + maxlat) / 2)

    def half(part: str, a: Column, b: Column, c: Column, d: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), a.alias("minlon"), b.alias("minlat"), c.alias("maxlon"), d.alias("maxlat"))

    wide = (x1 - x0) >= (y1 - y0)
    return F.when(wide, F.array(half("west", minlon, minlat, mx, maxlat), half("east", mx, minlat, maxlon, maxlat))).otherwise(
        F.array(half("south", minlon, minlat, maxlon, my), half("north", minlon, my, maxlon, maxlat))
    )


def tile_extent(minlon: Column, minlat: Column, maxlon: Column, maxlat: Column, h: Column, w: Column, y0: Column, y1: Column, x0: Column, x1: Column) -> Column:
    """The box of a tile's pixels in the image's box; y counts downwards."""
    dx, dy = maxlon - minlon, maxlat - minlat
    return F.struct((minlon + dx * x0 / w).alias("minlon"), (maxlat - dy * y1 / h).alias("minlat"), (minlon + dx * x1 / w).alias("maxlon"), (maxlat - dy * y0 / h).alias("maxlat"))


def centre(minlon: Column, minlat: Column, maxlon: Column, maxlat: Column) -> Column:
    return F.struct(((minlon + maxlon) / 2).alias("lon"), ((minlat + maxlat) / 2).alias("lat"))


def cyclic_place(lon: Column, lat: Column) -> Column:
    """``[sin lat, cos lat, sin lon, cos lon]``."""
    return F.array(F.sin(F.radians(lat)), F.cos(F.radians(lat)), F.sin(F.radians(lon)), F.cos(F.radians(lon)))


def overlaps(a: str, b: str) -> Column:
    """Rectangles ``a_minx`` … and ``b_minx`` … share some area."""
    c = lambda s, n: F.col(f"{s}_{n}")
    return (c(a, "minx") < c(b, "maxx")) & (c(b, "minx") < c(a, "maxx")) & (c(a, "miny") < c(b, "maxy")) & (c(b, "miny") < c(a, "maxy"))


def effective_resolution(h: Column, w: Column, source_res_m: float, image_size: int) -> Column:
    return F.lit(source_res_m) * F.least(h, w) / image_size


# Fixed values of the WGS 84 ellipsoid and the UTM grid.
WGS84_A, WGS84_F, UTM_K0, UTM_EASTING, UTM_NORTHING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0


def utm_zone(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone: 326xx north of the equator, 327xx south."""
    zone = F.least(F.floor((lon + 180) / 6).cast("int") + 1, F.lit(60))
    return F.when(lat >= 0, 32600 + zone).otherwise(32700 + zone)


def utm(lon: Column, lat: Column, epsg: Column) -> Column:
    """``struct(x, y)`` in metres of a UTM zone, by the third-order series in the third flattening: exact to
    millimetres inside a zone."""
    n = WGS84_F / (2 - WGS84_F)
    a = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    phi, lam = F.radians(lat), F.radians(lon - ((epsg % 100) * 6 - 183))
    c = 2 * n**0.5 / (1 + n)
    t = F.sinh(F.atanh(F.sin(phi)) - c * F.atanh(c * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, k in enumerate(alpha, 1):
        x = x + k * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + k * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    south = F.when(epsg >= 32700, UTM_NORTHING).otherwise(0.0)
    return F.struct((UTM_EASTING + UTM_K0 * a * x).alias("x"), (south + UTM_K0 * a * y).alias("y"))


def utm_box(minlon: Column, minlat: Column, maxlon: Column, maxlat: Column, epsg: Column) -> Column:
    """A box's corners in a UTM zone, as the rectangle around them."""
    corners = [utm(x, y, epsg) for x in (minlon, maxlon) for y in (minlat, maxlat)]
    return _box(*[f(*[c[k] for c in corners]) for f, k in ((F.least, "x"), (F.least, "y"), (F.greatest, "x"), (F.greatest, "y"))])
