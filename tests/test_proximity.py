import math
import random
from datetime import datetime

import numpy as np
import pytest

from rasterloom.operators import proximity

SCHEMA = "roi_id bigint, kind string, minlon double, minlat double, maxlon double, maxlat double, lon double, lat double, buffer_m double, crs string, site string, added_at timestamp"
T = datetime(2024, 1, 1)
W = "EPSG:4326"


def point(i, lon, lat, r, crs=W, t=T):
    return (i, "point_buffer", None, None, None, None, lon, lat, r, crs, None, t)


def box(i, a, b, c, d, crs=W, t=T):
    return (i, "bbox", a, b, c, d, None, None, None, crs, None, t)


def usable(rows):
    pts, boxes = {}, {}
    for r in rows:
        i, kind, a, b, c, d, lon, lat, m, crs, _, _ = r
        if i is None or crs != W:
            continue
        if kind == "point_buffer" and None not in (lon, lat, m) and -180 <= lon <= 180 and -90 <= lat <= 90 and m > 0:
            pts[i] = (lon, lat, m)
        if kind == "bbox" and None not in (a, b, c, d) and -180 <= a < c <= 180 and -90 <= b < d <= 90:
            boxes[i] = (a, b, c, d)
    return pts, boxes


def brute(rows):
    pts, boxes = usable(rows)
    out = set()
    ids = sorted(pts)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            (x, y, r), (u, v, s) = pts[i], pts[j]
            h = math.sin(math.radians(v - y) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(v)) * math.sin(math.radians(u - x) / 2) ** 2
            if 2 * 6371008.8 * math.asin(min(1, math.sqrt(h))) <= max(r, s):
                out.add(("near", i, j))
        out |= {("inside", min(i, k), max(i, k)) for k, (a, b, c, d) in boxes.items() if a <= pts[i][0] <= c and b <= pts[i][1] <= d}
    return out


def found(spark, rows, **how):
    got = proximity.nearby(spark.createDataFrame(rows, SCHEMA), **how).collect()
    keys = [(r.case_kind, r.roi_id_1, r.roi_id_2) for r in got]
    assert len(keys) == len(set(keys))
    return set(keys)


@pytest.mark.parametrize("how", [{}, {"block_rows": 7, "cell_rows": 10}])
def test_random_places(spark, how):
    rnd = random.Random(5)
    rows = [point(i, rnd.choice([179.999, -179.999, 12.0, 180.0, -180.0]) + rnd.uniform(-0.02, 0) * (rnd.random() < 0.7), rnd.choice([0.0, 89.999, -60.0]) + rnd.uniform(0, 0.001), rnd.choice([50.0, 900.0, 3000.0])) for i in range(150)]
    rows += [box(1000 + i, 11.9 + rnd.random() * 0.1, -61 + rnd.random(), 12.0 + rnd.random(), 0.0 + rnd.random()) for i in range(30)]
    rows = [r for r in rows if r[6] is None or -180 <= r[6] <= 180]
    want = brute(rows)
    assert len(want) > 300
    assert found(spark, rows, **how) == want


def test_edges_poles_and_date_line(spark):
    rows = [point(1, 0.0, 90.0, 2000.0), point(2, 170.0, 89.99, 1.0), point(3, 180.0, 5.0, 10.0), point(4, -180.0, 5.0, 10.0), box(5, -180.0, 5.0, 0.0, 6.0), box(6, 179.0, 4.0, 180.0, 5.0)]
    want = brute(rows)
    assert ("near", 1, 2) in want and ("near", 3, 4) in want and ("inside", 4, 5) in want and ("inside", 3, 6) in want
    assert found(spark, rows) == want


def test_dirty_rows_ties_and_repeats(spark):
    later = datetime(2024, 2, 1)
    rows = [
        point(1, 1.0, 1.0, 10.0), point(1, 1.0, 1.0, 10.0, t=later), point(2, 1.0, 1.0, 10.0), point(3, 1.0, 1.0, None), point(4, 1.0, 1.0, -5.0), point(5, 1.0, 91.0, 5.0),
        point(6, None, 1.0, 5.0), point(7, 1.0, 1.0, 5.0, "EPSG:3857"), point(8, 1.0, 1.0, 5.0, None), point(None, 1.0, 1.0, 5.0), point(9, 1.0, 1.0, float("nan")), point(14, float("nan"), 1.0, 5.0),
        box(10, 2.0, 0.0, 0.0, 2.0), box(11, 0.0, 0.0, 2.0, None), box(12, 1.0, 1.0, 2.0, 2.0), box(13, 1.0, 1.0, 1.0, 2.0),
    ]
    assert found(spark, rows) == {("near", 1, 2), ("inside", 1, 12), ("inside", 2, 12)}


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert proximity.nearby(df).count() == 0
    more = spark.createDataFrame([point(1, 1.0, 1.0, 10.0), point(2, 1.0, 1.0, 10.0)], SCHEMA)
    more = more.selectExpr("*", "1 AS x", "2 AS strip", "3 AS pid", "4 AS r_rid")
    assert proximity.nearby(more).count() == 1


def test_stab_against_brute_force():
    rnd = np.random.default_rng(3)
    px, py = rnd.integers(0, 20, 300) / 2, rnd.integers(0, 20, 300) / 2
    x0, y0 = rnd.integers(0, 20, 200) / 2, rnd.integers(0, 20, 200) / 2
    x1, y1 = x0 + rnd.integers(0, 8, 200) / 2, y0 + rnd.integers(0, 8, 200) / 2
    i, j = proximity.stab(px, py, x0, y0, x1, y1)
    got = set(zip(i.tolist(), j.tolist()))
    assert len(got) == len(i)
    inside = (px[:, None] >= x0) & (px[:, None] <= x1) & (py[:, None] >= y0) & (py[:, None] <= y1)
    assert got == set(zip(*[a.tolist() for a in np.nonzero(inside)]))


def test_wide_rectangles_cost_no_copy_per_slab():
    import tracemalloc

    rng = np.random.default_rng(4)
    n = 8192
    px, py = rng.random(n), rng.random(n)
    x0, y0 = rng.random(n) * 0.2, rng.random(n)
    x1, y1 = 0.8 + rng.random(n) * 0.2, y0 + 1e-4
    y1[0], y0[0] = 1.0, 0.0  # one tall among the flat
    tracemalloc.start()
    i, j = proximity.stab(px, py, x0, y0, x1, y1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    inside = sum(int(((px >= a) & (px <= c) & (py >= b) & (py <= d)).sum()) for a, b, c, d in zip(x0, y0, x1, y1))
    assert len(i) == inside and peak < 300 << 20


def test_stab_of_degenerate_rectangles():
    z = np.zeros(3)
    assert len(proximity.stab(z, z, z[:0], z[:0], z[:0], z[:0])[0]) == 0 and len(proximity.stab(z[:0], z[:0], z, z, z, z)[0]) == 0
    assert len(proximity.stab(z, z, z, z, z, z)[0]) == 9  # points on points
    assert len(proximity.stab(z, z, z + 1, z, z, z)[0]) == 0  # reversed
