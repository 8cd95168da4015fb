"""Tiles, outputs, shapes and decoding, against the behaviour described for them."""

import json

import numpy as np
import pytest

from rasterloom.plans import decoding, inference, models, shapes
from rasterloom.plans.errors import ModelError
from rasterloom.plans.inference import InputPrep, Output


def _models():
    """Made in a function, so that they reach the workers by value."""

    class Identity:
        image_size, pool_kind = 4, "vector"

        def embed(self, batch):
            return [x.mean((1, 2)) for x in batch]

        def grid(self, batch):
            assert all(x.shape[-2:] == (4, 4) for x in batch)
            return batch

    class Blocks:
        """A fixed grid of 16 x 16 cells over 256 pixels, each the mean of its block."""

        image_size, pool_kind = 256, "grid"

        def grid(self, batch):
            return [x.reshape(x.shape[0], 16, 16, 16, 16).mean(axis=(2, 4))[:1] for x in batch]

        embed = grid

    class Picky:
        image_size = 4

        def embed(self, batch):
            if any(x.min() < 0 for x in batch):
                raise ValueError("negative")
            return [x.mean((1, 2)) for x in batch]

    return Identity, Blocks, Picky


Identity, Blocks, Picky = _models()


def frame(spark, images):
    rows = [(i, *x.shape, x.ravel().astype(float).tolist()) for i, x in enumerate(images)]
    return spark.createDataFrame(rows, "point_index bigint, c int, h int, w int, pixels array<double>")


def run(spark, images, factory, output=Output(), prep=InputPrep(snap=0.0), **more):
    rows = inference.embed(frame(spark, images), ["m"], output, prep, factories={"m": factory}, **more).orderBy("point_index").collect()
    return [(np.array(r.embedding).reshape(r.shape or -1) if r.status == "ok" else r.error, json.loads(r.meta)) for r in rows]


@pytest.mark.parametrize("shape", [(1, 6, 6), (1, 3, 6), (1, 6, 3), (1, 4, 40), (2, 9, 5)])
def test_stitched_tiles_give_the_image_back(spark, shape):
    images = [np.arange(np.prod(shape), dtype=np.float32).reshape(shape) * (i + 1) for i in range(3)]
    got = run(spark, images, Identity, Output("grid"))
    for x, (grid, meta) in zip(images, got):
        assert (grid == x).all() and meta["grid_hw"] == list(shape[1:]) and meta["resolved_mode"] == "tile"
    assert got[0][1]["tile_layout"] == "cover_shift" and got[0][1]["stitch_policy"] == "midpoint_cut" and got[0][1]["pad_policy"] == "edge_replicate"


def test_no_cell_is_doubled_at_a_seam(spark):
    x = np.tile(np.arange(400, dtype=np.float32), (1, 256, 1))
    grid, _ = run(spark, [x], Blocks, Output("grid"))[0]
    assert grid.shape == (1, 16, 25) and (np.diff(grid[0, 0]) > 0).all()


def test_pooled_tiles_weigh_what_they_own(spark):
    x = np.arange(28, dtype=np.float32).reshape(1, 4, 7)
    value, meta = run(spark, [x], Identity)[0]
    assert value[0] == pytest.approx((12 * x[..., 0:4].mean() + 16 * x[..., 3:7].mean()) / 28) and meta["tile_count"] == 2


def test_starts_snapping_and_budgets(spark):
    assert inference.starts(300, 224) == [0, 76] and inference.starts(3, 4) == [0] and inference.starts(12, 4) == [0, 4, 8]
    assert inference.snapped(300, 224, 0.1) == 300 and inference.snapped(236, 224, 0.1) == 224 and inference.snapped(200, 224, 0.1) == 200
    x = np.random.default_rng(0).random((1, 9, 8)).astype(np.float32)
    grid, meta = run(spark, [x], Identity, Output("grid"), InputPrep(snap=0.3))[0]
    assert grid.shape == (1, 8, 8) and meta["snapped_from_hw"] == [9, 8] and np.allclose(grid, models.bilinear(x, 8, 8))
    assert "at most 3" in run(spark, [x], Identity, Output("grid"), InputPrep(max_tiles=2, max_tiles_hard=3, snap=0.0))[0][0]
    assert run(spark, [x], Blocks, Output(), InputPrep("auto", tile_size=4))[0][0].startswith("ValueError")  # left whole to a model that cannot
    with pytest.raises(ValueError):
        inference.owned([0, 9], 12, 4)


def test_failed_tiles_and_images_fail_their_row_only(spark):
    good, bad = np.ones((1, 6, 6)), np.ones((1, 6, 6))
    bad[0, 5, 5] = -1
    rows = frame(spark, [good, bad]).unionByName(spark.createDataFrame([(2, 1, 2, 2, [1.0]), (3, None, None, None, None)], "point_index bigint, c int, h int, w int, pixels array<double>"))
    got = inference.embed(rows, ["m"], prep=InputPrep(), factories={"m": Picky}).orderBy("point_index").collect()
    assert [r.status for r in got] == ["ok", "failed", "failed", "failed"] and "negative" in got[1].error
    assert inference.embed(rows.limit(0), ["m"], factories={"m": Picky}).count() == 0


def test_outputs_and_windows(spark):
    x = np.arange(64, dtype=np.float32).reshape(1, 8, 8)
    for pooling, want in (("mean", x.mean()), ("max", 63.0)):
        assert run(spark, [x], models.Cells, Output("pooled", pooling), "resize")[0][0][0] == want
    flipped = run(spark, [x], models.CellsSouth, Output("grid", orientation="native"), "resize")[0][0]
    assert (flipped == x[:, ::-1]).all() and (run(spark, [x], models.CellsSouth, Output("grid"), "resize")[0][0] == x).all()
    rows = frame(spark, [x]).selectExpr("*", "0.25 AS y0", "0.75 AS y1", "0.0 AS x0", "0.5 AS x1")
    r = inference.embed(rows, ["m"], prep=InputPrep(tile_size=5, snap=0.0), output=Output("grid"), factories={"m": models.Cells}).first()
    assert r.shape == [1, 4, 4] and r.embedding == x[0, 2:6, 0:4].ravel().tolist()
    r = inference.embed(rows, ["m"], prep="resize", factories={"m": models.Cells}).first()
    assert r.embedding == [float(x[0, 2:6, 0:4].mean())]


def test_squares():
    for shape in ((3, 4, 8), (2, 3, 5, 9), (1, 1, 5)):
        x = np.arange(np.prod(shape), dtype=np.float32).reshape(shape)
        for fit in ("none", "crop", "pad"):
            y, meta = shapes.squared(x, 6, fit, pad="reflect")
            assert y.shape == (*shape[:-2], 6, 6) and meta["applied"] == fit
    y, meta = shapes.squared(np.ones((1, 4, 4)), 8, "pad")
    assert meta["applied"] == "none" and meta["window"] == (0.0, 1.0, 0.0, 1.0)
    assert shapes.squared(np.ones((1, 2, 4)), 4, "pad")[1]["window"] == (0.25, 0.75, 0.0, 1.0)
    assert (shapes.resized(np.arange(16.0).reshape(1, 4, 4), 2, "area") == [[[2.5, 4.5], [10.5, 12.5]]]).all()
    assert (shapes.resized(np.arange(16.0).reshape(1, 4, 4), 2, "nearest") == [[[0, 2], [8, 10]]]).all()
    for bad in (np.ones((2, 2)), np.ones((1, 0, 2))):
        with pytest.raises(ModelError):
            shapes.checked(bad)
    with pytest.raises(ModelError):
        shapes.checked(np.ones((3, 2, 2)), 4)
    assert shapes.checked([[[np.nan, np.inf]]]).tolist() == [[[0.0, 0.0]]]
    assert shapes.dims_first(np.ones((5, 6, 64))).shape == (64, 5, 6)


def test_native_sides():
    assert shapes.native_side(31, 16) == 32 and shapes.native_side(24, 16) == 16 and shapes.native_side(3, 16) == 16
    x = np.random.default_rng(0).random((12, 33, 59))
    y, meta = shapes.native(x, 10, 16, [10, 20, 60], 288)
    assert meta["reason"] == "rectangular" and y.shape == (12, 288, 288)
    y, meta = shapes.native(np.ones((1, 97, 97)), 10, 4, [10, 20], 64)
    assert meta["mode"] == "native_snap" and y.shape == (1, 96, 96) and meta["tokens"] == 24**2 + 12**2
    assert shapes.native(np.ones((1, 97, 97)), 10, 4, [10, 20], 64, most_tokens=9)[1]["reason"] == "token limit"
    assert shapes.patch_tokens(7, 10, 4, [10]) is None


def test_decoding():
    t = np.arange(34.0).reshape(17, 2)
    assert len(decoding.patches(t)) == 16 and len(decoding.patches(t[:16])) == 16
    assert decoding.grid_of(t).shape == (2, 4, 4) and decoding.grid_of(t)[1, 0, 1] == 5.0
    assert decoding.grid_of(t[:5])[:, 0, 0].tolist() == t[1:5].mean(0).tolist() or decoding.grid_of(t[:5]).shape == (2, 2, 2)
    assert decoding.grid_of(np.ones((6, 3))).shape == (3, 1, 1)
    g = np.arange(13.0)[:, None]  # a class token and three groups of four
    assert decoding.grouped(g, 3).ravel().tolist() == [5.0, 6.0, 7.0, 8.0] and decoding.grouped(g, 3, "max").ravel().tolist() == [9.0, 10.0, 11.0, 12.0]
    assert decoding.grouped(np.ones((7, 2)), 3).shape == (2, 1, 1)
    maps = [np.ones((2, 4, 4)), np.full((2, 2, 2), 3.0)]
    assert (decoding.merged(maps) == 2).all() and (decoding.merged(maps, "sum") == 4).all() and decoding.merged(maps, "concat").shape == (4, 4, 4)
    five = np.random.default_rng(1).random((4, 4, 2, 3, 5))
    pooled, cells = decoding.over_time(five)
    assert np.allclose(pooled, five.mean((0, 1, 2, 3))) and np.allclose(cells, np.moveaxis(five.mean((2, 3)), -1, 0))
    assert np.allclose(decoding.over_time(five, how="max", window=(0.0, 0.5, 0.0, 0.5))[0], five[:2, :2].max((0, 1, 2, 3)))
    with pytest.raises(ModelError):
        decoding.over_time(five, np.zeros((4, 4, 2, 3)))
    out = {"a": [np.zeros(0) + 1 if False else np.ones((2, 3))], "b": (np.full((2, 5, 4), 2.0),)}
    assert decoding.picked(out).shape == (2, 3) and decoding.picked(out, True).shape == (2, 5, 4)
    assert len(decoding.decoded(out, 2)) == 2
    with pytest.raises(ModelError):
        decoding.decoded(out, 3)
    grid, vector = np.arange(16.0).reshape(1, 4, 4), np.array([99.0])
    assert decoding.embedding("vector", "pooled", vector=vector, grid=grid).tolist() == [99.0]
    assert decoding.embedding("vector", "pooled", "max", vector=vector, grid=grid, window=(0, 0.5, 0, 0.5), max_honoured=False).tolist() == [2.5]
    assert decoding.embedding("tokens", "pooled", "max", tokens=t).tolist() == [32.0, 33.0]
    with pytest.raises(ModelError):
        decoding.embedding("vector", "grid", vector=vector)
