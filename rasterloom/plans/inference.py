"""From images to embeddings: input preparation, tiles, models, and tiles put together again.

An image is a row ``point_index, c, h, w, pixels`` (channel by channel, row by row). Preparation is decided per image; an
image that is tiled becomes a row per tile, so tiles of one large image are worked on by many tasks, and only what the
model makes of them comes together again, by point and model. A point's tiles are no more than the tile budget allows.
"""

from __future__ import annotations

import json
import math
import os
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.tiles import full, token_box
from rasterloom.plans import models

RESULT = "point_index bigint, model string, status string, embedding array<double>, shape array<int>, meta string, error string"


@dataclass(frozen=True)
class Output:
    """``pooled`` vectors or the ``grid``; grids have north up unless the model's own order is wanted."""

    mode: str = "pooled"
    pooling: str = "mean"
    orientation: str = "north_up"

    def __post_init__(self) -> None:
        for v, allowed in ((self.mode, ("pooled", "grid")), (self.pooling, ("mean", "max")), (self.orientation, ("north_up", "native"))):
            if v not in allowed:
                raise ValueError(f"{v!r} is none of {allowed}")


@dataclass(frozen=True)
class InputPrep:
    """What is done with an image larger than the model's input.

    ``tile``: cut it, at most ``max_tiles_hard`` tiles; ``resize``: leave it whole to the model; ``auto``: tile grids of up
    to ``max_tiles``, else resize. ``tile_size`` None is the model's own. ``snap``: a rest of at most this share of a tile
    is scaled away. ``pad``: tiles smaller than the size are filled by repeating their edge.
    """

    mode: str = "tile"
    tile_size: int | None = None
    max_tiles: int = 64
    max_tiles_hard: int = 1024
    snap: float = 0.1
    pad: bool = True

    def __post_init__(self) -> None:
        if self.mode not in ("tile", "resize", "auto"):
            raise ValueError(f"no input preparation {self.mode!r}")
        if self.tile_size is not None and self.tile_size < 1:
            raise ValueError("tiles have at least one pixel")
        if self.max_tiles_hard < self.max_tiles:
            raise ValueError("the hard tile limit is below the soft one")
        if not 0 <= self.snap < 1:
            raise ValueError("snap is a share of a tile below 1")

    @classmethod
    def of(cls, given: InputPrep | str | None) -> InputPrep:
        """A preparation, its mode by name, or the default, ``tile``; ``RASTERLOOM_TILE_SNAP`` sets the default's snap."""
        if isinstance(given, InputPrep):
            return given
        snap = float(os.environ.get("RASTERLOOM_TILE_SNAP", cls.snap))
        return cls((given or "tile").strip().lower(), snap=min(max(snap, 0.0), 0.5))

    def resolved(self, output: Output, n_tiles: int) -> str:
        """What is done with an image of ``n_tiles`` tiles; ValueError beyond the hard limit."""
        if self.mode == "resize" or self.mode == "auto" and (output.mode == "pooled" or n_tiles > self.max_tiles):
            return "resize"
        if n_tiles > self.max_tiles_hard:
            raise ValueError(f"{n_tiles} tiles; at most {self.max_tiles_hard} are made")
        if n_tiles > self.max_tiles:
            warnings.warn(f"{n_tiles} tiles, more than the {self.max_tiles} meant for an image", stacklevel=2)
        return "tile"


def starts(n: int, tile: int) -> list[int]:
    """Where tiles begin: one per ``tile`` pixels, the last moved back to end with the axis."""
    return sorted({min(i * tile, max(n - tile, 0)) for i in range(max(1, math.ceil(n / tile)))})


def snapped(n: int, tile: int, share: float) -> int:
    rest = n % tile
    return n - rest if n > tile and 0 < rest <= round(share * tile) else n


def owned(begin: list[int], n: int, tile: int) -> list[tuple[int, int]]:
    """The pixels of an axis each tile answers for: neighbours meet halfway through their overlap."""
    end = [min(n, b + tile) for b in begin]
    if any(b > e for b, e in zip(begin[1:], end)):
        raise ValueError("tiles leave a gap")
    cut = [(e + b) // 2 for b, e in zip(begin[1:], end)]
    return [(a, max(b, a + 1)) for a, b in zip([begin[0], *cut], [*cut, end[-1]])]


def crops(begin: list[int], own: list[tuple[int, int]], cells: list[int], span: list[int]) -> list[tuple[int, int]]:
    """Which of its ``cells`` each tile gives to the stitched axis; one begins where the cells of the last have ended."""
    out, at = [], float(own[0][0])
    for i, (b, (_, e), n, s) in enumerate(zip(begin, own, cells, span)):
        first = min(max(math.floor((at - b) / s * n), 0), n - 1)
        x = (e - b) / s * n
        last = min(max(math.ceil(x) if i == len(begin) - 1 else math.floor(x + 0.5), first + 1), n)
        out.append((first, last))
        at = b + last * s / n
    return out


def _image(r) -> np.ndarray | None:
    ok = r.pixels is not None and r.c is not None and len(r.pixels) == r.c * r.h * r.w > 0
    return np.asarray(r.pixels, np.float32).reshape(int(r.c), int(r.h), int(r.w)) if ok else None


def cut(images: DataFrame, tile: int, output: Output, prep: InputPrep) -> DataFrame:
    """A row per tile: ``point_index, n_tiles, row, col, full_h, full_w, from_h, from_w, y0, x0, c, h, w, pixels, error``.

    ``full_h, full_w`` is the image's size after snapping, ``from_h, from_w`` the one before. An image that is not tiled
    is one row with ``row`` null; one that cannot be has an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                x = _image(r)
                if x is None:
                    rows.append((r.point_index, 0, None, None, None, None, None, None, None, None, None, None, None, None, "no image of the given shape"))
                    continue
                h, w = x.shape[1:]
                sh, sw = snapped(h, tile, prep.snap), snapped(w, tile, prep.snap)
                ys, xs = starts(sh, tile), starts(sw, tile)
                try:
                    how = prep.resolved(output, len(ys) * len(xs))
                except ValueError as e:
                    rows.append((r.point_index, 0, None, None, h, w, h, w, None, None, None, None, None, None, str(e)))
                    continue
                if how == "resize":
                    rows.append((r.point_index, 1, None, None, h, w, h, w, 0, 0, *x.shape, x.ravel(), None))
                    continue
                x = models.bilinear(x, sh, sw) if (sh, sw) != (h, w) else x
                for i, y in enumerate(ys):
                    for j, z in enumerate(xs):
                        t = x[:, y : y + tile, z : z + tile]
                        if prep.pad and t.shape[1:] != (tile, tile):
                            t = np.pad(t, ((0, 0), (0, tile - t.shape[1]), (0, tile - t.shape[2])), mode="edge")
                        rows.append((r.point_index, len(ys) * len(xs), i, j, sh, sw, h, w, y, z, *t.shape, t.ravel(), None))
                if len(rows) > 64:
                    yield frame(rows)
                    rows = []
            if rows:
                yield frame(rows)

    names = ["point_index", "n_tiles", "row", "col", "full_h", "full_w", "from_h", "from_w", "y0", "x0", "c", "h", "w", "pixels", "error"]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({n: "Int64" for n in names[:13]})

    schema = "point_index bigint, n_tiles int, row int, col int, full_h int, full_w int, from_h int, from_w int, y0 int, x0 int, c int, h int, w int, pixels array<float>, error string"
    return images.select("point_index", *[F.col(c).cast("int").alias(c) for c in ("c", "h", "w")], "pixels").mapInPandas(run, schema)


def embed(images: DataFrame, names: list[str], output: Output = Output(), prep: InputPrep | str | None = None, batch: int = 32, factories: dict[str, Callable[[], object]] | None = None) -> DataFrame:
    """``point_index, model, status, embedding, shape, meta, error``: each model on each image.

    ``embedding`` is the pooled vector (``shape`` null), or the grid ``shape`` = (dimensions, rows, columns) flattened.
    ``meta`` says as JSON what was done with the input. Images may have a window ``y0, y1, x0, x1`` (fractions) of the
    region that was asked for: of a smaller one, grids are cropped and pooled vectors taken from the crop. A null, empty
    or misshapen image and one of too many tiles are failed rows; a tile that fails fails its image. Rows without
    point_index are left out.
    """
    prep, out = InputPrep.of(prep), None
    images = images.filter(F.col("point_index").isNotNull())
    n = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for name in names:
        factory = (factories or models.factories())[name]
        traits = models.traits(factory)
        own = prep if traits["tiling"] is None else InputPrep.of(traits["tiling"])
        tile = own.tile_size or traits["image_size"]
        windows = images.select("point_index", F.array("y0", "y1", "x0", "x1").alias("window")) if "y0" in images.columns else None
        if not tile or own.mode == "resize":
            rows = images.select("point_index", F.lit(1).alias("n_tiles"), *[F.lit(None).cast("int").alias(c) for c in ("row", "col")], F.col("h").cast("int").alias("full_h"), F.col("w").cast("int").alias("full_w"), F.col("h").cast("int").alias("from_h"), F.col("w").cast("int").alias("from_w"), F.lit(0).alias("y0"), F.lit(0).alias("x0"), *[F.col(c).cast("int").alias(c) for c in ("c", "h", "w")], F.col("pixels").cast("array<float>").alias("pixels"), F.lit(None).cast("string").alias("error"))
        else:
            # Tiles of one image are spread over the tasks.
            rows = cut(images, tile, output, own).repartition(n, "point_index", "row", "col")
        whole = output.mode == "grid" or traits["pool_kind"] != "vector"
        made = models.run_model(rows, factory, whole, batch)
        if windows is not None:
            made = made.join(windows, "point_index", "left")
        else:
            made = made.withColumn("window", F.lit(None).cast("array<double>"))
        # Tiles of a point stand together in a task, in order; points are then put together in passing.
        made = made.repartition(n, "point_index").sortWithinPartitions("point_index", "row", "col")
        merged = made.mapInPandas(_passing(_merge(name, output, own, tile, traits)), RESULT)
        out = merged if out is None else out.unionByName(merged)
    return out


def grid_table(rows: DataFrame) -> DataFrame:
    """Grids of :func:`embed` as a long table ``point_index, model, d, y, x, value``."""
    h, w = F.col("shape")[1], F.col("shape")[2]
    cells = rows.filter("shape is not null").select("point_index", "model", h.alias("h"), w.alias("w"), F.posexplode("embedding").alias("k", "value"))
    at = {"d": F.floor(F.col("k") / (F.col("h") * F.col("w"))), "y": F.floor(F.col("k") / F.col("w")) % F.col("h"), "x": F.col("k") % F.col("w")}
    return cells.select("point_index", "model", *[c.cast("int").alias(n) for n, c in at.items()], "value")


def _passing(merge: Callable[[list], tuple]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``merge`` for each run of rows of one point, however batches cut them."""
    columns = [c.split()[0] for c in RESULT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if held and held[0].point_index != r.point_index:
                    out.append(merge(held))
                    held = []
                held.append(r)
            if out:
                yield pd.DataFrame(out, columns=columns)
        if held:
            yield pd.DataFrame([merge(held)], columns=columns)

    return run


def _merge(name: str, output: Output, prep: InputPrep, tile: int | None, traits: dict) -> Callable[[list], tuple]:
    """What a model made of an image's tiles, in order of rows and columns, as one row."""
    pool = {"mean": np.mean, "max": np.max}
    how = output.pooling if output.pooling == "mean" or traits["max_honoured"] else "mean"

    def row(point: int, value: np.ndarray | None, meta: dict, error: str | None = None) -> tuple:
        shape = list(value.shape) if value is not None and value.ndim == 3 else None
        return point, name, "failed" if error else "ok", None if value is None else value.ravel().astype(np.float64), shape, json.dumps(meta, sort_keys=True), error

    def run(tiles: list) -> tuple:
        first = tiles[0]
        point, whole = int(first.point_index), pd.isna(first.row)
        meta: dict = {"requested_mode": prep.mode, "resolved_mode": "resize" if whole else "tile"}
        wrong = next((t.error for t in tiles if t.error is not None), None)
        if wrong is not None:
            return row(point, None, meta, wrong)
        made = [np.asarray(t.embedding, np.float64).reshape([int(s) for s in t.shape]) for t in tiles]
        window = None if first.window is None or any(v is None for v in first.window) else tuple(map(float, first.window))
        partial = window is not None and not full(window)
        if whole:
            value = made[0]
            if value.ndim == 3:
                value = oriented(value)
                if partial:
                    y0, y1, x0, x1 = token_box(window, *value.shape[1:])
                    value = value[:, y0:y1, x0:x1]
                if output.mode == "pooled":
                    value = pool[how](value, axis=(1, 2))
            return row(point, value, meta)
        h, w = int(first.full_h), int(first.full_w)
        n_rows, n_cols = int(max(t.row for t in tiles)) + 1, int(max(t.col for t in tiles)) + 1
        if len(tiles) != n_rows * n_cols:
            raise ValueError(f"{len(tiles)} tiles of point {point}, not {n_rows} x {n_cols}")
        ys, xs = starts(h, tile), starts(w, tile)
        oy, ox = owned(ys, h, tile), owned(xs, w, tile)
        at = lambda i, j: made[i * n_cols + j]
        meta |= {"tile_size": tile, "tile_stride": tile, "tile_count": len(tiles), "tile_layout": "cover_shift", "stitch_policy": "midpoint_cut", "pad_edges": prep.pad, "pad_policy": "edge_replicate" if prep.pad else "none", "input_hw": [h, w]}
        if (int(first.from_h), int(first.from_w)) != (h, w):
            meta["snapped_from_hw"] = [int(first.from_h), int(first.from_w)]
        if made[0].ndim == 3:
            span = lambda begin, n: [tile if prep.pad else min(tile, n - s) for s in begin]
            cy = crops(ys, oy, [at(i, 0).shape[1] for i in range(n_rows)], span(ys, h))
            cx = crops(xs, ox, [at(0, j).shape[2] for j in range(n_cols)], span(xs, w))
        if output.mode == "grid":
            grid = np.concatenate([np.concatenate([oriented(at(i, j))[:, slice(*cy[i]), slice(*cx[j])] for j in range(n_cols)], 2) for i in range(n_rows)], 1)
            if partial:
                y0, y1, x0, x1 = token_box(window, *grid.shape[1:])
                grid = grid[:, y0:y1, x0:x1]
            return row(point, grid, meta | {"grid_hw": list(grid.shape[1:])} | ({"seams": "image-level attention within each tile"} if traits["image_level"] else {}))
        roi = (window[0] * h, window[1] * h, window[2] * w, window[3] * w) if partial else (0, h, 0, w)
        values, weights = [], []
        for i, (a, e) in enumerate(oy):
            for j, (s, t) in enumerate(ox):
                v = at(i, j)
                if v.ndim == 3:  # cells that lie in the padding are not the image's
                    v = v[:, : max(1, math.ceil(min(tile, h - ys[i]) / tile * v.shape[1])), : max(1, math.ceil(min(tile, w - xs[j]) / tile * v.shape[2]))]
                    v = pool[how](v, axis=(1, 2))
                values.append(v)
                weights.append(max(0.0, min(e, roi[1]) - max(a, roi[0])) * max(0.0, min(t, roi[3]) - max(s, roi[2])))
        values, weights = np.stack(values), np.array(weights)
        if not weights.any():
            weights[:] = 1.0
        value = (values * weights[:, None]).sum(0) / weights.sum() if how == "mean" else values[weights > 0].max(0)
        return row(point, value, meta)

    def oriented(grid: np.ndarray) -> np.ndarray:
        return grid[:, ::-1] if traits["south_first"] and output.orientation == "north_up" else grid

    return run
