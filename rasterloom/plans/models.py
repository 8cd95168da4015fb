"""Models as vectorised functions: a registry, their contract, and inference with a status per row.

A model is any object with ``dim`` and ``embed(batch) -> list of vectors or None``, where a batch is a list of image
arrays ``(channels, height, width)``. Weights and forward passes are the caller's; the stubs here compute simple
statistics, which is what tests and plans need.
"""

from __future__ import annotations

import hashlib
import importlib
import inspect
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_factories: dict[str, Callable[[], object]] = {}
_lazy: dict[str, str] = {}
_failed: dict[str, str] = {}
_loaded: dict[str, object] = {}
MAX_LOADED = 32


def register(name: str, outputs: tuple[str, ...] = ("pooled", "grid"), backends: tuple[str, ...] = ("auto", "local"), **traits) -> Callable:
    """Class decorator; a second one of a name replaces the first. ``traits``: see :func:`traits`."""

    def add(factory):
        factory.name, factory.outputs, factory.backends = name, outputs, backends
        for k, v in traits.items():
            setattr(factory, k, v)
        _factories[name] = factory
        return factory

    return add


def register_lazy(name: str, where: str) -> None:
    """A model whose class is ``module:Class``, imported when it is first asked for."""
    _lazy[name.strip().lower()] = where


def _known(key: str):
    """The factory of a name; KeyError with those there are, and why an import has failed. A failed import is not tried
    again before :func:`reset`."""
    if key not in _factories and key in _lazy and key not in _failed:
        module, _, attribute = _lazy[key].partition(":")
        try:
            factory = getattr(importlib.import_module(module), attribute)
            if key not in _factories:  # a module may have registered it while it was imported
                _factories[key] = factory if hasattr(factory, "outputs") and hasattr(factory, "backends") else register(key)(factory)
        except (ImportError, AttributeError) as e:
            _failed[key] = f"{type(e).__name__}: {e}"
    if key not in _factories:
        why = f" ({_failed[key]})" if key in _failed else ""
        raise KeyError(f"no model {key!r}{why}; there are {', '.join(sorted({*_factories, *_lazy}))}")
    return _factories[key]


def factories() -> dict[str, Callable[[], object]]:
    return dict(_factories)


def accepts(factory, method: str, parameter: str) -> bool:
    """Whether a model's method takes a parameter: as it declares in ``capabilities``, else by its signature."""
    declared = getattr(factory, "capabilities", {})
    if parameter in declared:
        return bool(declared[parameter])
    f = getattr(factory, method, None)
    if f is None:
        return False
    kinds = inspect.signature(f).parameters.values()
    return any(p.name == parameter or p.kind is p.VAR_KEYWORD for p in kinds)


def traits(factory) -> dict:
    """What plans need to know of a model: ``image_size`` of its input (None: any), ``pool_kind`` (``grid``: pooled from its
    grid; ``vector``: it has a vector of its own), ``max_honoured``, ``south_first`` rows, ``image_level`` attention, and
    ``tiling``, a preparation it insists on."""
    known = {"image_size": None, "pool_kind": "vector", "max_honoured": True, "south_first": False, "image_level": False, "tiling": None}
    return {k: getattr(factory, k, v) for k, v in known.items()}


@register("band_mean")
class BandMean:
    """Mean of each channel."""

    dim = None

    def embed(self, batch: list[np.ndarray]) -> list[np.ndarray]:
        return [x.mean(axis=(1, 2)) for x in batch]

    def grid(self, batch: list[np.ndarray]) -> list[np.ndarray]:
        return batch


@register("band_max", outputs=("pooled",))
class BandMax:
    """Maximum of each channel."""

    dim = None

    def embed(self, batch: list[np.ndarray]) -> list[np.ndarray]:
        return [x.max(axis=(1, 2)) for x in batch]


@register("flat", outputs=("grid",))
class Flat:
    """The image itself."""

    dim = None

    def embed(self, batch: list[np.ndarray]) -> list[np.ndarray]:
        return [x.ravel() for x in batch]

    def grid(self, batch: list[np.ndarray]) -> list[np.ndarray]:
        return batch


@register("cells", pool_kind="grid")
class Cells:
    """The image itself as a grid, pooled as asked."""

    dim = None

    def embed(self, batch: list[np.ndarray]) -> list[np.ndarray]:
        return [x.mean(axis=(1, 2)) for x in batch]

    def grid(self, batch: list[np.ndarray]) -> list[np.ndarray]:
        return batch


@register("cells_south", pool_kind="grid", south_first=True)
class CellsSouth(Cells):
    """The image turned round, as models whose rows run from the south give it."""

    def grid(self, batch: list[np.ndarray]) -> list[np.ndarray]:
        return [x[:, ::-1] for x in batch]


def get(name: str):
    """The model, made once per process; KeyError names those there are."""
    return loaded(_known(name.strip().lower()))


def loaded(factory, key: str | None = None):
    """A factory's model, made once per process (in a worker: once for all its tasks); the oldest goes beyond
    ``MAX_LOADED``. ``key``: see :func:`identity`."""
    key = key or identity(factory)
    if key not in _loaded:
        while len(_loaded) >= MAX_LOADED:
            _loaded.pop(next(iter(_loaded)))
        _loaded[key] = factory()
    return _loaded[key]


def identity(factory) -> str:
    """What tells factories apart: their name and content, so that a class that was written anew is another one."""
    return f"{getattr(factory, '__module__', '')}.{getattr(factory, '__qualname__', '')}-{hashlib.sha1(cloudpickle.dumps(factory)).hexdigest()}"


def reset() -> None:
    """Forget instances and failed imports."""
    _loaded.clear()
    _failed.clear()


def list_models(spark: SparkSession) -> DataFrame:
    rows = [(n, list(f.outputs), list(f.backends), f.__doc__ or "") for n, f in sorted(_factories.items())]
    return spark.createDataFrame(rows, "model string, outputs array<string>, backends array<string>, description string").orderBy("model")


def describe(name: str) -> dict:
    get(name)
    f = _factories[name.strip().lower()]
    return {"model": f.name, "outputs": f.outputs, "backends": f.backends, "description": f.__doc__}


def bilinear(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """The last two axes resized with half-pixel centres."""

    def axis(n_in: int, n_out: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(n_out) + 0.5) * n_in / n_out - 0.5, 0, n_in - 1)
        lo = np.floor(at).astype(int)
        return lo, np.minimum(lo + 1, n_in - 1), at - lo

    (y0, y1, fy), (x0, x1, fx) = axis(x.shape[-2], h), axis(x.shape[-1], w)
    rows = x[..., y0, :] * (1 - fy)[:, None] + x[..., y1, :] * fy[:, None]
    return rows[..., x0] * (1 - fx) + rows[..., x1] * fx


def squared(x: np.ndarray, how: str = "pad", fill: float = 0.0) -> np.ndarray:
    """Centre-cropped or centre-padded to a square."""
    h, w = x.shape[-2:]
    side = min(h, w) if how == "crop" else max(h, w)
    if how == "crop":
        y, z = (h - side) // 2, (w - side) // 2
        return x[..., y : y + side, z : z + side]
    y, z = (side - h) // 2, (side - w) // 2
    return np.pad(x, [(0, 0)] * (x.ndim - 2) + [(y, side - h - y), (z, side - w - z)], constant_values=fill)


def frames(x: np.ndarray, n: int, clip: tuple[float, float] | None = (0.0, 10000.0)) -> np.ndarray:
    """``(T, C, H, W)`` of ``n`` frames: one image is repeated, a series is cut or its last frame repeated; not a
    number is 0."""
    x = x[None] if x.ndim == 3 else x
    if x.ndim != 4:
        raise ValueError(f"an image or a series of images, not {x.ndim} axes")
    x = np.nan_to_num(x[np.minimum(np.arange(n), len(x) - 1)].astype(np.float32), nan=0.0, posinf=0.0, neginf=0.0)
    return np.clip(x, *clip) if clip else x


def padded(x: np.ndarray, multiple: int, fill: float = 0.0) -> np.ndarray:
    """Padded at the bottom and right to whole multiples."""
    h, w = x.shape[-2:]
    return np.pad(x, [(0, 0)] * (x.ndim - 2) + [(0, -h % multiple), (0, -w % multiple)], constant_values=fill)


def tiles(x: np.ndarray, tile: int) -> list[tuple[int, int, np.ndarray]]:
    """``row, col, tile`` covering the image; the border is repeated where the image is smaller than a tile."""
    h, w = x.shape[-2:]
    starts = lambda n: sorted({min(i * tile, max(n - tile, 0)) for i in range(max(1, math.ceil(n / tile)))})
    out = []
    for r, y in enumerate(starts(h)):
        for c, z in enumerate(starts(w)):
            ys, xs = np.minimum(np.arange(y, y + tile), h - 1), np.minimum(np.arange(z, z + tile), w - 1)
            out.append((r, c, x[..., ys[:, None], xs]))
    return out


def answers(call: Callable, images: list[np.ndarray]) -> list[tuple]:
    """``(value, None)`` or ``(None, error)`` of each image: a batch that fails is tried image by image."""
    try:
        got = call(images)
        if len(got) != len(images):
            raise ValueError(f"{len(got)} results for {len(images)} images")
        return [(np.asarray(v, np.float64), None) if v is not None else (None, "no result") for v in got]
    except Exception as e:  # a model may fail in any way; its rows say how
        if len(images) > 1:
            return [r for x in images for r in answers(call, [x])]
        return [(None, f"{type(e).__name__}: {e}"[:500])]


def run_model(images: DataFrame, factory, grid: bool = False, batch: int = 32) -> DataFrame:
    """``images`` (``c, h, w, pixels, error`` and any others) with ``embedding`` and its ``shape`` instead of the pixels:
    what a model makes of them, its ``grid`` or its vector. Images with an error keep it."""
    kept = [f for f in images.schema if f.name not in ("c", "h", "w", "pixels", "error")]
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in kept], "embedding array<double>, shape array<int>, error string"])

    key = identity(factory)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loaded(factory, key)
        call = model.grid if grid and hasattr(model, "grid") else model.embed
        for b in batches:
            out: list[tuple] = [(None, e) for e in b["error"]]
            shaped: list = [None] * len(b)
            for i, r in enumerate(b.itertuples()):
                if r.error is None:
                    ok = r.pixels is not None and r.c is not None and len(r.pixels) == r.c * r.h * r.w > 0
                    shaped[i] = np.asarray(r.pixels, np.float32).reshape(int(r.c), int(r.h), int(r.w)) if ok else None
                    out[i] = out[i] if ok else (None, "no image of the given shape")
            good = [i for i, x in enumerate(shaped) if x is not None]
            for s in range(0, len(good), batch):
                part = good[s : s + batch]
                for i, r in zip(part, answers(call, [shaped[i] for i in part])):
                    out[i] = r
            yield b[[f.name for f in kept]].assign(embedding=[None if v is None else v.ravel() for v, _ in out], shape=[None if v is None else list(v.shape) for v, _ in out], error=[e for _, e in out])

    return images.mapInPandas(run, schema)


def infer(images: DataFrame, models: list[str], batch: int = 32, factories: dict[str, Callable[[], object]] | None = None) -> DataFrame:
    """``point_index, model, status, embedding, error``: each model's vector of each whole image (``point_index, c, h, w,
    pixels``). A null, empty or misshapen image is a failed row. See ``plans.inference`` for tiles and grids."""
    rows = images.select("point_index", *[F.col(c).cast("int").alias(c) for c in ("c", "h", "w")], "pixels", F.lit(None).cast("string").alias("error"))
    out = None
    for name in models:
        made = run_model(rows, (factories or _factories)[name], False, batch)
        made = made.select("point_index", F.lit(name).alias("model"), F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("status"), "embedding", "error")
        out = made if out is None else out.unionByName(made)
    return out
