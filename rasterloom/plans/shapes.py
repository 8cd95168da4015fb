"""Images brought to a model's shape: checks, squares, resizing, native sides. Arrays of a few axes, the last two in space."""

from __future__ import annotations

import math
import warnings

import numpy as np

from rasterloom.functions.tiles import side_unit
from rasterloom.plans.errors import ModelError
from rasterloom.plans.models import bilinear


def checked(x, channels: int | None = None, axes: tuple[int, ...] = (3, 4), name: str = "input") -> np.ndarray:
    """``x`` as float32 of ``(C, H, W)`` or ``(T, C, H, W)`` with that many channels; what is no number is 0. ModelError
    otherwise."""
    a = np.asarray(x, np.float32)
    if a.ndim not in axes:
        raise ModelError(f"{name} has {a.ndim} axes, not {' or '.join(map(str, axes))}")
    if channels is not None and a.shape[-3] != channels:
        raise ModelError(f"{name} has {a.shape[-3]} channels, not {channels}")
    if 0 in a.shape:
        raise ModelError(f"{name} is empty: {a.shape}")
    return np.nan_to_num(a, nan=0.0, posinf=0.0, neginf=0.0)


def centre_crop(x: np.ndarray, side: int | None = None) -> np.ndarray:
    h, w = x.shape[-2:]
    side = min(h, w) if side is None else side
    y, z = max(0, (h - side) // 2), max(0, (w - side) // 2)
    return x[..., y : y + min(side, h), z : z + min(side, w)]


def centre_pad(x: np.ndarray, side: int | None = None, how: str = "reflect", fill: float = 0.0) -> np.ndarray:
    """Padded on both sides; a mirror needs more pixels than it fills, else the edge is repeated."""
    h, w = x.shape[-2:]
    side = max(h, w) if side is None else side
    y, z = (side - h) // 2, (side - w) // 2
    width = [(0, 0)] * (x.ndim - 2) + [(y, side - h - y), (z, side - w - z)]
    if how == "constant":
        return np.pad(x, width, constant_values=fill)
    if how == "reflect" and (side - h - y >= h or side - w - z >= w):
        how = "edge"
    return np.pad(x, width, mode=how)


def resized(x: np.ndarray, size: int, how: str = "bilinear") -> np.ndarray:
    """To ``size`` x ``size``: ``bilinear`` with half-pixel centres, ``nearest``, or ``area`` (means of what a pixel covers)."""
    h, w = x.shape[-2:]
    if (h, w) == (size, size):
        return x
    if how == "bilinear":
        return bilinear(x, size, size).astype(x.dtype)
    if how == "nearest":
        at = lambda n: np.minimum((np.arange(size) * n / size).astype(int), n - 1)
        return x[..., at(h)[:, None], at(w)]
    if how == "area":
        for axis, n in ((-2, h), (-1, w)):
            lo, hi = np.arange(size) * n // size, -(-(np.arange(1, size + 1) * n) // size)
            x = np.stack([np.take(x, range(a, b), axis=axis).mean(axis) for a, b in zip(lo, hi)], axis)
        return x
    raise ModelError(f"no interpolation {how!r}")


def squared(x: np.ndarray, size: int, fit: str = "pad", tolerance: float = 0.02, pad: str = "reflect", fill: float = 0.0, how: str = "bilinear") -> tuple[np.ndarray, dict]:
    """An image as a square of ``size``, and what was done: ``fit`` is none (stretch), crop or pad, for images whose sides
    differ by more than ``tolerance``; ``window`` (y0, y1, x0, x1) is where the image lies in the square as fractions."""
    h, w = x.shape[-2:]
    if fit not in ("none", "crop", "pad"):
        raise ModelError(f"no way to make a square: {fit!r}")
    aspect = max(h, w) / min(h, w)
    applied = fit if fit != "none" and aspect - 1 > tolerance else "none"
    window = (0.0, 1.0, 0.0, 1.0)
    if applied == "crop":
        x = centre_crop(x)
    elif applied == "pad":
        side = max(h, w)
        y, z = (side - h) // 2, (side - w) // 2
        window = (y / side, (y + h) / side, z / side, (z + w) / side)
        x = centre_pad(x, how=pad, fill=fill)
    if aspect >= 2:
        warnings.warn(f"an image of {h} x {w} pixels is made a square", stacklevel=2)
    return resized(x, size, how), {"aspect": round(aspect, 6), "fit": fit, "applied": applied, "window": window, "from_hw": [h, w], "size": size}


def patch_tokens(side: int, scale_m: int, patch: int, gsds: list[int]) -> int | None:
    """How many patches of all resolutions a square has; None for a side that does not divide."""
    total = 0
    for g in sorted(set(gsds)):
        metres = side * scale_m
        if metres % (patch * g):
            return None
        total += (metres // (patch * g)) ** 2
    return total


def native_side(side: int, unit: int) -> int:
    low = max(unit, side // unit * unit)
    high = max(unit, -(-side // unit) * unit)
    return low if side - low <= high - side else high


def native(x: np.ndarray, scale_m: int, patch: int, gsds: list[int], size: int, tolerance: int = 2, most_side: int = 512, most_tokens: int = 8192, tiled: bool = False, fixed: bool = False) -> tuple[np.ndarray, dict]:
    """An image at its own resolution, cropped or padded to the nearest side that all of the model's resolutions divide;
    or resized to ``size``, with the reason: tiled, fixed, rectangular, side or tokens beyond the limit."""
    h, w = x.shape[-2:]
    why = "tile" if tiled else "fixed" if fixed else "rectangular" if abs(h - w) > tolerance else None
    side = native_side(min(h, w), side_unit(scale_m, patch, gsds))
    tokens = patch_tokens(side, scale_m, patch, gsds)
    if why is None and side > most_side:
        why = "side limit"
    if why is None and (tokens is None or tokens > most_tokens):
        why = "token limit"
    if why:
        return resized(x, size), {"mode": "fixed", "reason": why, "side": size}
    if min(h, w) < side or max(h, w) < side:
        x = centre_pad(centre_crop(x, min(side, min(h, w))), side, "constant")
    return centre_crop(x, side), {"mode": "native_snap", "reason": None, "side": side, "tokens": tokens}


def dims_first(a: np.ndarray, known: tuple[int, ...] = (64, 128, 192, 256, 384, 512, 768, 1024, 1280)) -> np.ndarray:
    """A grid with its dimensions on the first axis: that of a known size, else the longest; HWC becomes CHW."""
    if a.ndim != 3:
        raise ModelError(f"a grid has three axes, not {a.ndim}")
    axis = next((i for i in (0, 2, 1) if a.shape[i] in known), int(np.argmax(a.shape)))
    return np.moveaxis(a, axis, 0)


def square_side(n: int) -> int | None:
    s = math.isqrt(n)
    return s if s * s == n else None
