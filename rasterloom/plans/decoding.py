"""What backbones give, as vectors and grids: tokens, feature maps, groups of channels, and the embeddings made of them.

Forward passes are the caller's; these functions take their arrays, one image at a time, inside a model's ``embed`` and
``grid``.
"""

from __future__ import annotations

import numpy as np

from rasterloom.functions.tiles import full, token_box
from rasterloom.plans.errors import ModelError
from rasterloom.plans.models import bilinear
from rasterloom.plans.shapes import square_side

POOL = {"mean": np.mean, "max": np.max}


def picked(out, last: bool = False) -> np.ndarray:
    """The first or last array in nested lists, tuples and mappings."""
    todo, found = [out], None
    while todo:
        o = todo.pop(0)
        if hasattr(o, "shape") and getattr(o, "ndim", 0) > 0:
            found = np.asarray(o)
            if not last:
                return found
        elif isinstance(o, dict):
            todo = list(o.values()) + todo
        elif isinstance(o, (list, tuple)):
            todo = list(o) + todo
    if found is None:
        raise ModelError("no array in what the backbone gave")
    return found


def decoded(out, batch: int, last: bool = True) -> list[np.ndarray]:
    """One array per image of a batch: maps ``(D, H, W)``, tokens ``(N, D)`` or vectors ``(D,)``; ModelError for another
    number of images."""
    a = picked(out, last)
    if a.ndim == 1 and batch == 1:
        a = a[None]
    if a.ndim not in (2, 3, 4) or a.shape[0] != batch:
        raise ModelError(f"{a.shape} for {batch} images")
    return list(a)


def patches(tokens: np.ndarray, groups: int = 1) -> np.ndarray:
    """Tokens ``(N, D)`` without a leading class token: one that leaves a square (of each group) without it."""
    n = len(tokens)
    if square_side(n // groups) and n % groups == 0 and square_side(n // groups) ** 2 * groups == n:
        return tokens
    if n > 1 and (n - 1) % groups == 0 and square_side((n - 1) // groups):
        return tokens[1:]
    return tokens


def grid_of(tokens: np.ndarray) -> np.ndarray:
    """``(D, s, s)`` of patch tokens; of a number that is no square their mean as one cell."""
    p = patches(tokens)
    s = square_side(len(p))
    return p.mean(0)[:, None, None] if s is None else p.T.reshape(-1, s, s)


def grouped(tokens: np.ndarray, groups: int, how: str = "mean") -> np.ndarray:
    """``(D, s, s)`` over groups of equally many patch tokens, cell by cell; tokens that don't divide into squares are one
    cell."""
    p = patches(tokens, groups)
    s = square_side(len(p) // groups) if len(p) % groups == 0 else None
    if s is None:
        return POOL[how](p, axis=0)[:, None, None]
    return POOL[how](p.reshape(groups, s * s, -1), axis=0).T.reshape(-1, s, s)


def merged(maps: list[np.ndarray], how: str = "mean") -> np.ndarray:
    """Maps ``(D, p, p)`` of groups at several resolutions, brought to the finest: their ``mean``, ``sum`` or ``concat``."""
    if not maps:
        raise ModelError("no groups")
    side = max(m.shape[-1] for m in maps)
    same = [m if m.shape[-1] == side else bilinear(m, side, side) for m in maps]
    if how == "concat":
        return np.concatenate(same)
    if how not in ("mean", "sum"):
        raise ModelError(f"no merge {how!r}")
    return np.sum(same, axis=0) / (len(same) if how == "mean" else 1)


def over_time(tokens: np.ndarray, mask: np.ndarray | None = None, how: str = "mean", window: tuple[float, float, float, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pooled ``(D,)`` and grid ``(D, H, W)`` of tokens ``(H, W, T, S, D)``: over time and band sets, of unmasked ones
    (``mask`` ``(H, W, T, S)``) in the window."""
    seen = np.ones(tokens.shape[:-1], bool) if mask is None else mask.astype(bool)
    if window is not None and not full(window):
        y0, y1, x0, x1 = token_box(window, *tokens.shape[:2])
        tokens, seen = tokens[y0:y1, x0:x1], seen[y0:y1, x0:x1]
    if not seen.any():
        raise ModelError("all tokens are masked")
    flat, on = tokens.reshape(-1, tokens.shape[-1]), seen.reshape(-1)
    pooled = POOL[how](flat[on], axis=0)
    v = np.where(seen[..., None], tokens, 0.0 if how == "mean" else -np.inf)
    n = seen.sum((2, 3))[..., None]
    cells = v.sum((2, 3)) / np.maximum(n, 1) if how == "mean" else np.where(n > 0, v.max((2, 3)), 0.0)
    return pooled, np.moveaxis(cells, -1, 0)


def embedding(kind: str, mode: str, how: str = "mean", tokens: np.ndarray | None = None, vector: np.ndarray | None = None, grid: np.ndarray | None = None, window: tuple[float, float, float, float] | None = None, max_honoured: bool = True) -> np.ndarray:
    """A model's output as the catalog says (``kind``: tokens, vector or grid).

    Pooled over a full window it is the pooled tokens, the model's vector or the pooled grid; over a smaller one always
    the crop of the grid, pooled. A vector model that does not know ``max`` takes the mean of the crop.
    """
    if grid is None and tokens is not None:
        grid = grid_of(tokens)
    partial = window is not None and not full(window)
    if partial and grid is not None:
        y0, y1, x0, x1 = token_box(window, *grid.shape[1:])
        grid = grid[:, y0:y1, x0:x1]
    if mode == "grid":
        if grid is None:
            raise ModelError("the model gives no grid")
        return grid
    how = how if max_honoured or kind != "vector" else "mean"
    if kind == "vector" and not partial and vector is not None:
        return vector
    if kind == "tokens" and not partial and tokens is not None:
        return POOL[how](patches(tokens), axis=0)
    if grid is None:
        raise ModelError("neither vector nor grid to pool")
    return POOL[how](grid, axis=(1, 2))
