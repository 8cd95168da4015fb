"""Stored weights of models: where they lie, what is in them, and which of several layouts a network expects."""

from __future__ import annotations

import os
import re

import numpy as np

from rasterloom.plans.errors import ModelError

# Under which names checkpoints keep the weights, and prefixes that wrappers put before them.
WRAPPED = ("state_dict", "model_state_dict", "model", "encoder", "module", "teacher", "student")
PREFIXES = ("module.", "model.", "encoder.", "backbone.", "_orig_mod.", "teacher.", "student.")


def located(name: str, path: str | None = None, env: str | None = None, cache: str | None = None, least_bytes: int = 1) -> str:
    """The file of a model's weights: the path given, else the environment's, else ``name`` in the cache folder. ModelError
    if there is none or it is too small to be whole. Nothing is downloaded."""
    tried = [p for p in (path, os.environ.get(env) if env else None, os.path.join(cache, name) if cache else None) if p]
    for p in tried:
        if os.path.isfile(p):
            if os.path.getsize(p) < least_bytes:
                raise ModelError(f"{p} has {os.path.getsize(p)} bytes, at least {least_bytes} are expected")
            return p
        if p in (path, os.environ.get(env) if env else None):
            raise ModelError(f"no weights at {p}")
    raise ModelError(f"no weights {name}; looked in {', '.join(tried) or 'no place'}")


def unwrapped(state: dict) -> dict:
    """The mapping from names to arrays, however deep it is wrapped."""
    while isinstance(state, dict) and not any(hasattr(v, "shape") for v in state.values()):
        inner = next((state[k] for k in WRAPPED if isinstance(state.get(k), dict)), None)
        if inner is None:
            raise ModelError(f"no weights among {', '.join(map(str, list(state)[:5]))}")
        state = inner
    return {k: v for k, v in state.items() if hasattr(v, "shape")}


def stripped(state: dict, prefixes: tuple[str, ...] = PREFIXES) -> dict:
    """Names without the prefixes that all of them have, one after another."""
    while True:
        p = next((p for p in prefixes if state and all(k.startswith(p) for k in state)), None)
        if p is None:
            return state
        state = {k[len(p) :]: v for k, v in state.items()}


def best_match(state: dict, wanted: dict[str, tuple[int, ...]], prefixes: tuple[str, ...] = PREFIXES) -> tuple[dict, list[str], list[str]]:
    """Of the readings of ``state`` (as it is, or the part under a prefix) the one that fills most of ``wanted`` (name to
    shape); with what is missing and what is left over. ModelError if none fills any."""
    readings = [state, stripped(state, prefixes), *({k[len(p) :]: v for k, v in state.items() if k.startswith(p)} for p in prefixes)]
    fits = lambda s: {k: v for k, v in s.items() if k in wanted and tuple(v.shape) == tuple(wanted[k])}
    best = max((fits(s) for s in readings), key=len)
    if not best:
        raise ModelError("none of the weights fits the network")
    used = next(s for s in readings if len(fits(s)) == len(best))
    return best, sorted(wanted.keys() - best.keys()), sorted(used.keys() - best.keys())


def shifted(state: dict, stem: str, delta: int) -> dict:
    """Weights whose numbered blocks (``stem.3.…``) are counted from another number."""
    at = re.compile(rf"^{re.escape(stem)}\.(\d+)\.")
    return {at.sub(lambda m: f"{stem}.{int(m[1]) + delta}.", k): v for k, v in state.items()}


def depth_of(state: dict, stem: str) -> int:
    """How many numbered blocks there are."""
    found = [int(m[1]) for k in state if (m := re.match(rf"^{re.escape(stem)}\.(\d+)\.", k))]
    return max(found) + 1 if found else 0


def verified(state: dict, name: str, near_zero: bool = False) -> dict:
    """``state`` if its first array is finite and, if asked, not all about 0; ModelError otherwise."""
    first = next(iter(state.values()), None)
    if first is None:
        raise ModelError(f"{name} has no parameters")
    a = np.asarray(first, np.float64)
    if not np.isfinite(a).all():
        raise ModelError(f"{name}: the first parameter is not finite")
    if near_zero and a.std() < 1e-6 and np.abs(a).max() < 1e-5:
        raise ModelError(f"{name}: the first parameter is about zero")
    return state


def device(wish: str = "auto") -> str:
    """``auto`` is the first accelerator that the worker's environment shows, else the processor."""
    wish = (wish or "auto").strip().lower()
    if wish != "auto":
        return wish
    return "cuda" if os.environ.get("CUDA_VISIBLE_DEVICES", "").strip() not in ("", "-1") else "cpu"
