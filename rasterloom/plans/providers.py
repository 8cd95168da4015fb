"""Where input comes from: a registry of providers, their contract, and one over a table of scene pixels.

A provider makes images (``point_index, c, h, w, pixels``) of requests (``point_index, minlon, minlat, maxlon, maxlat,
start, end``). It plans; nothing is fetched before a query runs.
"""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable

from pyspark.sql import DataFrame

from rasterloom.operators import fetch
from rasterloom.plans.catalog import Sensor
from rasterloom.plans.errors import ProviderError

DEFAULT = "RASTERLOOM_PROVIDER"
_registered: dict[str, object] = {}
_lazy: dict[str, str] = {}
_failed: dict[str, str] = {}
_made: dict[str, object] = {}


class Provider:
    """The contract; a provider may leave out what it cannot do."""

    def ready(self) -> None:
        """Raise ProviderError if nothing can be had now; called each time the provider is handed out."""

    def images(self, requests: DataFrame, sensor: Sensor | None = None) -> DataFrame:
        raise ProviderError(f"{type(self).__name__} has no images")

    def frames(self, requests: DataFrame, sensor: Sensor, n: int) -> DataFrame:
        raise ProviderError(f"{type(self).__name__} has no series")

    def all_bands(self, requests: DataFrame, collection: str) -> DataFrame:
        raise ProviderError(f"{type(self).__name__} does not list bands")


class Pixels(Provider):
    """Over a table of scene pixels, see :mod:`rasterloom.operators.fetch`."""

    def __init__(self, pixels: DataFrame) -> None:
        self.pixels = pixels

    def images(self, requests: DataFrame, sensor: Sensor | None = None) -> DataFrame:
        if sensor is None:
            raise ProviderError("what is to be scanned? a sensor is needed")
        return fetch.assembled(fetch.patch(self.pixels, requests, sensor), sensor.bands)

    def frames(self, requests: DataFrame, sensor: Sensor, n: int) -> DataFrame:
        return fetch.series(self.pixels, requests, sensor, n)

    def all_bands(self, requests: DataFrame, collection: str) -> DataFrame:
        return fetch.every_band(self.pixels, requests, collection)


class Function(Provider):
    """A function of requests, whatever the sensor."""

    def __init__(self, make: Callable[[DataFrame], DataFrame]) -> None:
        self.make = make

    def images(self, requests: DataFrame, sensor: Sensor | None = None) -> DataFrame:
        return self.make(requests)


def register_provider(name: str, provider: object) -> None:
    """``provider``: an instance or class of :class:`Provider`, a function of requests, or the text ``module:name`` of one,
    imported when it is first asked for."""
    key = str(name).strip().lower()
    if not key or key == "auto":
        raise ProviderError(f"no name for a provider: {name!r}")
    _made.pop(key, None)
    if isinstance(provider, str):
        _lazy[key] = provider
    else:
        _registered[key] = provider


def has_provider(name: str) -> bool:
    key = str(name or "").strip().lower()
    return bool(key) and (key in _registered or key in _lazy)


def list_providers() -> list[str]:
    return sorted({*_registered, *_lazy})


def default_provider() -> str | None:
    """The one named in the environment, if registered; else ``default``; else the first registered; else none."""
    wish = os.environ.get(DEFAULT, "").strip().lower()
    for name in (wish, "default", *_registered, *_lazy):
        if has_provider(name):
            return name
    return None


def resolve_provider(name: str = "auto") -> Provider:
    """One instance per name, ready. ProviderError names those there are and why one could not be imported."""
    key = str(name or "auto").strip().lower()
    if key == "auto":
        key = default_provider() or "auto"
    if key not in _registered and key in _lazy:
        module, _, attribute = _lazy[key].partition(":")
        try:
            _registered[key] = getattr(importlib.import_module(module), attribute)
        except (ImportError, AttributeError) as e:
            _failed[key] = str(e)
    if key not in _registered:
        why = f" ({_failed[key]})" if key in _failed else ""
        raise ProviderError(f"no provider {name!r}{why}; there are {', '.join(list_providers()) or 'none'}")
    if key not in _made:
        p = _registered[key]
        _made[key] = p() if isinstance(p, type) else p if isinstance(p, Provider) else Function(p)
    _made[key].ready()
    return _made[key]


def reset() -> None:
    """Forget instances and failed imports; what is registered stays."""
    _made.clear()
    _failed.clear()
