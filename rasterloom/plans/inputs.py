"""A model's input as its catalog entry says: the scan, its frames, one fetch for several models, and what goes in beside it.

Models that take squares get the square around a region, with the window that the region has in it. Models that scan
alike share one fetch of the union of their bands, stored once; each then takes its channels from it.
"""

from __future__ import annotations

import os
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.common import materialize
from rasterloom.functions import spatial, temporal
from rasterloom.plans import catalog
from rasterloom.plans.errors import ModelError, SpecError

WINDOW = ("y0", "y1", "x0", "x1")
BOX = ("minlon", "minlat", "maxlon", "maxlat")


def config_value(config, key: str, default=None):
    """A value of a model's configuration, a mapping or an object; the default where it has none."""
    value = config.get(key) if isinstance(config, dict) else getattr(config, key, None)
    return default if value is None else value


def setting(config, key: str, env: str, default, allowed: tuple = ()):
    """By the model's configuration, else the environment, else the default; of the default's type. SpecError for what
    cannot be read or is not allowed."""
    given = config_value(config or {}, key)
    text = given if given is not None else os.environ.get(env) or None
    if text is None:
        return default
    try:
        if isinstance(default, bool):
            known = {"1": True, "true": True, "yes": True, "y": True, "on": True, "0": False, "false": False, "no": False, "n": False, "off": False}
            value = text if isinstance(text, bool) else known[str(text).strip().lower()]
        elif isinstance(default, (int, float)):
            value = type(default)(text)
        else:
            value = str(text).strip().lower()
    except (KeyError, ValueError) as e:
        raise SpecError(f"{key}: {text!r} is no {type(default).__name__}") from e
    if allowed and value not in allowed:
        raise SpecError(f"{key}: {value!r} is none of {', '.join(map(str, allowed))}")
    return value


def temporal_mode(config, days: int, entry: catalog.Entry) -> tuple[str, int]:
    """``single`` or ``multi`` and the number of frames: as configured, else by what the window is worth."""
    mode = setting(config, "temporal_mode", "RASTERLOOM_TEMPORAL_MODE", "auto", ("auto", "single", "multi"))
    asked = config_value(config or {}, "n_frames")
    n = catalog.frame_count(entry, days, None if asked is None else int(asked))
    if mode == "single":
        n = 1
    elif mode == "multi" and n < 2:
        raise SpecError(f"{entry.name}: {days} days are worth one frame")
    return ("multi" if n > 1 else "single"), n


def squared(requests: DataFrame) -> DataFrame:
    """``requests`` with the square around each box, and the window of the box in it."""
    s = spatial.square_roi(*[F.col(c) for c in BOX])
    return requests.withColumn("__s", s).select(*[c for c in requests.columns if c not in BOX], *[F.col(f"__s.{c}").alias(c) for c in (*BOX, *WINDOW)])


def model_input(provider, requests: DataFrame, name: str, sensor: catalog.Sensor | None = None, fetch: dict | None = None, modality: str | None = None, square: bool = True) -> DataFrame:
    """Images of the requests for a model: with the window of the region, where squares are fetched."""
    entry = catalog.entry(name)
    if entry.kind == "precomputed":
        raise ModelError(f"{entry.name} is a product: it has no input")
    scan = catalog.sensor_for(name, sensor, fetch, modality)
    asked = squared(requests) if square else requests
    images = provider.images(asked.drop(*WINDOW), scan)
    return images.join(asked.select("point_index", *WINDOW), "point_index", "left") if square else images


def sensor_key(sensor: catalog.Sensor, frames: int = 1) -> tuple:
    """What two scans must share to be one fetch: everything but the bands."""
    return (replace(sensor, bands=()), frames)


def shared_scans(sensors: dict[str, catalog.Sensor], frames: dict[str, int] | None = None) -> list[tuple[catalog.Sensor, dict[str, tuple[int, ...]]]]:
    """``(sensor, {model: channels})``: models that scan alike, the union of their bands in order of first use, and which of
    its channels each takes."""
    groups: dict[tuple, list[str]] = {}
    for model, s in sensors.items():
        groups.setdefault(sensor_key(s, (frames or {}).get(model, 1)), []).append(model)
    out = []
    for members in groups.values():
        bands = tuple(dict.fromkeys(b for m in members for b in sensors[m].bands))
        out.append((replace(sensors[members[0]], bands=bands), {m: tuple(bands.index(b) for b in sensors[m].bands) for m in members}))
    return out


class Prefetched:
    """What several models need of one set of requests, fetched once per scan and stored in the shared folder.

    ``of(model)`` are its images; a scan that fails makes the images of its models rows with an ``error``, no others. What is
    fetched already is not fetched again.
    """

    def __init__(self, provider, requests: DataFrame, sensors: dict[str, catalog.Sensor]) -> None:
        self.provider, self.requests, self.sensors = provider, requests, sensors
        self.plan = shared_scans(sensors)
        self.stored: dict[int, DataFrame] = {}
        self.errors: dict[int, str] = {}
        self.hits = 0

    def _scan(self, i: int) -> DataFrame | None:
        if i in self.stored or i in self.errors:
            self.hits += 1
        else:
            try:
                images = self.provider.images(self.requests, self.plan[i][0])
                if "error" not in images.columns:
                    images = images.withColumn("error", F.lit(None).cast("string"))
                self.stored[i] = materialize(images.select("point_index", *[F.col(c).cast("int").alias(c) for c in ("c", "h", "w")], F.col("pixels").cast("array<float>").alias("pixels"), "error"), "scan")
            except Exception as e:  # any scan may fail; its models' rows say how
                self.errors[i] = f"{type(e).__name__}: {e}"[:500]
        return self.stored.get(i)

    def of(self, model: str) -> DataFrame:
        i = next(k for k, (_, members) in enumerate(self.plan) if model in members)
        images, channels = self._scan(i), self.plan[i][1][model]
        if images is None:
            null = lambda t: F.lit(None).cast(t)
            return self.requests.select("point_index", *[null("int").alias(c) for c in ("c", "h", "w")], null("array<float>").alias("pixels"), F.lit(self.errors[i]).alias("error"))
        return taken(images, channels)


def taken(images: DataFrame, channels: tuple[int, ...]) -> DataFrame:
    """Images with some of their channels, in order; one that lacks a channel is a row with an error."""
    size = F.col("h") * F.col("w")
    parts = [F.slice("pixels", F.lit(k) * size + 1, size) for k in channels]
    enough = (F.col("c") > max(channels)) & F.col("pixels").isNotNull()
    error = F.coalesce("error", F.when(~F.coalesce(enough, F.lit(False)), F.lit(f"no channel {max(channels)}")))
    return images.select("point_index", F.lit(len(channels)).alias("c"), "h", "w", F.when(enough, F.concat(*parts)).alias("pixels"), error.alias("error"))


def summary(prefetched: Prefetched) -> dict[str, int]:
    """How many scans were made, failed, and were asked for again."""
    return {"total": len(prefetched.plan), "completed": len(prefetched.stored), "failed": len(prefetched.errors), "cache_hits": prefetched.hits}


def beside(requests: DataFrame, frames: int = 1) -> DataFrame:
    """``point_index`` and what models take beside the pixels, one entry per frame of the window: ``dates`` (midpoints),
    ``doy0``, ``month0``, ``calendar``, ``years_doys``, cyclic ``place`` and ``centre``."""
    bins = temporal.equal_bins(F.col("start"), F.col("end"), frames)
    rows = requests.withColumn("dates", F.transform(bins, lambda b: temporal.midpoint(b["start"], b["end"])))
    c = spatial.centre(*[F.col(b) for b in BOX])
    return rows.select(
        "point_index", "dates", F.transform("dates", temporal.day_of_year0).alias("doy0"), F.transform("dates", lambda d: F.month(d) - 1).alias("month0"),
        F.transform("dates", temporal.calendar_parts).alias("calendar"), F.transform("dates", temporal.year_doy).alias("years_doys"),
        spatial.cyclic_place(c["lon"], c["lat"]).alias("place"), c.alias("centre"),
    )


def fitted(values, n: int) -> list:
    """``n`` entries: cut, or the last repeated."""
    v = list(values)
    if not v:
        raise ModelError("nothing to repeat")
    return (v + [v[-1]] * (n - len(v)))[:n]
