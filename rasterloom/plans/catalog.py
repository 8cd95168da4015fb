"""The model catalog: what each known model reads, how its input is scaled, and what ``pooled`` means for it.

A forward pass is registered by the caller (``plans.models.register``); everything before and after it is planned from
the catalog's row.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from rasterloom.plans.errors import ModelError, SpecError

# Collections and bands of the public products that the models read.
S2 = "COPERNICUS/S2_SR_HARMONIZED"
S1, S1_FLOAT = "COPERNICUS/S1_GRD", "COPERNICUS/S1_GRD_FLOAT"
RGB = ("B4", "B3", "B2")
PRITHVI = ("BLUE", "GREEN", "RED", "NIR_NARROW", "SWIR_1", "SWIR_2")
S2_9 = ("B4", "B3", "B2", "B5", "B6", "B7", "B8", "B11", "B12")
S2_10 = ("B2", "B3", "B4", "B5", "B6", "B7", "B8", "B8A", "B11", "B12")
S2_12 = ("B1", "B2", "B3", "B4", "B5", "B6", "B7", "B8", "B8A", "B9", "B11", "B12")
MODIS_14 = ("1", "2", "3", "26", "6", "20", "7", "27", "28", "29", "31", "32", "33", "34")


@dataclass(frozen=True)
class Sensor:
    """What is scanned, and how scenes become one image."""

    collection: str
    bands: tuple[str, ...] = ()
    scale_m: int = 10
    cloudy_pct: int | None = 30
    fill_value: float = 0.0
    composite: str = "median"
    modality: str = "s2"
    orbit: str | None = None
    float_linear: bool = True
    require_iw: bool = True
    relax_iw: bool = True
    check_input: bool = False
    check_raise: bool = True

    def __post_init__(self) -> None:
        if self.composite not in ("median", "mosaic"):
            raise SpecError(f"no composite {self.composite!r}")
        if self.scale_m <= 0:
            raise SpecError("a scale is positive")


@dataclass(frozen=True)
class Entry:
    """A model. ``frames``: 1, a fixed number, or ``(1, most)`` chosen by the window. ``pool_kind``: what the pooled vector
    of a full window is taken from. ``fit``: how a rectangle becomes the model's square."""

    name: str
    kind: str
    sensor: Sensor
    image_size: int | None
    normalisation: str
    pool_kind: str
    max_honoured: bool = True
    frames: int | tuple[int, int] = 1
    also: tuple[str, ...] = ()
    fit: str = "stretch"
    image_level: bool = False
    backends: tuple[str, ...] = ("provider",)
    outputs: tuple[str, ...] = ("pooled", "grid")
    year_only: bool = False
    own_prep: bool = False


def _fly(name: str, bands: tuple[str, ...], size: int | None, norm: str, pool: str, scale: int = 10, **more) -> Entry:
    return Entry(name, "onthefly", Sensor(S2, bands, scale), size, norm, pool, **more)


# The models with their scans, sizes and rules, one per line.
MODELS = {
    e.name: e
    for e in (
        Entry("gse", "precomputed", Sensor("GOOGLE/SATELLITE_EMBEDDING/V1/ANNUAL", tuple(f"A{i:02d}" for i in range(64)), 10, None, -9999.0, "mosaic", "embedding"), None, "nodata", "grid", backends=("provider",), year_only=True),
        Entry("remoteclip", "onthefly", Sensor(S2, RGB), 224, "rgb8", "vector", max_honoured=False),
        Entry("copernicus", "precomputed", Sensor("COPERNICUS/EMBED/0.25DEG", (), 27_750, None, 0.0, "mosaic", "embedding"), None, "none", "grid", backends=("auto", "local"), year_only=True),
        Entry("tessera", "precomputed", Sensor("TESSERA/TILES", (), 10, None, 0.0, "mosaic", "embedding"), None, "none", "grid", backends=("auto", "local"), year_only=True),
        _fly("satmae", RGB, 224, "fmow", "tokens", image_level=True),
        _fly("satmaepp", RGB, 224, "fmow", "tokens", image_level=True),
        _fly("scalemae", RGB, 224, "imagenet", "tokens", image_level=True),
        _fly("anysat", S2_10, 24, "tile_zscore", "grid", frames=8, fit="pad"),
        _fly("galileo", S2_10, 64, "unit", "tokens", frames=(1, 12), fit="pad"),
        _fly("wildsat", RGB, 224, "rgb8_minmax", "vector", max_honoured=False),
        _fly("prithvi", PRITHVI, 224, "unit", "tokens", 30, frames=(1, 4), fit="pad"),
        _fly("terrafm", S2_12, 224, "unit", "vector", max_honoured=False, also=("s1",)),
        _fly("terramind", S2_12, 224, "s2_twelve_v1", "tokens"),
        _fly("dofa", S2_9, 224, "s2_nine_255", "vector", max_honoured=False, fit="pad"),
        _fly("fomo", S2_12, 64, "unit", "tokens", fit="pad"),
        _fly("thor", S2_10, 288, "s2_ten_unit", "tokens", also=("s1",), own_prep=True),
        _fly("agrifm", S2_10, 224, "s2_ten_agri", "grid", frames=8, fit="pad"),
        Entry("satvision", "onthefly", Sensor("MODIS/061/MOD021KM", MODIS_14, 1000, None, modality="toa"), 128, "toa", "tokens"),
        _fly("olmoearth", S2_12, 256, "external", "tokens", frames=(1, 12), also=("s1",)),
        _fly("clay", S2_10, 256, "s2_ten_a", "vector", max_honoured=False, fit="pad"),
    )
}
# Other names of the models.
ALIASES = {
    "gse_annual": "gse",
    "remoteclip_s2rgb": "remoteclip",
    "copernicus_embed": "copernicus",
    "satmae_rgb": "satmae",
    "satmaepp_rgb": "satmaepp",
    "satmae++": "satmaepp",
    "scalemae_rgb": "scalemae",
    "prithvi_eo_v2_s2_6b": "prithvi",
    "terrafm_b": "terrafm",
    "thor_1_0_base": "thor",
    "satvision_toa": "satvision",
}
MODALITIES = {"sentinel1": "s1", "sentinel-1": "s1", "sentinel2": "s2", "sentinel-2": "s2"}


def model_id(name: str) -> str:
    key = str(name).strip().lower()
    return ALIASES.get(key, key)


def entry(name: str) -> Entry:
    key = model_id(name)
    if key not in MODELS:
        raise ModelError(f"no model {name!r}; there are {', '.join(sorted(MODELS))}")
    return MODELS[key]


def list_models(spark: SparkSession, aliases: bool = False) -> DataFrame:
    """``model, kind, collection, n_bands, image_size, frames, normalisation, pool_kind, max_honoured``, sorted; with
    ``aliases`` a row for each other name, too (``alias_of``)."""
    rows = [(e.name, None, e) for e in MODELS.values()] + ([(a, m, MODELS[m]) for a, m in ALIASES.items()] if aliases else [])
    most = lambda f: f if isinstance(f, int) else f[1]
    out = [(n, of, e.kind, e.sensor.collection, len(e.sensor.bands), e.image_size, most(e.frames), e.normalisation, e.pool_kind, e.max_honoured) for n, of, e in rows]
    return spark.createDataFrame(sorted(out), "model string, alias_of string, kind string, collection string, n_bands int, image_size int, frames int, normalisation string, pool_kind string, max_honoured boolean").orderBy("model")


def modality_of(name: str) -> str:
    key = str(name).strip().lower()
    return MODALITIES.get(key, key)


def supports(name: str, modality: str) -> bool:
    e = entry(name)
    return modality_of(modality) in (e.sensor.modality, *e.also)


def overridden(sensor: Sensor, fetch: dict | None) -> Sensor:
    """A sensor with the scale, cloud limit, fill value and composite of ``fetch`` that are not None."""
    given = {k: v for k, v in (fetch or {}).items() if v is not None}
    unknown = given.keys() - {"scale_m", "cloudy_pct", "fill_value", "composite"}
    if unknown:
        raise SpecError(f"a fetch has no {', '.join(sorted(unknown))}")
    return replace(sensor, **given)


def sensor_for(name: str, sensor: Sensor | None = None, fetch: dict | None = None, modality: str | None = None) -> Sensor:
    """The scan of a model: a sensor given, or its default for the modality, with what ``fetch`` overrides. SpecError for
    both a sensor and a fetch, and for a modality the model does not read or the sensor contradicts."""
    e = entry(name)
    if sensor is not None and fetch is not None:
        raise SpecError("either a sensor or a fetch, not both")
    if modality is not None and not supports(name, modality):
        raise SpecError(f"{e.name} reads {', '.join((e.sensor.modality, *e.also))}, not {modality!r}")
    if sensor is not None:
        if modality is not None and modality_of(modality) != modality_of(sensor.modality):
            raise SpecError(f"modality {modality!r} against a sensor of {sensor.modality!r}")
        return sensor
    base = e.sensor
    if modality is not None and modality_of(modality) == "s1" and e.sensor.modality != "s1":
        base = Sensor(S1_FLOAT, ("VV", "VH"), e.sensor.scale_m, None, modality="s1")
    return overridden(base, fetch)


def check(name: str, backend: str = "auto", output: str = "pooled", ranged: bool = False) -> list[str]:
    """Warnings for a request; ModelError for one the model cannot serve. A backend that is a provider's name counts as
    ``provider``; ``auto`` is any of the model's."""
    e, said = entry(name), []
    b = str(backend).strip().lower() or "auto"
    from rasterloom.plans import providers

    kinds = {b, "provider"} if providers.has_provider(b) else {b}
    if b != "auto" and not kinds & set(e.backends):
        raise ModelError(f"{e.name} runs on {', '.join(e.backends)}, not {backend!r}")
    if output not in e.outputs:
        raise ModelError(f"{e.name} gives {', '.join(e.outputs)}, not {output!r}")
    if e.year_only and ranged:
        said.append(f"{e.name} is made by year: the year of the range's start counts")
    return said


def frame_count(e: Entry, days: int, asked: int | None = None, stride_days: int | None = None) -> int:
    """How many frames a window of ``days`` is worth: those asked for, the fixed number, or one per stride."""
    if asked is not None:
        if asked < 1:
            raise SpecError("at least one frame")
        return asked
    if isinstance(e.frames, int):
        return e.frames
    low, most = e.frames
    stride = stride_days or (28 if most == 4 else 30)
    return min(max(days // stride if most == 4 else -(-days // stride), low), most)
