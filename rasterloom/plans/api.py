"""The public entry points: embeddings for regions of interest, exports, inspection, loading.

Input comes from a provider (``plans.providers``), is prepared and embedded by ``plans.inference`` and stored as Parquet,
from which array files of other formats are written. :func:`from_pixels` makes a provider of a pixel table.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from dataclasses import asdict, dataclass
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.strings import fingerprint
from rasterloom.operators import export, guards, inspection, manifests
from rasterloom.plans import catalog, inputs, models
from rasterloom.plans.errors import ModelError, SpecError
from rasterloom.plans.inference import InputPrep, Output, embed
from rasterloom.plans.providers import Provider, has_provider, list_providers, register_provider, resolve_provider
from rasterloom.sources import labels, netcdf, npz, quicklook, storage

__all__ = ["BBox", "Export", "InputPrep", "Model", "Output", "Period", "PointBuffer", "Provider", "export_batch", "from_pixels", "get_embedding", "get_embeddings_batch", "has_provider", "inspect_images", "inspect_model_input", "inspect_provider_patch", "list_providers", "load_export", "register_provider", "resolve_provider"]


@dataclass(frozen=True)
class BBox:
    minlon: float
    minlat: float
    maxlon: float
    maxlat: float
    crs: str = "EPSG:4326"

    def __post_init__(self) -> None:
        if self.crs != "EPSG:4326":
            raise SpecError("boxes are in EPSG:4326")
        if not (-180 <= self.minlon < self.maxlon <= 180 and -90 <= self.minlat < self.maxlat <= 90):
            raise SpecError(f"not a box: {self}")


@dataclass(frozen=True)
class PointBuffer:
    lon: float
    lat: float
    buffer_m: float
    crs: str = "EPSG:4326"

    def __post_init__(self) -> None:
        if self.crs != "EPSG:4326" or not self.buffer_m > 0:
            raise SpecError(f"not a point with a buffer: {self}")


@dataclass(frozen=True)
class Period:
    """[start, end); :meth:`year` is a calendar year."""

    start: date
    end: date
    mode: str = "range"

    def __post_init__(self) -> None:
        if not self.start < self.end:
            raise SpecError("a period starts before it ends")

    @classmethod
    def year(cls, y: int) -> Period:
        if not 1 <= y <= 9998:
            raise SpecError(f"not a year: {y}")
        return cls(date(y, 1, 1), date(y + 1, 1, 1), "year")

    @classmethod
    def range(cls, start: str, end: str) -> Period:
        return cls(date.fromisoformat(start), date.fromisoformat(end))


def from_pixels(pixels: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A provider of a long table ``point_index, band, y, x, value``: images of whole rectangles, missing pixels 0."""

    def provide(requests: DataFrame) -> DataFrame:
        size = pixels.groupBy("point_index").agg(*[(F.max(a) + 1).alias(b) for a, b in (("band", "c"), ("y", "h"), ("x", "w"))])
        at = (F.col("band") * F.col("h") + F.col("y")) * F.col("w") + F.col("x")
        rows = pixels.join(size, "point_index").groupBy("point_index", "c", "h", "w").agg(F.map_from_entries(F.collect_list(F.struct(at.cast("int").alias("k"), F.col("value").alias("v")))).alias("m"))
        flat = F.transform(F.sequence(F.lit(0), F.col("c") * F.col("h") * F.col("w") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
        return requests.join(rows, "point_index", "left").select("point_index", "c", "h", "w", flat.alias("pixels"))

    return provide


def requests_of(spark: SparkSession, spatials: list, period: Period | None) -> DataFrame:
    """One row per region, in the order given; a point stands for the square of its buffer."""
    from rasterloom.functions.spatial import buffer_box

    if not isinstance(spatials, (list, tuple)) or not spatials:
        raise SpecError("a list of regions is needed, and it must not be empty")
    wrong = [i for i, s in enumerate(spatials) if not isinstance(s, (BBox, PointBuffer))]
    if wrong:
        raise SpecError(f"region {wrong[0]} is neither a box nor a point with a buffer")
    names = ("minlon", "minlat", "maxlon", "maxlat", "lon", "lat", "buffer_m")
    rows = [(i, *(None if (v := getattr(s, n, None)) is None else float(v) for n in names)) for i, s in enumerate(spatials)]
    df = spark.createDataFrame(rows, "point_index bigint, minlon double, minlat double, maxlon double, maxlat double, lon double, lat double, buffer_m double")
    box = buffer_box(F.col("lon"), F.col("lat"), F.col("buffer_m"))
    start, end = (period.start, period.end) if period else (None, None)
    return df.select("point_index", *[F.coalesce(c, box[c]).alias(c) for c in ("minlon", "minlat", "maxlon", "maxlat")], F.lit(start).cast("date").alias("start"), F.lit(end).cast("date").alias("end"))


def _images(requests: DataFrame, provider: str, name: str | None, sensor=None, fetch: dict | None = None, modality: str | None = None) -> DataFrame:
    """The provider's images of the requests. For a model of the catalog they are scanned as its entry and the caller say:
    the squares around the regions, with the window that the region has in its square."""
    p = resolve_provider(provider)
    if name is not None and catalog.model_id(name) in catalog.MODELS:
        if catalog.entry(name).kind == "precomputed":
            return p.images(requests, catalog.sensor_for(name, sensor, fetch, modality))
        return inputs.model_input(p, requests, name, sensor, fetch, modality)
    if fetch is not None:
        raise SpecError("only models of the catalog have a scan to be overridden")
    return p.images(requests, sensor)


def _checked(name: str, output: Output, backend: str = "auto", period: Period | None = None) -> str:
    models.get(name)
    key = name.strip().lower()
    outputs = models.factories()[key].outputs
    if output.mode not in outputs:
        raise ModelError(f"{name} gives {', '.join(outputs)}, not {output.mode!r}")
    if catalog.model_id(key) in catalog.MODELS:
        for said in catalog.check(key, backend, output.mode, period is not None and period.mode == "range"):
            guards.warn(said)
    return key


def get_embeddings_batch(spark: SparkSession, model: str, spatials: list, period: Period | None = None, provider: str = "auto", output: Output = Output(), prep: InputPrep | str | None = None, sensor=None, fetch: dict | None = None, modality: str | None = None) -> DataFrame:
    """``point_index, model, status, embedding, shape, meta, error``: one model on many regions, a row for each. Sort by
    ``point_index`` for their order."""
    name = _checked(model, output, provider, period)
    return embed(_images(requests_of(spark, spatials, period), provider, name, sensor, fetch, modality), [name], output, prep)


def get_embedding(spark: SparkSession, model: str, spatial, period: Period | None = None, provider: str = "auto", output: Output = Output(), prep: InputPrep | str | None = None, **scan) -> list[float]:
    """The vector, or the flattened grid, of one region; ModelError with the row's error."""
    row = get_embeddings_batch(spark, model, [spatial], period, provider, output, prep, **scan).first()
    if row.status != "ok":
        raise ModelError(row.error)
    return row.embedding


def export_batch(spark: SparkSession, spatials: list, names: list[str], path: str, period: Period | None = None, output: Output = Output(), provider: str = "auto", prep: InputPrep | str | None = None, layout: str = "combined", file_format: str = "parquet", retries: int = 0) -> DataFrame:
    """Every model on every region, stored below ``path``; what is stored under the same fingerprint is not run again.

    The fingerprint holds all that bears on the rows: model, region, window, output and input preparation. With a format
    of array files, those are written beside the store, ``combined`` or one ``per_item``, each with its manifest.
    """
    kind = labels.export_format(file_format)
    if layout not in ("combined", "per_item"):
        raise SpecError(f"no layout {layout!r}")
    keys = [_checked(m, output, provider, period) for m in names]
    if len(set(keys)) != len(keys):
        raise SpecError("a model is named twice")
    prep = InputPrep.of(prep)
    requests = requests_of(spark, spatials, period)
    wanted = requests.crossJoin(F.broadcast(spark.createDataFrame([(m,) for m in keys], "model string")))  # a few names
    how = json.dumps({"output": asdict(output), "prep": asdict(prep)}, sort_keys=True)
    wanted = wanted.withColumn("fingerprint", fingerprint(*[F.col(c) for c in ("model", "minlon", "minlat", "maxlon", "maxlat", "start", "end")], F.lit(how)))

    def run(left: DataFrame) -> DataFrame:
        out = None
        for name in keys:
            mine = left.filter(F.col("model") == name)
            made = guards.retried(lambda m=name, r=mine: embed(_images(r.drop("model", "fingerprint"), provider, m), [m], output, prep), retries)
            out = made if out is None else out.unionByName(made)
        return out.join(left.select("point_index", "model", "fingerprint"), ["point_index", "model"])

    store = path if kind == "parquet" else f"{path}/_store"
    rows = export.resume(wanted, store, run, spark)
    if kind != "parquet":
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<float>"))
        write_files(rows, path, kind, layout).collect()  # a row per file
    return rows


def write_files(rows: DataFrame, path: str, kind: str, layout: str) -> DataFrame:
    """``path, n, error`` of array files of ``rows``: ``pNNNNN`` per point, or some files ``part-…`` for all; each has its
    manifest beside it. A file that cannot be written is a row with its error and a failure manifest."""
    ending = labels.FORMATS[kind]
    per_item = layout == "per_item"

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        name = f"p{int(key[0]):05d}" if per_item else f"part-{int(key[0]):05d}"
        manifest: dict = {"point_index": int(key[0])} if per_item else {}
        try:
            arrays, listed = npz.stacked(sorted(b.itertuples(), key=lambda r: (r.model, r.point_index)))
            storage.write(f"{path}/{name}{ending}", netcdf.encode(arrays) if kind == "netcdf" else npz.as_npz(arrays))
            n, failed = len(b), int((b["status"] == "failed").sum())
            storage.write_json(f"{path}/{name}.json", manifest | {"models": listed, "keys": sorted(arrays), "status": "ok" if not failed else "failed" if failed == n else "partial"})
            return pd.DataFrame([(f"{path}/{name}{ending}", n, None)], columns=["path", "n", "error"])
        except (OSError, ValueError) as e:
            storage.write_json(f"{path}/{name}.failed.json", manifest | {"stage": "write", "error": guards.error_text(e)})
            return pd.DataFrame([(f"{path}/{name}{ending}", 0, guards.error_text(e))], columns=["path", "n", "error"])

    rows = rows.select("model", F.col("point_index").cast("bigint").alias("point_index"), "status", "error", "embedding", "meta")
    group = F.col("point_index") if per_item else F.floor(F.col("point_index") / 4096)
    return rows.withColumn("file", group).groupBy("file").applyInPandas(lambda key, b: run(key, b.drop(columns="file")), "path string, n int, error string")


class Export:
    """A loaded export: ``rows`` (``model, point_index, status, error, embedding, meta``) with every point of each model."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = export.aligned(rows, ["model"])
        self._stored = rows

    def models(self) -> DataFrame:
        return manifests.packed(self._stored)

    def ok_models(self) -> list[str]:
        return [r.model for r in manifests.models_of(self._stored, "ok").collect()]

    def failed_models(self) -> list[str]:
        return [r.model for r in manifests.models_of(self._stored, "failed").collect()]

    def embedding(self, model: str) -> DataFrame:
        return manifests.embedding_of(self._stored, model)


def load_export(spark: SparkSession, path: str) -> Export:
    """An export by its path: a Parquet store, a folder of array files, or one file (of ``.json`` the arrays beside it, npz
    before netCDF). FileNotFoundError where there is none or its manifest is missing, ValueError for two files of a point."""
    npz.register(spark)
    kinds = {".npz": "npz", ".nc": "netcdf", ".netcdf": "netcdf"}
    if path.endswith(".json"):
        stem = path.removesuffix(".json")
        path = next((stem + e for e in (".npz", ".nc", ".netcdf") if storage.exists(stem + e)), stem + ".npz")
    if not storage.exists(path):
        raise FileNotFoundError(f"no export at {path}")
    if not storage.is_folder(path):
        kind = next((k for e, k in kinds.items() if path.endswith(e)), None)
        if kind is None:
            raise ValueError(f"no export: {path}")
        return Export(spark.read.format(kind).load(path))
    names = [n for n in storage.names(path) if n.rpartition(".")[2] in ("npz", "nc") and not n.startswith("_")]
    if not names:
        return Export(export.load(spark, path).select("model", "point_index", "status", "error", "embedding", "meta"))
    items = [n.rpartition(".")[0] for n in names if n.startswith("p") and n[1:].partition(".")[0].isdigit()]
    if len(set(items)) != len(items):
        raise ValueError(f"two files of a point in {path}")
    return Export(spark.read.format("npz" if any(n.endswith(".npz") for n in names) else "netcdf").load(path))


def inspect_images(pixels: DataFrame, lo: float = 0.0, hi: float = 10000.0, fill: float = 0.0) -> DataFrame:
    """One row per image and band: statistics, quantiles and flags; images of many pixels by every so many of them."""
    keys = ["point_index", "band"]
    some = inspection.sampled(pixels, ["point_index"])
    return inspection.statistics(some, keys).join(inspection.quantiles(some, keys), keys).join(inspection.flags(some, keys, lo, hi, fill), keys)


def _pixels_of(images: DataFrame, order: str = "point_index") -> DataFrame:
    """Images as ``point_index, band, y, x, value``."""
    rows = images.filter("pixels is not null").select(order, "h", "w", F.posexplode("pixels").alias("k", "value"))
    return rows.select(order, F.floor(F.col("k") / (F.col("h") * F.col("w"))).cast("int").alias("band"), (F.floor(F.col("k") / F.col("w")) % F.col("h")).cast("int").alias("y"), (F.col("k") % F.col("w")).cast("int").alias("x"), "value")


def inspect_provider_patch(spark: SparkSession, spatial, sensor, period: Period | None = None, provider: str = "auto", value_range: tuple[float, float] | None = None) -> DataFrame:
    """The report of :func:`inspect_images` on what a provider gives for one region."""
    images = resolve_provider(provider).images(requests_of(spark, [spatial], period), sensor)
    return inspect_images(_pixels_of(images), *(value_range or (0.0, 10000.0)), fill=getattr(sensor, "fill_value", 0.0))


def inspect_model_input(spark: SparkSession, model: str, spatial, period: Period | None = None, provider: str = "auto", value_range: tuple[float, float] | None = None, **scan) -> DataFrame:
    """The report on a model's input for one region; ModelError for models whose product is read, not computed."""
    if catalog.model_id(model) in catalog.MODELS and catalog.entry(model).kind == "precomputed":
        raise ModelError(f"{model} is a product: it has no input")
    images = _images(requests_of(spark, [spatial], period), provider, model, **scan)
    return inspect_images(_pixels_of(images), *(value_range or (0.0, 10000.0)))


class Model:
    """The functions above with model, period, provider, output and preparation kept."""

    def __init__(self, spark: SparkSession, name: str, period: Period | None = None, provider: str = "auto", output: Output = Output(), prep: InputPrep | str | None = None) -> None:
        self.spark, self.name, self.period, self.provider = spark, name, period, provider
        self.output, self.prep = output, prep
        models.get(name)

    def describe(self) -> dict:
        return models.describe(self.name)

    def with_output(self, output: Output) -> Model:
        return Model(self.spark, self.name, self.period, self.provider, output, self.prep)

    def get_embedding(self, spatial) -> list[float]:
        return get_embedding(self.spark, self.name, spatial, self.period, self.provider, self.output, self.prep)

    def get_embeddings_batch(self, spatials: list) -> DataFrame:
        return get_embeddings_batch(self.spark, self.name, spatials, self.period, self.provider, self.output, self.prep)

    def export(self, spatials: list, path: str, **how) -> DataFrame:
        return export_batch(self.spark, spatials, [self.name], path, self.period, self.output, self.provider, self.prep, **how)

    def inspect(self, spatial) -> DataFrame:
        return inspect_model_input(self.spark, self.name, spatial, self.period, self.provider)


def main(argv: list[str] | None = None) -> int:
    """``models`` lists models; ``inspect FILE`` reports on a Parquet pixel table; ``export FILE MODELS PATH [FORMAT [LAYOUT]]``
    embeds the images of a pixel table with the models (comma-separated); ``load PATH`` sums up an export;
    ``quicklook FILE FOLDER`` stores pictures of its images. JSON by line on stdout."""
    from rasterloom.session import session

    args = sys.argv[1:] if argv is None else argv
    counts = {"models": (1, 1), "inspect": (2, 2), "export": (4, 6), "load": (2, 2), "quicklook": (3, 3)}
    if not args or args[0] not in counts or not counts[args[0]][0] <= len(args) <= counts[args[0]][1]:
        print(main.__doc__, file=sys.stderr)
        return 2
    spark = session()
    if args[0] == "models":
        df = models.list_models(spark)
    elif args[0] == "inspect":
        df = inspect_images(spark.read.parquet(args[1]))
    elif args[0] == "load":
        df = load_export(spark, args[1]).models()
    else:
        images = from_pixels(spark.read.parquet(args[1]))
        points = spark.read.parquet(args[1]).select("point_index").distinct()
        if args[0] == "quicklook":
            df = quicklook.save(images(points), args[2])
        else:
            names = [n for n in (m.strip() for m in args[2].split(",")) if n]
            if not names:
                raise SpecError("no models")
            kind = labels.export_format(args[4] if len(args) > 4 else "parquet")
            rows = embed(images(points), names)
            if kind == "parquet":
                export.write(rows.withColumn("fingerprint", F.lit("")).withColumn("written_at", F.current_timestamp()), args[3])
                df = load_export(spark, args[3]).models()
            else:
                df = write_files(rows.withColumn("embedding", F.col("embedding").cast("array<float>")), args[3], kind, args[5] if len(args) > 5 else "combined")
    for line in df.toJSON().toLocalIterator():
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
