"""``spark.read.format("npz")`` and ``df.write.format("npz")``, and the same for ``netcdf``: embeddings in array files with a
JSON sidecar that names their rows. One file per task when writing; one partition per file when reading."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from rasterloom.sources import netcdf, storage

SCHEMA = "model string, point_index bigint, status string, error string, embedding array<float>, meta string"


@dataclass
class Wrote(WriterCommitMessage):
    files: list[tuple[str, str]]


class NpzDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return NpzReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return NpzWriter(self.options["path"], overwrite)


def stacked(rows: list) -> tuple[dict[str, np.ndarray], list[dict]]:
    """Arrays and manifest entries of rows by model: one array of all rows if their vectors are equally long (a row
    without one is NaN), else one array each."""
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r.model, []).append(r)
    arrays, listed = {}, []
    for model, mine in sorted(by.items()):
        key = f"embeddings__{model}"
        sizes = {len(r.embedding) for r in mine if r.embedding is not None}
        if len(sizes) == 1:
            gap = np.full(sizes.pop(), np.nan, np.float32)
            arrays[key] = np.stack([gap if r.embedding is None else np.asarray(r.embedding, np.float32) for r in mine])
        else:
            arrays |= {f"{key}__{r.point_index:05d}": np.asarray(r.embedding, np.float32) for r in mine if r.embedding is not None}
        listed.append({"model": model, "key": key, "points": [{"point_index": r.point_index, "status": r.status, "error": r.error, "meta": r.meta} for r in mine]})
    return arrays, listed


def rows_of(arrays: dict[str, np.ndarray], manifest: dict) -> Iterator[tuple]:
    for m in manifest["models"]:
        whole = arrays[m["key"]] if m["key"] in arrays else None
        for i, entry in enumerate(m["points"]):
            one = f"{m['key']}__{entry['point_index']:05d}"
            v = whole[i] if whole is not None else arrays[one] if one in arrays else None
            v = None if v is None or entry["status"] == "failed" or np.isnan(v).all() else [float(x) for x in np.ravel(v)]
            yield m["model"], entry["point_index"], entry["status"], entry.get("error"), v, entry.get("meta")


def as_npz(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def arrays_of(path: str) -> dict[str, np.ndarray]:
    """The arrays stored in an ``.npz`` or netCDF file, for resuming; none if there is no such file."""
    if not storage.exists(path):
        return {}
    data = storage.read(path)
    if path.endswith(".npz"):
        with np.load(io.BytesIO(data)) as arrays:
            return dict(arrays)
    return netcdf.decode(data)[0]


class NpzReader(DataSourceReader):
    """A model's rows are one stacked array ``embeddings__MODEL``, or one array each, ``embedding__MODEL__00007``."""

    kind = ".npz"

    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        if storage.is_folder(self.path):
            mine = [n for n in storage.names(self.path) if n.endswith(self.kind) and not n.startswith("_")]
            found = [f"{self.path}/{n}" for n in mine]
        else:
            found = [self.path]
        bare = [f for f in found if not storage.exists(f.removesuffix(self.kind) + ".json")]
        if bare:
            raise FileNotFoundError(f"no manifest beside {bare[0]}")
        return [InputPartition(f) for f in found]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        manifest = json.loads(storage.read(partition.value.removesuffix(self.kind) + ".json"))
        yield from rows_of(self.arrays(storage.read(partition.value)), manifest)

    def arrays(self, data: bytes) -> dict[str, np.ndarray]:
        with np.load(io.BytesIO(data)) as arrays:
            return dict(arrays)


class NpzWriter(DataSourceWriter):
    """A task's rows are one file of arrays and its manifest, in the storage that all executors share."""

    kind = ".npz"

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def encoded(self, arrays: dict[str, np.ndarray]) -> bytes:
        return as_npz(arrays)

    def write(self, rows: Iterator) -> Wrote:
        arrays, listed = stacked(list(rows))
        if not listed:
            return Wrote([])
        tag = uuid.uuid4().hex
        tmp, end = f"{self.path}/_tmp-{tag}", f"{self.path}/part-{tag}"
        storage.write(f"{tmp}{self.kind}", self.encoded(arrays))
        storage.write_json(f"{tmp}.json", {"models": listed, "keys": sorted(arrays)})
        return Wrote([(f"{tmp}{x}", f"{end}{x}") for x in (".json", self.kind)])

    def commit(self, messages: list) -> None:
        """Files appear when the whole job is done, manifest before arrays."""
        old = [n for n in storage.names(self.path) if n.startswith("part-") and n.endswith((self.kind, ".json"))] if self.overwrite else []
        for m in messages:
            for a, b in m.files if m else ():
                storage.move(a, b)
        for n in old:
            storage.remove(f"{self.path}/{n}")

    def abort(self, messages: list) -> None:
        for m in messages:
            for a, _ in m.files if m else ():
                storage.remove(a)


class NetcdfReader(NpzReader):
    kind = ".nc"

    def arrays(self, data: bytes) -> dict[str, np.ndarray]:
        return netcdf.decode(data)[0]


class NetcdfWriter(NpzWriter):
    kind = ".nc"

    def encoded(self, arrays: dict[str, np.ndarray]) -> bytes:
        return netcdf.encode(arrays)


class NetcdfDataSource(NpzDataSource):
    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def reader(self, schema: StructType) -> DataSourceReader:
        return NetcdfReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return NetcdfWriter(self.options["path"], overwrite)


def register(spark) -> None:
    for source in (NpzDataSource, NetcdfDataSource):
        spark.dataSource.register(source)
