"""Files in the storage that all executors share, by path or URI, for formats Spark has no writer for."""

from __future__ import annotations

import json
import uuid

from rasterloom.common import located


def exists(path: str) -> bool:
    from pyarrow import fs as pafs

    fs, at = located(path)
    return fs.get_file_info(at).type != pafs.FileType.NotFound


def is_folder(path: str) -> bool:
    from pyarrow import fs as pafs

    fs, at = located(path)
    return fs.get_file_info(at).type == pafs.FileType.Directory


def names(path: str) -> list[str]:
    """Names of the files in a folder, sorted; none if it is not there."""
    from pyarrow import fs as pafs

    fs, at = located(path)
    return sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if f.type == pafs.FileType.File)


def folders(path: str) -> list[str]:
    """Names of the folders in a folder, sorted."""
    from pyarrow import fs as pafs

    fs, at = located(path)
    return sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if f.type == pafs.FileType.Directory)


def read(path: str) -> bytes:
    fs, at = located(path)
    with fs.open_input_stream(at) as f:
        return f.read()


def write(path: str, data: bytes) -> None:
    """The file appears whole or not at all: it is written under another name and moved."""
    fs, at = located(path)
    folder, _, name = at.rpartition("/")
    fs.create_dir(folder or "/")
    tmp = f"{folder}/_tmp-{uuid.uuid4().hex}-{name}"
    try:
        with fs.open_output_stream(tmp) as f:
            f.write(data)
        fs.move(tmp, at)
    except BaseException:
        if fs.get_file_info(tmp).is_file:
            fs.delete_file(tmp)
        raise


def move(a: str, b: str) -> None:
    fs, at = located(a)
    fs.move(at, located(b)[1])


def remove(path: str) -> None:
    fs, at = located(path)
    if fs.get_file_info(at).is_file:
        fs.delete_file(at)


def write_json(path: str, value) -> None:
    write(path, json.dumps(value, sort_keys=True, default=str).encode())


def read_json_object(path: str) -> dict | None:
    """The object in a file; None if the file is missing, unreadable or holds something else."""
    try:
        value = json.loads(read(path))
    except (OSError, ValueError):
        return None
    return value if isinstance(value, dict) else None


def jsonable(value):
    """``value`` as JSON can say it: arrays by type, shape and extremes, dataclasses and mappings as objects, sequences as
    lists, what is left by its text."""
    import dataclasses
    import datetime

    import numpy as np

    if value is None or isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, float):
        return value if value == value and abs(value) != float("inf") else str(value)
    if isinstance(value, np.ndarray):
        out = {"dtype": str(value.dtype), "shape": list(value.shape)}
        fine = value[np.isfinite(value)] if value.dtype.kind in "fiu" and value.size else value[:0]
        return out | ({"min": float(fine.min()), "max": float(fine.max())} if fine.size else {"min": None, "max": None})
    if isinstance(value, np.generic):
        return jsonable(value.item())
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return {f.name: jsonable(getattr(value, f.name)) for f in dataclasses.fields(value)}
    if isinstance(value, dict):
        return {str(k): jsonable(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [jsonable(v) for v in (sorted(value, key=str) if isinstance(value, (set, frozenset)) else value)]
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return repr(value)
