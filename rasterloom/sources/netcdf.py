"""Arrays in netCDF files of the classic format with 64-bit offsets, written and read without a library.

A file is a header (dimensions, attributes, variables with their places) and the variables' values, big-endian.
"""

from __future__ import annotations

import re
import struct

import numpy as np

MAGIC = b"CDF\x02"
# Fixed values of the format: tags of the header's lists, and types by number.
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}


def dims_of(key: str, ndim: int) -> tuple[str, ...]:
    """Names of an array's axes by its key: images ``chw`` and ``bchw``, one embedding, embeddings of many points."""
    image = ("band", "y", "x")
    known = (("bchw", {4: ("point", *image)}), ("chw", {3: image}), ("embeddings", {2: ("point", "dim"), 4: ("point", *image)}), ("embedding", {1: ("dim",), 3: image}))
    for word, by_axes in known:
        if word in key and ndim in by_axes:
            return by_axes[ndim]
    return tuple(f"d{i}" for i in range(ndim))


def suffix(key: str) -> str:
    return re.sub("[^0-9a-zA-Z]", "_", key).strip("_") or "var"


def named(arrays: dict[str, np.ndarray]) -> tuple[dict[str, tuple[str, ...]], dict[str, int]]:
    """Axes of each array and sizes of all: an axis whose name is taken by another size is named after its key, too."""
    sizes: dict[str, int] = {}
    out = {}
    for key, a in arrays.items():
        mine = []
        for name, n in zip(dims_of(key, a.ndim), a.shape):
            if sizes.get(name, n) != n:
                name = f"{name}__{suffix(key)}"
                tries = 2
                stem = name
                while sizes.get(name, n) != n:
                    name, tries = f"{stem}_{tries}", tries + 1
            sizes[name] = n
            mine.append(name)
        out[key] = tuple(mine)
    return out, sizes


def _padded(b: bytes) -> bytes:
    return b + b"\0" * (-len(b) % 4)


def _text(s: str) -> bytes:
    b = s.encode()
    return struct.pack(">i", len(b)) + _padded(b)


def _attributes(attrs: dict[str, str]) -> bytes:
    if not attrs:
        return struct.pack(">ii", 0, 0)
    out = struct.pack(">ii", ATTRIBUTE, len(attrs))
    for k, v in attrs.items():
        out += _text(k) + struct.pack(">i", 2) + _text(str(v))
    return out


def encode(arrays: dict[str, np.ndarray], attrs: dict[str, str] | None = None) -> bytes:
    """Floats as float32 (float64 stays), whole numbers as int32; ValueError for those that don't fit and other types."""
    arrays = {k: np.asarray(v) for k, v in arrays.items()}
    axes, sizes = named(arrays)
    numbers = {n: i for i, n in enumerate(sizes)}
    data = {}
    for k, a in arrays.items():
        if a.dtype.kind in "iub":
            if a.size and (a.min() < -(2**31) or a.max() >= 2**31):
                raise ValueError(f"{k}: whole numbers of more than 32 bits")
            data[k] = 4, a.astype(">i4")
        elif a.dtype.kind == "f":
            data[k] = (6, a.astype(">f8")) if a.dtype.itemsize == 8 else (5, a.astype(">f4"))
        else:
            raise ValueError(f"{k}: no netCDF type for {a.dtype}")
    head = MAGIC + struct.pack(">i", 0)
    head += struct.pack(">ii", DIMENSION, len(sizes)) if sizes else struct.pack(">ii", 0, 0)
    for n, size in sizes.items():
        head += _text(n) + struct.pack(">i", size)
    head += _attributes({"Conventions": "CF-1.8"} | (attrs or {}))
    head += struct.pack(">ii", VARIABLE, len(data)) if data else struct.pack(">ii", 0, 0)
    fixed = {k: _text(k) + struct.pack(">i", a.ndim) + b"".join(struct.pack(">i", numbers[n]) for n in axes[k]) + _attributes({"long_name": k}) for k, (_, a) in data.items()}
    at = len(head) + sum(len(f) + 16 for f in fixed.values())
    body = b""
    for k, (kind, a) in data.items():
        raw = _padded(a.tobytes())
        head += fixed[k] + struct.pack(">iiq", kind, len(raw) if len(raw) < 2**31 else -1, at)
        at += len(raw)
        body += raw
    return head + body


def decode(data: bytes) -> tuple[dict[str, np.ndarray], dict[str, tuple[str, ...]], dict[str, str]]:
    """Arrays, their axes and the file's attributes; ValueError for another format."""
    if data[:3] != b"CDF" or data[3] not in (1, 2):
        raise ValueError("no netCDF file of the classic format")
    at = 8

    def number() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(">i", data, at - 4)[0]

    def text() -> str:
        nonlocal at
        n = number()
        at += n + -n % 4
        return data[at - n - -n % 4 :][:n].decode()

    def attributes() -> dict[str, str]:
        nonlocal at
        number()
        out = {}
        for _ in range(number()):
            name, kind, n = text(), number(), number()
            size = n * np.dtype(TYPES[kind]).itemsize
            raw, at = data[at : at + size], at + size + -size % 4
            out[name] = raw.decode() if kind == 2 else str(np.frombuffer(raw, TYPES[kind]).tolist())
        return out

    number()
    dims = [(text(), number()) for _ in range(number())]
    attrs = attributes()
    number()
    arrays, axes = {}, {}
    for _ in range(number()):
        name = text()
        ids = [number() for _ in range(number())]
        attributes()
        kind, _ = number(), number()
        begin = struct.unpack_from(">q" if data[3] == 2 else ">i", data, at)[0]
        at += 8 if data[3] == 2 else 4
        shape = tuple(dims[i][1] for i in ids)
        a = np.frombuffer(data, TYPES[kind], int(np.prod(shape, dtype=np.int64)), begin).reshape(shape)
        arrays[name], axes[name] = a.astype(a.dtype.newbyteorder("=")), tuple(dims[i][0] for i in ids)
    return arrays, axes, attrs
