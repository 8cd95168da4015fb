"""Quick-look pictures: three bands stretched and stored as PNG, one file per image."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.sources import storage


def png(rgb: np.ndarray) -> bytes:
    """``(h, w, 3)`` of bytes."""
    h, w = rgb.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(rgb, np.uint8).reshape(h, w * 3)], 1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def stretched(x: np.ndarray, pmin: float = 2, pmax: float = 98, vmin: float | None = None, vmax: float | None = None) -> np.ndarray:
    """``(3, h, w)`` as ``(h, w, 3)`` bytes, each band between two percentiles or all between two values."""
    out = np.zeros((*x.shape[1:], 3), np.uint8)
    for i, band in enumerate(x):
        fine = band[np.isfinite(band)]
        lo = vmin if vmin is not None else float(np.percentile(fine, pmin)) if fine.size else 0.0
        hi = vmax if vmax is not None else float(np.percentile(fine, pmax)) if fine.size else 1.0
        out[..., i] = np.clip((np.nan_to_num(band, nan=lo) - lo) / max(hi - lo, 1e-8), 0, 1) * 255
    return out


def save(images: DataFrame, folder: str, bands: tuple[int, int, int] = (0, 1, 2), **stretch) -> DataFrame:
    """``point_index, path, error``: a picture per image (``point_index, c, h, w, pixels``), written by the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                if r.pixels is None or max(bands) >= r.c or len(r.pixels) != r.c * r.h * r.w:
                    out.append((r.point_index, None, "no image with these bands"))
                    continue
                x = np.asarray(r.pixels, np.float32).reshape(int(r.c), int(r.h), int(r.w))[list(bands)]
                path = f"{folder}/p{int(r.point_index):05d}.png"
                storage.write(path, png(stretched(x, **stretch)))
                out.append((r.point_index, path, None))
            yield pd.DataFrame(out, columns=["point_index", "path", "error"])

    rows = images.select("point_index", *[F.col(c).cast("int").alias(c) for c in ("c", "h", "w")], "pixels")
    return rows.mapInPandas(run, "point_index bigint, path string, error string")
