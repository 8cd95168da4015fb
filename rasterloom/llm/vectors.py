"""The usable vectors of model results, and identical ones as one."""

from __future__ import annotations

import ctypes
import glob
import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(results: DataFrame, catalog: DataFrame) -> DataFrame:
    """``result_id, model, h1, h2, embedding`` of the rows whose vector is not null, as long as the model's ``dim``,
    finite and not all zero. ``(h1, h2)`` is a 128-bit hash of the vector.

    Re-delivered rows are still there; rows without result_id or of a model not in the catalog are left out.
    """
    dims = catalog.filter("model is not null and dim is not null").groupBy("model").agg(F.max("dim").alias("dim"))
    rows = results.filter("result_id is not null and embedding is not null").select("result_id", "model", F.col("embedding").cast("array<float>").alias("embedding"))
    inf = float("inf")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(inf))
    ok = (F.size("embedding") == F.col("dim")) & ~F.exists("embedding", bad) & F.exists("embedding", lambda v: v != 0)
    rows = rows.join(dims, "model").filter(ok)
    return rows.select("result_id", "model", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"), "embedding")


def collapse(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``reps(model, rep, vec)`` with one row per distinct vector of a model, ``rep`` being its smallest result, and
    ``members(result_id, model, rep)`` with each result once.

    Both are aggregates: of a vector that a third of all rows repeat, each task passes on one row.
    """
    key = ["model", "h1", "h2"]
    reps = rows.groupBy(*key).agg(F.min("result_id").alias("rep"), F.first("embedding").alias("vec"))
    ids = rows.groupBy("result_id").agg(F.min(F.struct(*key)).alias("k")).select("result_id", "k.*")
    return reps, ids


_single = False


def one_thread() -> None:
    """Products of matrices on one thread in this worker: the tasks fill the cores, more threads would only wait."""
    global _single
    if _single:
        return
    _single = True
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), os.pardir, "numpy.libs", "*openblas*")):
        lib = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float32, copy=False)


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, computed in double precision."""
    x = x.astype(np.float64)
    return (x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]).astype(np.float32)
