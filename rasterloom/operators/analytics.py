"""Analyses over embeddings and labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _in_blocks(spark, rows: DataFrame, key: str, block_rows: int, work, schema: str) -> DataFrame:
    """``work(block)``, a DataFrame, for each block of at most about ``block_rows`` rows of ``rows``, stored one after
    another: the driver holds one block, and no plan grows with their number."""
    from rasterloom.common import scratch

    n, path = rows.count(), scratch(spark, "blocks")
    parts = max(1, -(-n // block_rows))
    for p in range(parts):
        block = rows.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == p).collect()
        if block or p == 0:
            work(block).write.parquet(f"{path}/part={p}")
    return spark.read.schema(schema).parquet(path).select(*[c.split()[0] for c in schema.split(", ")])


def cosine_nearest(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", vec: str = "embedding", block_rows: int = 20_000) -> DataFrame:
    """``query, other, sim, rank``: the ``k`` most similar vectors of each query but itself, ties to the smaller key.

    The stated queries go to the tasks in blocks; a task keeps the best of its own rows, so what is shuffled is k rows
    per query and task, not the pairs.
    """
    spark, schema = vectors.sparkSession, "query bigint, other bigint, sim double"

    def work(block: list) -> DataFrame:
        if not block:
            return spark.createDataFrame([], schema)
        ship = spark.sparkContext.broadcast((np.array([r[0] for r in block]), np.array([r[1] for r in block], np.float64)))

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = ship.value
            q = q / (np.linalg.norm(q, axis=1, keepdims=True) + 1e-9)
            for b in batches:
                b = b[b[vec].notna()]
                if not len(b):
                    continue
                x = np.stack(b[vec].to_numpy()).astype(np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
                other = b[key].to_numpy()
                for s in range(0, len(ids), 512):
                    sim = q[s : s + 512] @ x.T
                    sim[ids[s : s + 512, None] == other[None]] = -np.inf
                    keep = min(k + 1, sim.shape[1])
                    at = np.argpartition(-sim, keep - 1, axis=1)[:, :keep]
                    v = np.take_along_axis(sim, at, 1)
                    row, col = np.nonzero(v > -np.inf)
                    yield pd.DataFrame({"query": ids[s + row], "other": other[at[row, col]], "sim": v[row, col]})

        w = Window.partitionBy("query").orderBy(F.desc("sim"), "other")
        found = vectors.select(key, vec).mapInPandas(best, schema)
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    asked = queries.filter(F.col(vec).isNotNull()).select(key, vec)
    return _in_blocks(spark, asked, key, block_rows, work, schema + ", rank int")


def nearest_label(points: DataFrame, labels: DataFrame, block_rows: int = 20_000) -> DataFrame:
    """``points`` (``id, lon, lat``) with the ``label`` of the nearest labelled point (``label_id, lon, lat, label``)
    by squared degrees, the smaller label_id of two as near. Labels without a value are left out."""
    spark, schema = points.sparkSession, "id bigint, d2 double, label_id bigint, label double"

    def work(block: list) -> DataFrame:
        if not block:
            return spark.createDataFrame([], schema)
        ship = spark.sparkContext.broadcast(np.array(sorted(tuple(map(float, r)) for r in block)))

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            t = ship.value
            for b in batches:
                at, d = np.zeros(len(b), np.int64), np.zeros(len(b))
                for s in range(0, len(b), 1024):
                    p = b[["lon", "lat"]].to_numpy()[s : s + 1024]
                    d2 = (p[:, :1] - t[None, :, 1]) ** 2 + (p[:, 1:] - t[None, :, 2]) ** 2
                    at[s : s + 1024] = d2.argmin(1)
                    d[s : s + 1024] = d2.min(1)
                yield pd.DataFrame({"id": b["id"], "d2": d, "label_id": t[at, 0].astype(np.int64), "label": t[at, 3]})

        return points.dropna().select("id", "lon", "lat").mapInPandas(near, schema)

    out = _in_blocks(spark, labels.dropna().select("label_id", "lon", "lat", "label"), "label_id", block_rows, work, schema)
    return out.groupBy("id").agg(F.min(F.struct("d2", "label_id", "label")).alias("b")).select("id", "b.d2", "b.label_id", "b.label")


def deduplicated_merge(a: DataFrame, b: DataFrame, key: str, order: str) -> DataFrame:
    """Inner join on ``key`` after keeping, on each side, its first row by ``order``."""

    def first(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c != key]
        return df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, *[f"r.{c}" for c in rest])

    return first(a).join(first(b).drop(order), key)


def coverage(vectors: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """``keys, dim, valid, total, coverage``: vectors that are there, finite, and as long as the longest."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    dim = vectors.groupBy(*keys).agg(F.max(F.size(vec)).alias("dim"))
    rows = vectors.join(dim, keys)
    fine = F.col(vec).isNotNull() & (F.size(vec) == F.col("dim")) & ~F.exists(vec, bad)
    return rows.groupBy(*keys).agg(F.max("dim").alias("dim"), F.count_if(fine).alias("valid"), F.count("*").alias("total")).withColumn("coverage", F.round(F.col("valid") / F.col("total"), 6))


def regression_metrics(rows: DataFrame, keys: list[str], truth: str, guess: str) -> DataFrame:
    """``r2, rmse, mae`` in one pass; rows without either are left out, r2 is null where the truth is constant."""
    y, p = F.col(truth), F.col(guess)
    ok = rows.filter(y.isNotNull() & p.isNotNull())
    sse, sst = F.sum((y - p) * (y - p)), F.var_pop(y) * F.count("*")
    return ok.groupBy(*keys).agg(F.when(sst > 0, 1 - sse / sst).alias("r2"), F.sqrt(sse / F.count("*")).alias("rmse"), F.avg(F.abs(y - p)).alias("mae"), F.count("*").alias("n"))


def moments(vectors: DataFrame, vec: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance (population) of all finite vectors of one length.

    A task gives one row per dimension (its sum and its products with the others); they are added up by dimension, so
    the driver gets d rows of d numbers, however many tasks there are.
    """

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_numpy()).astype(np.float64)
                part = np.concatenate([np.full((x.shape[1], 1), float(len(x))), x.sum(0)[:, None], x.T @ x], 1)
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total), dtype=np.int32), "part": [r.tobytes() for r in total]})

    def add(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": b["i"].iloc[:1], "part": [np.sum([np.frombuffer(p) for p in b["part"]], axis=0).tobytes()]})

    ok = vectors.filter(F.col(vec).isNotNull() & ~F.exists(vec, lambda v: v.isNull() | F.isnan(v))).select(F.col(vec).alias("v"))
    rows = ok.mapInPandas(sums, "i int, part binary").groupBy("i").applyInPandas(add, "i int, part binary").collect()
    if not rows:
        return 0, np.zeros(0), np.zeros((0, 0))
    t = np.stack([np.frombuffer(p) for _, p in sorted((r["i"], r["part"]) for r in rows)])
    n, mean = t[0, 0], t[:, 1] / t[0, 0]
    return int(n), mean, t[:, 2:] / n - np.outer(mean, mean)


def covariance(vectors: DataFrame, vec: str) -> DataFrame:
    """``i, j, cov`` for i <= j."""
    _, _, c = moments(vectors, vec)
    rows = [(i, j, float(c[i, j])) for i in range(len(c)) for j in range(i, len(c))]
    return vectors.sparkSession.createDataFrame(rows, "i int, j int, cov double")


def pca(vectors: DataFrame, key: str, vec: str, k: int = 3) -> DataFrame:
    """``key, pc array<double>``: the first ``k`` principal components; of each axis the largest part is positive."""
    _, mean, c = moments(vectors, vec)
    values, axes = np.linalg.eigh(c)
    axes = axes[:, np.argsort(-values)[:k]]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    ship = vectors.sparkSession.sparkContext.broadcast((mean, axes))

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mean, axes = ship.value
        for b in batches:
            x = np.stack(b[vec].to_numpy()).astype(np.float64)
            yield pd.DataFrame({key: b[key], "pc": list((x - mean) @ axes)})

    ok = vectors.filter(F.col(vec).isNotNull() & ~F.exists(vec, lambda v: v.isNull() | F.isnan(v)))
    return ok.select(key, vec).mapInPandas(project, f"{key} bigint, pc array<double>")


def feature_vector(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over space by dimension, 0 where there is none: ``keys, features``."""
    v = grid.groupBy(*keys, "d").agg(F.coalesce(F.avg(F.when(~F.isnan("value"), F.col("value"))), F.lit(0.0)).alias("v"))
    return v.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda x: x["v"]).alias("features"))
