"""Exports: status, resuming, alignment, and Parquet output with a manifest row per point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status_of(n: Column, failed: Column, partial: Column) -> Column:
    return F.when((failed == 0) & (partial == 0), "ok").when(failed < n, "partial").otherwise("failed")


def rollup(entries: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """``keys, n, n_failed, n_partial, status``: ok if none is failed or partial, failed if all are, else partial."""
    s = F.lower(F.trim(F.col(status)))
    rows = entries.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(s == "failed").alias("n_failed"), F.count_if(s == "partial").alias("n_partial"))
    return rows.withColumn("status", status_of(F.col("n"), F.col("n_failed"), F.col("n_partial")))


def model_rollup(entries: DataFrame, keys: list[str]) -> DataFrame:
    """By rows that loaded: ok without a failure, failed without a success, else partial."""
    ok = F.lower(F.trim("status")) == "ok"
    rows = entries.groupBy(*keys).agg(F.count_if(ok).alias("n_ok"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("n_failed"))
    return rows.withColumn("status", F.when(F.col("n_failed") == 0, "ok").when(F.col("n_ok") == 0, "failed").otherwise("partial"))


def pending(requests: DataFrame, done: DataFrame, by: list[str]) -> DataFrame:
    """Requests without a finished row of the same key and fingerprint."""
    return requests.join(done.select(*by), by, "left_anti")


def kept(requests: DataFrame, done: DataFrame, by: list[str]) -> DataFrame:
    return requests.join(done.filter("status = 'ok'").select(*by), by, "left_semi")


def aligned(points: DataFrame, keys: list[str], index: str = "point_index") -> DataFrame:
    """Every index from 0 to the largest, for each key; a missing point has nulls."""
    span = points.groupBy(*keys).agg(F.max(index).alias("__m"))
    every = span.select(*keys, F.explode(F.sequence(F.lit(0), F.col("__m"))).alias(index))
    return every.join(points, [*keys, index], "left")


def injected(manifest: DataFrame, results: DataFrame, by: list[str]) -> DataFrame:
    """``manifest`` (``by, status, error``) with results joined on: an earlier failure stays."""
    r = results.select(*by, F.col("status").alias("__s"), F.col("error").alias("__e"))
    rows = manifest.join(r, by, "left")
    fail = F.coalesce(F.col("status") == "failed", F.lit(False))
    new = {c: F.when(fail, F.col(c)).otherwise(F.coalesce(n, c)) for c, n in (("status", "__s"), ("error", "__e"))}
    return rows.withColumns(new).drop("__s", "__e")  # both from the old status


def write(results: DataFrame, path: str, mode: str = "append") -> None:
    """Results by model as Parquet; a rerun adds rows, and reading keeps the latest of a key."""
    results.write.mode(mode).partitionBy("model").parquet(path)


def load(spark, path: str) -> DataFrame:
    """The latest row of each model and point of what :func:`write` has stored.

    Which row is latest is found without the vectors; only where a key has several rows are they looked up.
    """
    rows = spark.read.parquet(path)
    key = ["model", "point_index"]
    last = rows.groupBy(*key).agg(F.max(F.struct("written_at", "fingerprint")).alias("at"), F.count("*").alias("n"))
    kept = rows.join(last.filter("n > 1").select(*key, "at"), key, "left")
    return kept.filter(F.col("at").isNull() | (F.col("at") == F.struct("written_at", "fingerprint"))).drop("at")


def stored(path: str) -> bool:
    """Something has been written to ``path``."""
    from rasterloom.sources import storage

    return storage.exists(f"{path}/_SUCCESS")


def resume(requests: DataFrame, path: str, run, spark) -> DataFrame:
    """Run and store what is not stored yet under its fingerprint; then everything that was asked for."""
    by = ["model", "point_index", "fingerprint"]
    left = pending(requests, load(spark, path).filter("status = 'ok'"), by) if stored(path) else requests
    write(run(left).withColumn("written_at", F.current_timestamp()), path)
    return load(spark, path).join(requests.select(*by), by, "left_semi")
