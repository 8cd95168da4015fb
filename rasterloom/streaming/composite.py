"""Composites over unbounded scenes: event-time bins with a watermark, and exports per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_scenes(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(scenes: DataFrame, keys: list[str], width: str = "7 days", late: str = "2 days", start: str = "0 seconds", ts: str = "ts", value: str = "value") -> DataFrame:
    """Mean, extremes and count of each key's scenes by tumbling bin; a bin is final once the watermark has passed."""
    rows = scenes.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    w = F.window(ts, width, width, start)
    return rows.groupBy(w.alias("w"), *keys).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "mean", "min", "max", "n")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Work off what is there, store it as Parquet, and stop; a later call goes on from the checkpoint."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def export_stream(requests: DataFrame, run, path: str, checkpoint: str) -> None:
    """``run`` on each micro-batch, its rows added below ``path`` under the batch's number: a batch that is tried again
    replaces its own rows."""

    def batch(df: DataFrame, number: int) -> None:
        run(df).write.mode("overwrite").parquet(f"{path}/batch={number}")

    requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
