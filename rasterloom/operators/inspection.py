"""Quality of input pixels: statistics, quantiles, histograms and flags per image and band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Images of more values are looked at every so many rows and columns.
FULL_STATS_VALUES = 1_500_000
BINS = 32


def sampled(pixels: DataFrame, keys: list[str], most: int = FULL_STATS_VALUES) -> DataFrame:
    """``pixels`` (``keys, y, x, value`` and more) without the rows and columns that images of more than ``most`` values
    leave out: every ``ceil(sqrt(values / most))``-th of each counts. Smaller images stay whole."""
    n = pixels.groupBy(*keys).agg(F.greatest(F.ceil(F.sqrt(F.count("*") / most)), F.lit(1)).alias("__step"))
    rows = pixels.join(n, keys)
    return rows.filter((F.col("y") % F.col("__step") == 0) & (F.col("x") % F.col("__step") == 0)).drop("__step")


def histogram_range(pixels: DataFrame, clip: tuple[float, float] | None = None, value_range: tuple[float, float] | None = None, at: tuple[float, float] | None = None, value: str = "value") -> tuple[float, float]:
    """The range of a histogram: the one to clip to, else the values' own, else that of the bands' quantiles ``at``, else
    from the least to the greatest value. Two numbers come to the driver."""
    if clip or value_range:
        return clip or value_range
    v = F.when(finite(F.col(value)), F.col(value))
    if at:
        by = pixels.groupBy("band").agg(F.percentile(v, at[0]).alias("lo"), F.percentile(v, at[1]).alias("hi"))
        lo, hi = by.agg(F.min("lo"), F.max("hi")).first()
    else:
        lo, hi = pixels.agg(F.min(v), F.max(v)).first()
    return (0.0, 1.0) if lo is None else (lo, hi if hi > lo else lo + 1.0)


def gated(report: DataFrame, enabled: bool, raises: bool) -> DataFrame:
    """A report of flags as checks are set: no rows if they are off; with ``raises`` the query stops at an image that
    fails."""
    if not enabled:
        return report.limit(0)
    if not raises:
        return report
    text = F.concat(F.lit("input of point "), F.col("point_index"), F.lit(", band "), F.col("band"), F.lit(": "), F.col("issues"))
    return report.withColumn("ok", F.when(F.col("ok"), True).otherwise(F.raise_error(text).cast("boolean")))


def checks(sensor=None) -> tuple[bool, bool]:
    """Whether inputs are checked and whether a failed check stops the query: by the environment, else by the sensor."""
    import os

    def flag(name: str, default: bool) -> bool:
        text = os.environ.get(name, "").strip().lower()
        return default if not text else text in ("1", "true", "yes", "y", "on")

    enabled = flag("RASTERLOOM_CHECK_INPUT", getattr(sensor, "check_input", False))
    return enabled, flag("RASTERLOOM_CHECK_RAISE", getattr(sensor, "check_raise", True))


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def statistics(pixels: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Minimum, maximum, mean and population deviation of the finite values, and their share."""
    v = F.when(finite(F.col(value)), F.col(value))
    return pixels.groupBy(*keys).agg(
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        F.avg(finite(F.col(value)).cast("int")).alias("finite_share"), F.count("*").alias("n"),
    )


def quantiles(pixels: DataFrame, keys: list[str], at: tuple[float, ...] = (0.01, 0.5, 0.99), value: str = "value") -> DataFrame:
    """Exact, interpolated: ``p01, p50, p99`` for the defaults."""
    v = F.when(finite(F.col(value)), F.col(value))
    return pixels.groupBy(*keys).agg(*[F.percentile(v, p).alias(f"p{round(p * 100):02d}") for p in at])


def histogram(pixels: DataFrame, keys: list[str], lo: float, hi: float, value: str = "value", bins: int = BINS) -> DataFrame:
    """``keys, bin, n``: equal bins, the last closed; values outside are dropped, empty bins are there with 0."""
    v = F.col(value)
    inside = finite(v) & (v >= lo) & (v <= hi)
    at = F.when(inside, F.least(F.floor((v - lo) / F.lit((hi - lo) / bins)), F.lit(bins - 1)).cast("int"))
    found = pixels.groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))
    every = pixels.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(found, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def shares(pixels: DataFrame, keys: list[str], lo: float, hi: float, fill: float, value: str = "value") -> DataFrame:
    """Shares of all sampled pixels: outside the range, and equal to the fill value. Values that are no number are
    neither."""
    v = F.col(value)
    share = lambda c: F.avg(F.coalesce(finite(v) & c, F.lit(False)).cast("int"))
    return pixels.groupBy(*keys).agg(share((v < lo) | (v > hi)).alias("outside_share"), share(v == fill).alias("fill_share"))


def flags(pixels: DataFrame, keys: list[str], lo: float, hi: float, fill: float, value: str = "value") -> DataFrame:
    """``keys, issues, ok``: what is wrong with a band, in a fixed order."""
    s = statistics(pixels, keys, value).join(shares(pixels, keys, lo, hi, fill, value), keys)
    found = F.array(
        F.when(F.col("finite_share") < 0.999, "not_finite"),
        F.when(F.coalesce(F.col("std"), F.lit(0.0)) < 1e-6, "constant"),
        F.when(F.col("outside_share") > 0.001, "out_of_range"),
        F.when(F.col("fill_share") > 0.98, "fill"),
    )
    return s.select(*keys, F.array_join(F.array_compact(found), ",").alias("issues")).withColumn("ok", F.col("issues") == "")


def frames_ok(frames: DataFrame, key: str) -> DataFrame:
    """``key, ok``: some frame is not empty, and every frame that isn't is ok."""
    full = ~F.col("empty")
    return frames.groupBy(key).agg((F.coalesce(F.max(full.cast("int")), F.lit(0)) == 1).alias("__a"), (F.coalesce(F.min(F.when(full, F.col("ok").cast("int"))), F.lit(0)) == 1).alias("__b")).select(key, (F.col("__a") & F.col("__b")).alias("ok"))
