"""A session with the settings this engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "rasterloom", **conf: str) -> SparkSession:
    """Adaptive plans, UTC, Arrow exchange; ``conf`` overrides (dots as ``__``)."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()
