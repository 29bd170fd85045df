"""A session with the settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "spanloom", **conf: str) -> SparkSession:
    """UTC, ANSI arithmetic and adaptive execution; everything else is the cluster's."""
    builder = SparkSession.builder.appName(app)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
