"""Spark session with the settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "ragspark", **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; everything else is the cluster's choice."""
    builder = SparkSession.builder.appName(app)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in (fixed | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
