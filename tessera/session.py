"""Sessions with the settings that the plans are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tessera", **settings: str) -> SparkSession:
    """A session with UTC, ANSI arithmetic and adaptive execution; settings override."""
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return SparkSession.builder.appName(name).config(map=defaults | settings).getOrCreate()
