"""A session with the settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC and ANSI on: bad input raises, as the operators' semantics want.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(app: str = "tidelog", **more: str) -> SparkSession:
    return SparkSession.builder.appName(app).config(map={**SETTINGS, **more}).getOrCreate()
