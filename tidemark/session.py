"""Session with the settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Maps merge with the last value winning; times are UTC; AQE plans joins and skew at run time.
SETTINGS = {
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.cteRecursionLevelLimit": "1000",
}


def build_session(master: str | None = None, name: str = "tidemark", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | extra).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
