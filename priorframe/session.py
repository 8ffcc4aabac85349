"""Sessions with the settings that every plan here assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "priorframe", master: str | None = None, **conf: str) -> SparkSession:
    """UTC wall clocks, adaptive plans; further settings override."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
