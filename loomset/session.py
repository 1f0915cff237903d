"""A session with the settings the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "loomset", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution, UTC and no default broadcast surprises; ``conf`` keys use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
