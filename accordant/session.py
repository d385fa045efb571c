"""The session that the engine expects: UTC, ANSI, adaptive execution."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app_name: str = "accordant", **conf: str) -> SparkSession:
    """A session; ``master`` only where none runs yet. Further settings override the defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": os.environ.get("ACCORDANT_SHUFFLE_PARTITIONS", "200"),
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
