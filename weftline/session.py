"""SparkSession factory with the settings that the engine's plans expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "weftline", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution on, Arrow for Python stages. Settings given in ``conf`` win."""
    builder = SparkSession.builder.appName(app)
    if master or not os.environ.get("SPARK_REMOTE"):
        builder = builder.master(master or os.environ.get("SPARK_MASTER", "local[*]"))
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    return builder.config(map=base | conf).getOrCreate()
