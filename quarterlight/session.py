"""Session helper for applications and tests; queries take any session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "quarterlight", master: str | None = None, **options: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``options`` override."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in (base | options).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
