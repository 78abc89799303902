"""Session construction with the settings the engine is tested under."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int = 8, app: str = "auditlake", **extra: str) -> SparkSession:
    """A local session; on a cluster the caller brings its own."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | extra
    return SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=conf).getOrCreate()
