"""Session construction shared by the bench, the tests and small scripts."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "skeinflow", cores: int | str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A local session; on a cluster the submitter's own settings are used instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SKEINFLOW_DRIVER_MEMORY", driver_memory))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
