"""A session with the settings that plans count on; an active one is taken as it is."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cores: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    active = SparkSession.getActiveSession()
    if active:
        return active
    n = cores or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{n}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or n))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
