"""Build a session with the settings the operators are planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

from corvane.plans.ship import ship


def session(name: str = "corvane", *, cores: int | str = "*", shuffle_partitions: int | None = None, memory: str = "4g") -> SparkSession:
    """A local session. On a cluster use the one that exists; nothing here is required."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(name).config("spark.driver.memory", memory).config("spark.ui.enabled", "false")
    b = b.config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    return s
