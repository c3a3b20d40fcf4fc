"""One place that builds a session for tests, the bench and ad-hoc use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(cpus: int = 8, shuffle_partitions: int | None = None, app: str = "attesta") -> SparkSession:
    """A local session. On a cluster use the session that the platform hands out: nothing in the library needs this one."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
