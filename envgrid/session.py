"""Session settings shared by the bench and the tests."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "envgrid", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A UTC session with AQE on. On a cluster leave master and partitions unset so the submit settings hold."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()
