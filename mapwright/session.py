"""Session construction and table access shared by queries, bench and tests."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", memory: str = "6g", app: str = "mapwright") -> SparkSession:
    """A local session with the settings that the engine expects of a cluster."""
    n = os.cpu_count() or 8 if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder, opened by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
