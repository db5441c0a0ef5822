"""The local Spark session of tests and bench."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: str = "8", **config: str) -> SparkSession:
    cores = cpus if cpus.isdigit() else str(os.cpu_count())
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("shopfloor")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for name, value in config.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
