"""Session settings shared by the entry point, the benchmark and the tests."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", partitions: int = 8, memory: str = "8g", app: str = "ringdata") -> SparkSession:
    """A local session: UTC, AQE and few shuffle partitions. A cluster brings its own settings."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def find_package(spark: SparkSession) -> None:
    """Put the folder that holds this package on the Python path of functions shipped from now on (a cluster installs the package there)."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])
