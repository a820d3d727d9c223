"""Session helpers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def reachable(spark: SparkSession) -> SparkSession:
    """Lets the session's Python workers import this package from where the driver has it.

    On a cluster the package is installed on the executors, or given by ``--py-files``; then this
    changes nothing.
    """
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths and ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark
