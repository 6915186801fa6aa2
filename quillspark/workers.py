"""Lets Python workers on the driver's machine import this package from where it lies."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def make_importable(spark: SparkSession) -> None:
    """Adds the package's folder to the workers' PYTHONPATH; harmless where it is installed."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
