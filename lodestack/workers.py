"""Lets Python workers import this package from where the driver has it."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def reach(spark: SparkSession) -> SparkSession:
    """Adds the package's folder to the module path of workers that start from here on.

    It serves checkouts that all machines see at one path; elsewhere give the package to
    Spark with --py-files or install it.
    """
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])
    return spark
