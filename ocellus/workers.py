"""Makes this package importable in Python workers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def importable(spark: SparkSession) -> SparkSession:
    """Adds the folder of this package to the workers' module path.

    It helps where the driver runs from a checkout; on a cluster whose nodes
    lack that folder, install the package or ship it with ``--py-files``.
    """
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in known:
        env["PYTHONPATH"] = ":".join([*known, ROOT])
    return spark
