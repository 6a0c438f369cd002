"""Session settings that operators need."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def ensure_checkpoints(spark: SparkSession) -> None:
    """The shared folder that the cluster names in spark.checkpoint.dir. On a single machine, as in tests, one of our own where none is set."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "codelake-checkpoints"))
