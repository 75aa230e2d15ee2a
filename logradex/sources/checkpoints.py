"""Where checkpoints go."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def ensure(spark: SparkSession) -> str:
    """The session's checkpoint folder: that of ``spark.checkpoint.dir``, or on one machine a folder of its own.

    On a cluster each executor would write to its own disk, so there the setting is required.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
        known = sc._jsc.sc().getCheckpointDir()
    return known.get()
