"""Where rounds save what they have, so that a plan doesn't grow with them."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def ensure_folder(spark: SparkSession) -> None:
    """Keep the checkpoint folder that is set. One of this machine is made only where nothing is set and all is one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="quill_ckpt_"))
