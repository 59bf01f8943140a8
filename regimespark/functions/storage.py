"""Cutting lineage so that jobs survive lost executors."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """df checkpointed in the folder of spark.checkpoint.dir; where that is unset, a local master takes a new folder and a cluster raises an error."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not re.match(r"local(\[.*\])?$", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(path)
    return df.checkpoint()
