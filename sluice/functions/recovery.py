"""Cutting a plan's lineage in the folder that executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df as a table written to the folder that spark.checkpoint.dir names, and read again. Only a session within one process may name none.

    A table rather than a checkpoint: a checkpoint keeps the size that the optimizer estimated for its plan, and in loops the
    estimates of joined checkpoints multiply from round to round until the numbers themselves fill the driver.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^,\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    path = f"{sc.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
