"""Reliable cuts of lineage for iterative operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share; set from spark.checkpoint.dir, on one machine a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if sc.master != "local" and not (sc.master or "").startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="quillstone-checkpoint-")  # one machine only: tests
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder, so that a lost executor costs no earlier round."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
