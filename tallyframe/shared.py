"""The folder that the driver and all executors share."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  Where none is set, a temporary folder serves a local session; on a cluster
    each machine would write to its own, so that is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyframe-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def local_folder(spark: SparkSession) -> str | None:
    """The same folder for programs that open files by themselves, or None if it isn't among them."""
    path = re.sub("^file:(//)?(?=/)", "", shared_folder(spark))
    return path if path.startswith("/") and os.path.isdir(path) else None


class fixed:
    """A plan evaluated once: what is counted, shown and done is the same, whatever happens to the
    files meanwhile.  It is written out, so that losing an executor doesn't evaluate it anew."""

    def __init__(self, plan: DataFrame) -> None:
        self.plan = plan

    def __enter__(self) -> DataFrame:
        spark = self.plan.sparkSession
        folder = shared_folder(spark)
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(folder)
        return self.plan.checkpoint()

    def __exit__(self, *_: object) -> None:
        return None
