"""The folder that the driver and all executors share, for tables between steps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where it is set.

    Unset, as in tests, a local master takes a temporary folder; a cluster has none that all can see, an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quillfind-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df by way of a checkpoint in the shared folder: its lineage ends there, and lost executors do not matter."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """df by way of a table in the shared folder, and what deletes it: computed once, and plans over it stay small."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillfind-steps/{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.schema(df.schema).parquet(path), lambda: at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
