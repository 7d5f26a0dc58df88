"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under spark.checkpoint.dir or, where that is unset (tests), under a local folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("bramble.work.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        root = "file://" + tempfile.mkdtemp(prefix="bramble-", dir="/tmp/checkpoints")
        spark.conf.set("bramble.work.dir", root)
    return f"{root.rstrip('/')}/bramble-{uuid.uuid4().hex[:12]}-{label}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """df written as a table and read back: its lineage ends here, and lost executors cost nothing."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def restage(df: DataFrame, label: str, *old: DataFrame) -> DataFrame:
    """df staged; the staged tables that it was made from are deleted afterwards."""
    new = stage(df, label)
    drop(*old)
    return new
