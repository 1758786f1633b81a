"""Cutting lineage on storage that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once, written below ``spark.checkpoint.dir`` and read from there on: it survives the loss of any executor.

    Only a local master may name no folder (one of this machine is made);
    elsewhere that is an error.
    """
    _folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as files below ``spark.checkpoint.dir`` and read from there: for loops.

    A checkpoint keeps the estimated size of its plan, and a join's estimate is
    the product of its sides': over some twenty joins in a loop this number
    gets millions of digits and planning never ends.  Files have a size.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="epochal-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir()
