"""Intermediate results in the folder that the driver and the executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def durable(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet and read again: computed once, short lineage, and safe from lost executors. The folder is
    ``spark.checkpoint.dir``; where a session on one machine has none, a temporary one is set."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="freshet-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/freshet/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
