"""What the operators of this folder share: tables, durable intermediate results, bounded broadcasts, Arrow columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: the space and the characters U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir`` where the cluster
    names one, else (tests on one machine) a temporary folder, which is then put into that setting."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="freshet-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def durable(df: DataFrame, label: str, files: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again. This cuts the lineage, survives
    the loss of executors, and makes sure that what is used more than once is computed once. ``files``: at
    most so many, for a table of a row for each group."""
    spark = df.sparkSession
    if files:
        df = df.coalesce(files)
    path = f"{shared_dir(spark)}/freshet/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int) -> DataFrame:
    """``df`` with a hint to broadcast it if it has at most ``most`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of frames that are no longer referred to."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded_broadcast(spark: SparkSession, value, n_bytes: int, bound: int, what: str):
    """Broadcast ``value`` after a check of its size, in bytes, against the documented bound."""
    if n_bytes > bound:
        raise ValueError(f"{what} has {n_bytes} bytes; at most {bound} are broadcast")
    return spark.sparkContext.broadcast(value)


def input_mb(df: DataFrame) -> float:
    """The size of ``df``'s source as files, by Spark's own estimate, for choosing a number of partitions; where the session
    gives none (Spark Connect), half of the bytes of all string columns, by a pass over them."""
    if hasattr(df, "_jdf"):
        return float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / 1e6
    texts = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in df.schema if f.dataType.simpleString() == "string"]
    total = df.agg(F.sum(sum(texts, F.lit(0)))).first()[0]
    return (total or 0) / 2e6


def text_column(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of an Arrow column; a null is an empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def rows_of(batches: Iterator[pa.RecordBatch], at_most_bytes: int, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``at_most_bytes`` of text each, or one longer row."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if not batch.num_rows:
            continue
        lengths = np.asarray([0 if x is None else x for x in pc.binary_length(column).to_pylist()], np.int64)
        start, total = 0, 0
        for i, n in enumerate(lengths):
            if i > start and total + n > at_most_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


#: Rows and bytes of an Arrow batch between the JVM and Python at most: texts are long, and each side holds a batch.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20


def plain(df: DataFrame, **columns: str) -> DataFrame:
    """Only the given columns, under internal names: extra columns and clashing names do not matter. What goes to Python
    goes in short batches; the session's settings for these are lowered to the bounds above, if they are higher."""
    conf = df.sparkSession.conf
    for setting, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        name = f"spark.sql.execution.arrow.{setting}"
        now = conf.get(name, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            conf.set(name, str(most))
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])
