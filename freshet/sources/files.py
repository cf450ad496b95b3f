"""Files that rules read and write, and logs."""

from __future__ import annotations

import contextlib
import json
import logging
import logging.handlers
import os
import sys
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str | list[str], comment: str = "#") -> DataFrame:
    """Lines of text files, ``value``, without comment lines."""
    return spark.read.text(path).where(~F.col("value").startswith(comment))


def read_table(spark: SparkSession, path: str | list[str], schema: str, comment: str = "#") -> DataFrame:
    """CSV with a header, under a given schema; comment lines are left out, fields that do not fit are null."""
    return spark.read.csv(path, schema=schema, header=True, comment=comment, mode="PERMISSIVE")


def fan_in(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """One relation of many tasks' JSON outputs, with the file each row is from."""
    return spark.read.schema(schema).json(paths).withColumn("path", F.input_file_name())


def write_region(df: DataFrame, path: str, by: list[str]) -> None:
    """Write the partitions that ``df`` has into a shared table; the table's other partitions stay. Tasks for different
    regions may write one after the other in any order."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def as_json(df: DataFrame) -> DataFrame:
    """Each row as a JSON text, ``value``; nulls are left out."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


# --- logs ---


class JsonLines(logging.Formatter):
    """A log record as one JSON line with the run's id and what was bound with ``extra={"bound": {...}}``."""

    def __init__(self, run_id: str):
        super().__init__()
        self.run_id = run_id

    def format(self, record: logging.LogRecord) -> str:
        bound = getattr(record, "bound", {})
        return json.dumps({"time": self.formatTime(record, "%Y-%m-%d %H:%M:%S"), "level": record.levelname, "run_id": self.run_id, "message": record.getMessage(), **bound}, default=str)


def log_to(folder: str | Path, run_id: str | None = None, size: int = 5_000_000, kept: int = 3) -> str:
    """Log the package's messages to ``events.jsonl`` in a folder, which is rotated, and its narrative to standard error."""
    run_id = run_id or uuid.uuid4().hex
    Path(folder).mkdir(parents=True, exist_ok=True)
    log = logging.getLogger("freshet")
    for old in log.handlers[:]:
        log.removeHandler(old)
        old.close()
    events = logging.handlers.RotatingFileHandler(Path(folder) / "events.jsonl", maxBytes=size, backupCount=kept)
    events.setFormatter(JsonLines(run_id))
    told = logging.StreamHandler(sys.stderr)
    told.setLevel(logging.INFO)
    log.setLevel(logging.DEBUG)
    log.addHandler(events)
    log.addHandler(told)
    return run_id


def log_events(spark: SparkSession, folder: str | Path) -> DataFrame:
    """The logged events as a relation."""
    return spark.read.schema("time string, level string, run_id string, message string, event string, rule string, n long, seconds double").json([str(p) for p in Path(folder).glob("events.jsonl*")])


def task_log(folder: str | Path, key: str) -> Path:
    return Path(folder) / key[:2] / f"{key[2:]}.log"


@contextlib.contextmanager
def to_task_log(folder: str | Path | None, key: str) -> Iterator[None]:
    """What a task prints goes to a file of its own."""
    if folder is None:
        yield
        return
    path = task_log(folder, key)
    os.makedirs(path.parent, exist_ok=True)
    with open(path, "w") as f, contextlib.redirect_stdout(f):
        yield
