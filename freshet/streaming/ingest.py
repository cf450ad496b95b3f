"""Results of tasks that ran elsewhere: small JSON files, taken in as a batch or as a stream of files."""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.sources.scratch import durable
from freshet.sources.state import StateStore, track

RESULT = (
    "key string, rule string, status int, exception string, run_hash string, uses_hash string, io_hash string, run_seq long, timestamp string,"
    " resources struct<wall_s:double,cpu_s:double,max_rss_bytes:bigint,rss_method:string>"
)


def write_result(folder: str | Path, key: str, **result) -> Path:
    """One task's result, written aside and renamed, in a folder by the key's first two letters."""
    path = Path(folder) / key[:2] / f"{key[2:]}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    aside = path.with_suffix(f".{uuid.uuid4().hex}")
    aside.write_text(json.dumps({"key": key} | result))
    os.replace(aside, path)
    return path


def write_spec(folder: str | Path, run_seq: int, rule: str, tasks: DataFrame) -> str:
    """What a run hands to another scheduler: written once; an existing one is an error."""
    path = f"{folder}/{run_seq}/{rule}"
    tasks.select("key", "kw").withColumns({"rule": F.lit(rule), "run_seq": F.lit(run_seq)}).write.mode("errorifexists").json(path)
    return path


def newest(results: DataFrame) -> DataFrame:
    """One result a task: by run clock (an unknown one is older), then time, then all its columns."""
    order = F.struct(F.coalesce("run_seq", F.lit(-1)).alias("clock"), F.coalesce("timestamp", F.lit("")).alias("time"), F.to_json(F.struct(*[c for c in results.columns if c not in ("run_seq", "timestamp")])).alias("rest"))
    return results.groupBy("key").agg(F.max_by(F.struct(*[c for c in results.columns if c != "key"]), order).alias("last")).select("key", "last.*")


def unsurpassed(results: DataFrame, records: DataFrame) -> DataFrame:
    """The results that no record has overtaken: a recorded run clock that is larger stays, whenever a result arrives; of equal
    clocks the later time wins, and an equal time is the same result again."""
    known = records.select("key", F.col("run_seq").alias("had_seq"), F.coalesce("ts", F.lit("")).alias("had_ts"))
    seq, had = F.coalesce("run_seq", F.lit(-1)), F.coalesce("had_seq", F.lit(-1))
    newer = F.col("had_ts").isNull() | (seq > had) | ((seq == had) & (F.coalesce("timestamp", F.lit("")) > F.col("had_ts")))
    return results.join(known, "key", "left").where(newer).drop("had_seq", "had_ts")


def events_of(results: DataFrame, store: StateStore, current: dict[str, tuple] | None = None) -> DataFrame:
    """Events for the store, of the results that are readable, newest for their task and not overtaken by a record. Versions are
    few, so their texts are interned on the driver. ``current``: for a rule the ids of its present code, declarations and
    specs, which stand in where an older writer left hashes out."""
    spark = results.sparkSession
    good = results.where("key is not null and status is not null").select([c.split()[0] for c in RESULT.split(", ")[:9]] + ["resources"])
    last = durable(unsurpassed(newest(good), store.records(spark)), "results")
    hashes = ["run_hash", "uses_hash", "io_hash"]
    texts = [r[0] for r in last.select(F.explode(F.array(*hashes)).alias("t")).where("t is not null").distinct().collect()]
    ids = dict(zip(texts, store.intern(texts)))
    table = spark.createDataFrame(list(ids.items()) or [(None, None)], "t string, id long")
    present = spark.createDataFrame([(r, *i) for r, i in (current or {}).items()] or [(None,) * 4], "rule string, run_now long, uses_now long, io_now long")
    last = last.join(F.broadcast(present), "rule", "left")  # a row a rule
    for h, name in zip(hashes, ("run_code_id", "uses_code_id", "io_code_id")):
        told = F.broadcast(table.select(F.col("t").alias(h), F.col("id").alias(name)))  # a row a version
        last = last.join(told, h, "left").withColumn(name, F.coalesce(name, name.replace("_code_id", "_now")))
    return last.select("key", "rule", F.lit("exec").alias("kind"), "status", F.col("timestamp").alias("ts"), "run_code_id", "uses_code_id", "io_code_id", "run_seq", F.coalesce("exception", F.lit("")).alias("exception"), "resources.*")


def present_ids(store: StateStore, pipeline) -> dict[str, tuple]:
    return {r.name: track(store, r) for r in pipeline.rules} if pipeline is not None else {}


def read_results(spark: SparkSession, folder: str | Path) -> DataFrame:
    """All results of a folder with their ``file``; what cannot be parsed has nulls, what vanishes meanwhile is left out."""
    reader = spark.read.schema(RESULT).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("ignoreMissingFiles", "true")
    return reader.json(str(folder)).withColumn("file", F.col("_metadata.file_path"))


def remove_files(files: DataFrame) -> int:
    """Delete the files of the column ``file``, on the executors; one that is gone is fine. Gives how many there were."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, path = fs.FileSystem.from_uri(name)
                with contextlib.suppress(FileNotFoundError):
                    system.delete_file(path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return files.select("file").distinct().mapInArrow(remove, "n long").agg(F.sum("n").alias("n")).first().n or 0


def ingest(spark: SparkSession, folder: str | Path, store: StateStore, pipeline=None) -> int:
    """Take in all results of a folder, delete the files that were read, and tell how many. Files that cannot be read stay.
    Doing it again changes nothing, and what arrives late never replaces what ran later."""
    if "://" not in str(folder) and not os.path.isdir(folder):
        return 0
    found = durable(read_results(spark, folder), "ingest")
    good = found.where("key is not null and status is not null")
    if good.isEmpty():
        return 0
    store.append(events_of(good, store, present_ids(store, pipeline)))
    return remove_files(good)


def ingest_stream(spark: SparkSession, folder: str, store: StateStore, checkpoint: str, pipeline=None):
    """The same as a stream: what is there now is taken in once, in micro-batches; call it again for what comes later. A batch
    that is replayed is known by its number and checkpoint. The source deletes files of completed batches."""
    stream = spark.readStream.schema(RESULT).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("cleanSource", "delete").json(folder)

    def take(batch: DataFrame, number: int) -> None:
        name = f"{checkpoint}#{number}"
        if not store.taken(name) and not batch.isEmpty():
            store.take(name, events_of(batch, store, present_ids(store, pipeline)))

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
