"""Roll-ups of the task plane: status partition, reason tallies, failure groups, lint findings."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from freshet.functions.columns import exception_type, traceback_frames


def status_counts(status: Column, to_run: Column) -> list[Column]:
    """The four states, which partition the tasks, and the number to run."""
    count = lambda c, name: F.count_if(c).alias(name)
    return [
        F.count(F.lit(1)).alias("tasks"), count((status == "success") & ~to_run, "up_to_date"), count((status == "success") & to_run, "stale"),
        count(status == "failed", "failed"), count(status.isNull() | (status == "pending"), "pending"), count(to_run, "to_run"),
    ]


def status_partition(tasks: DataFrame, rule: str, status: str, to_run: str, totals: bool = False) -> DataFrame:
    group = tasks.rollup(rule) if totals else tasks.groupBy(rule)
    return group.agg(*status_counts(F.col(status), F.col(to_run)))


def reason_tally(tasks: DataFrame, rule: str, reasons: str) -> DataFrame:
    """How many tasks have each reason; a task may add to several."""
    return tasks.select(rule, F.explode(reasons).alias("category")).groupBy(rule, "category").agg(F.count("*").alias("n"))


def _signed(records: DataFrame, order: str, exception: str, label: str) -> DataFrame:
    """Failures with their signature: ``type``, and ``place``, the frames, outermost first."""
    frames = traceback_frames(F.col(exception))
    return records.select(order, label, exception_type(F.col(exception)).alias("type"), frames.alias("place"))


def failure_groups(records: DataFrame, order: str, exception: str, label: str) -> DataFrame:
    """Failures with the same exception type and frames: count, first example, deepest frame."""
    found = _signed(records, order, exception, label).groupBy("type", "place").agg(F.count("*").alias("n"), F.min_by(label, order).alias("example"), F.min(order).alias("first_seen"))
    return found.select("type", F.try_element_at("place", F.lit(-1)).alias("deepest"), "n", "example", "first_seen")


def failure_members(records: DataFrame, order: str, exception: str, label: str) -> DataFrame:
    """Every failure with its group: the signature (``type``, ``place``), the group's ``first_seen``, and the failure's own
    label and order. A group is joined, not gathered."""
    signed = _signed(records, order, exception, label)
    first = signed.groupBy(F.col("type").alias("t"), F.col("place").alias("p")).agg(F.min(order).alias("first_seen"))
    return signed.join(first, F.col("type").eqNullSafe(F.col("t")) & F.col("place").eqNullSafe(F.col("p"))).select("type", "place", "first_seen", label, order)


def proven_elements(needs: DataFrame, gives: DataFrame, place: str, path: str) -> DataFrame:
    """For each place among ``needs`` whether all its paths are given at the same place: ``proven``. Pairs are compared,
    nothing is gathered."""
    given = gives.select(place, path, F.lit(True).alias("__given")).distinct()
    return needs.join(given, [place, path], "left").groupBy(place).agg(F.bool_and(F.col("__given").isNotNull()).alias("proven"))


def still_active(recorded: DataFrame, queue: DataFrame) -> DataFrame:
    """The recorded jobs (``key``, ``job``) that a queue (``job``, ``state``; a row a job) still has."""
    return recorded.join(queue, "job").select("key", "job", "state")


def similarity(a: str, b: str) -> float:
    """The ratio of matching blocks of ``b`` against ``a``."""
    return SequenceMatcher(None, a, b).ratio()


def near_misses(paths: DataFrame, known: DataFrame, least: float = 0.9) -> DataFrame:
    """For each path the most similar other known path with a ratio of ``least`` or more. Pairs are blocked before the
    ratio is taken: the ratio is 2M / (a + b) with M at most the characters they share, so lengths differ by
    a fixed share at most, and each distinct letter that the other path lacks costs one. Of equal ratios the greatest path."""
    a = paths.select(F.col("path"), F.length("path").alias("n"))
    b = known.select(F.col("path").alias("other"), F.length("path").alias("m"))
    bands = lambda n: F.sequence(F.floor(n * least / (2 - least) / 8).cast("int"), F.floor(n * (2 - least) / least / 8).cast("int"))
    blocked = a.withColumn("band", F.explode(bands(F.col("n")))).join(b.withColumn("band", F.floor(F.col("m") / 8).cast("int")), "band").where("path <> other")
    letters = lambda c: F.split(c, "")
    missing = F.size(F.array_except(letters(F.col("path")), letters(F.col("other"))))  # distinct letters without a partner cost one each
    likely = blocked.where(2 * F.least("n", "m") >= F.lit(least) * (F.col("n") + F.col("m"))).where(2 * (F.col("n") - missing) >= F.lit(least) * (F.col("n") + F.col("m")))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            rated = [(x, y, r) for x, y in pairs if (r := similarity(y, x)) >= least]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rated) if rated else [()] * 3, (pa.string(), pa.string(), pa.float64()))], ["path", "other", "ratio"])

    rated = likely.select("path", "other").mapInArrow(rate, "path string, other string, ratio double")
    best = Window.partitionBy("path").orderBy(F.desc("ratio"), F.desc("other"))
    return rated.withColumn("place", F.row_number().over(best)).where("place = 1").select("path", F.col("other").alias("suggestion"), F.round("ratio", 6).alias("ratio"))
