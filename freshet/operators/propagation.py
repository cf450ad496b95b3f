"""What a task learns of its upstream tasks: of the one with its own kwargs where both rules have one matrix, else of all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_upstream(tasks: DataFrame, upstream: DataFrame, elementwise: bool, facts: list[Column]) -> DataFrame:
    """``tasks`` with aggregates over their upstream tasks, pre-aggregated: by ``kw_id``, or one broadcast row."""
    if elementwise:
        return tasks.join(upstream.groupBy("kw_id").agg(*facts), "kw_id", "left")
    return tasks.join(F.broadcast(upstream.agg(*facts)), F.lit(True))


def not_tainted(tasks: DataFrame, failed: DataFrame, elementwise: bool) -> DataFrame:
    """``tasks`` without a failed upstream task (``kw_id``) in this run."""
    if elementwise:
        return tasks.join(failed.select("kw_id").distinct(), "kw_id", "left_anti")
    return tasks.join(F.broadcast(failed.select(F.lit(1).alias("any_failed")).limit(1)), F.lit(True), "left_anti")


def ran_later(upstream_clock: Column, own_clock: Column) -> Column:
    """Whether an upstream task ran after a task: strictly; unknown clocks never count."""
    return F.coalesce(upstream_clock > own_clock, F.lit(False))
