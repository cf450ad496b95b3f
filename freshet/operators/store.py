"""The state store's relations: folding an append-only event log into records, interning texts, late results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from freshet.sources.scratch import durable


def fold(events: DataFrame, key: str, seq: str, kind: str, state: list[str], resources: list[str] = ()) -> DataFrame:
    """One record for each key, in one pre-aggregated shuffle. ``kind`` is exec, state or delete. State columns come from
    the latest event; if that is a delete there is no record; the resource columns come together from the
    latest exec event after the last delete, nulls included."""
    is_exec, is_delete = F.col(kind) == "exec", F.col(kind) == "delete"
    found = events.groupBy(key).agg(
        F.max_by(F.struct(kind, seq, *state), seq).alias("last"),
        F.max(F.when(is_delete, F.col(seq))).alias("deleted"),
        F.max_by(F.when(is_exec, F.struct(seq, *resources)), F.when(is_exec, F.col(seq))).alias("ran"),
    )
    found = found.where(F.col("last")[kind] != "delete")
    alive = F.coalesce(F.col("ran")[seq] > F.col("deleted"), F.col("ran").isNotNull())
    return found.select(key, F.col("last")[seq].alias(seq), *[F.col("last")[c].alias(c) for c in state], *[F.when(alive, F.col("ran")[c]).alias(c) for c in resources])


def latest(events: DataFrame, key: str, seq: str, columns: list[str]) -> DataFrame:
    """Last writer wins, by ``seq``."""
    return events.groupBy(key).agg(F.max_by(F.struct(seq, *columns), seq).alias("last")).select(key, "last.*")


def interned(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each row with the least id of its text. Texts are grouped by their SHA-256 and do not move."""
    hashed = texts.select(id_col, F.sha2(F.col(text_col).cast("binary"), 256).alias("__text"))
    first = hashed.groupBy("__text").agg(F.min(id_col).alias("code_id"))
    return hashed.join(first, "__text").select(id_col, "code_id")


def unchanged_ids(codes: DataFrame, id_col: str, text_col: str, current: DataFrame) -> DataFrame:
    """The ids whose text is among the current texts; hashes are compared."""
    digest = F.sha2(F.col(text_col).cast("binary"), 256).alias("__text")
    return codes.select(id_col, digest).join(current.select(digest).distinct(), "__text", "left_semi").select(id_col)


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place in their group, from 0, in ``name``. Rows are dealt out by range of (group, order), so that a
    large group is spread over tasks; a place is the rank in its part and the sizes of the group's parts before."""
    dealt = durable(rows.repartitionByRange(group, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(group, "__part").agg(F.count("*").alias("__n")).select(F.col(group).alias("__group"), F.col("__part").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = dealt.withColumn("__rank", F.row_number().over(Window.partitionBy("__part", group).orderBy(*order)))
    placed = inside.join(F.broadcast(sizes), F.col(group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__of")))  # a row for each group and part
    return placed.select(*rows.columns, (F.col("__before") + F.col("__rank") - 1).cast("long").alias(name))


def array_index(tasks: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The place of each task in its rule's job array, from 0."""
    return numbered(tasks, group, order, "array_index")


def places(tasks: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The place of each task among all, from 1, by ``group``, then ``order``: its place in the group and the number of
    tasks in the groups before, so that only the groups' counts are gathered."""
    before = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    offsets = tasks.groupBy(group).count().select(F.col(group).alias("of"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    placed = numbered(tasks, group, order, "rank").join(F.broadcast(offsets), F.col(group).eqNullSafe(F.col("of")))
    return placed.select((F.col("offset") + F.col("rank") + 1).cast("long").alias("place"), *tasks.columns)


def percentiles(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles of each group, between neighbours in proportion, by the values' places: no group is gathered."""
    placed = durable(numbered(rows.where(F.col(value).isNotNull()).select(group, value), group, [value], "at"), "places")
    ends = placed.groupBy(group).agg(F.count("*").alias("n"), F.max(value).alias("most"))
    wanted = ends.select(group, "n", "most", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), (F.lit(p) * (F.col("n") - 1)).alias("place")) for k, p in shares.items()])).alias("w")).select(group, "most", "w.*")
    low, part = F.floor("place"), F.col("place") - F.floor("place")
    near = wanted.join(placed, group).where(F.col("at").between(low, F.ceil("place")))
    weight = F.when(F.col("at") == low, 1 - part).otherwise(part)
    found = near.groupBy(group, "most", "name").agg(F.sum(F.col(value) * weight).alias("v"))
    return found.groupBy(group, "most").pivot("name", list(shares)).agg(F.first("v"))


def marked_latest(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with ``is_latest``: whether none has a greater ``order``."""
    newest = rows.agg(F.max(order).alias("__newest"))
    return rows.join(F.broadcast(newest), F.lit(True)).withColumn("is_latest", F.col(order) == F.col("__newest")).drop("__newest")


def outdated(rows: DataFrame, when: str, now: Column, days: int) -> DataFrame:
    """The rows of ``marked_latest`` that are older than so many days; the latest stays whatever its age."""
    return rows.where((F.col(when) < now - F.make_dt_interval(F.lit(days))) & ~F.col("is_latest"))


def consecutive_batches(rows: DataFrame, value: str, order: str, within: str) -> DataFrame:
    """Number of the run of equal consecutive values, from 1, within each group."""
    w = Window.partitionBy(within).orderBy(order)
    return rows.withColumn("new", F.coalesce(F.col(value) != F.lag(value).over(w), F.lit(True)).cast("int")).withColumn("batch", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("new")
