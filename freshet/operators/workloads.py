"""Transformations that rules of the data plane are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def without_comments(lines: DataFrame, column: str, prefix: str) -> DataFrame:
    return lines.where(~F.col(column).startswith(prefix))


def normalised_above(rows: DataFrame, value: str, threshold: float, by: list[str]) -> DataFrame:
    """Rows strictly above the threshold, scaled to 0..1 within each group; null where all are equal. The extremes are
    aggregated and joined back, so a large group is not gathered."""
    above = rows.where(F.col(value) > threshold)
    ends = above.groupBy(*by).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    return above.join(ends, by).withColumn("scaled", F.try_divide(F.col(value) - F.col("__low"), F.col("__high") - F.col("__low"))).drop("__low", "__high")


def anomaly(rows: DataFrame, value: Column, by: list[str], reference: Column) -> DataFrame:
    """``value`` less its group's mean over the reference rows."""
    means = rows.where(reference).groupBy(*by).agg(F.avg(value).alias("reference_mean"))
    return rows.join(means, by, "left").withColumn("anomaly", value - F.col("reference_mean"))


def seasons(rows: DataFrame, when: str) -> DataFrame:
    """``season`` and ``season_year``; December belongs to the next year's winter."""
    month = F.month(when)
    season = F.when(month.isin(12, 1, 2), "DJF").when(month.isin(3, 4, 5), "MAM").when(month.isin(6, 7, 8), "JJA").otherwise("SON")
    return rows.withColumn("season", season).withColumn("season_year", (F.year(when) + F.when(month == 12, 1).otherwise(0)).cast("long"))


def pairwise_sums(values: DataFrame, group: str, place: str, value: str, stages: int) -> DataFrame:
    """Neighbours summed, again and again; places are from 0. Each stage is a pre-aggregated shuffle."""
    for _ in range(stages):
        values = values.groupBy(group, F.floor(F.col(place) / 2).cast("long").alias(place)).agg(F.sum(value).alias(value))
    return values


def ranked(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)
