"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, source mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``docs``. Nulls, empty and long texts, ties, repeated rows and
empty tables have the results that the operators' own notes state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.common import durable, table
from freshet.llm.line_dedup import line_dedup
from freshet.llm.mixing import mix, word_count
from freshet.llm.ngram_join import jaccard_components
from freshet.llm.quality_rules import quality_filter
from freshet.llm.queries import bpe_digests


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the fixed rules and the robust outlier test keep."""
    return quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without its source's boilerplate lines; ``n_chars`` follows the text."""
    return line_dedup(docs, chars_col="n_chars", max_ratio=0.1, min_pages=5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 connect: the one with the smallest id, a null id last. Rows
    are told apart by id and text. Of repeated rows (equal id and text) one stays, the one with the least hash of all its
    columns; documents without words stay."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("twin"))
    rows = docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = durable(jaccard_components(rows.select("key", F.col("row.text").alias("text")), id_col="key")[0], "components")
    kept = rows.join(found.where("not (doc_id <=> component_id)").select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti")
    again = durable(found.groupBy(F.col("doc_id").alias("key")).count().where("count > 1").select("key"), "repeated-rows")
    if not again.isEmpty():
        one = kept.join(again, "key", "left_semi").groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        kept = kept.join(again, "key", "left_anti").unionByName(one)
    return kept.select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture with the smallest budget that takes every document once: small sources are repeated, up to 4 times,
    towards 0.95 of the largest entropy."""
    return mix(docs, word_count(F.col("text")), ["doc_id"], target_entropy=0.95, max_repeats=4.0, budget=None).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's tokens: ``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``."""
    return bpe_digests(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("mixing", mixture), ("BPE", encode)]

#: SQL can't express the outlier test, the bisected mixture or the merges; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
