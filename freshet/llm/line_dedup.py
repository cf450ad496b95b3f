"""Line dedup by site-relative frequency, with DataFrame functions only.

Method: for each host the pages that contain a line are counted and divided by the host's pages; lines above
a boilerplate ratio are dropped from that host's pages.

Plan: one shuffle of (host, line hash, count), summed on the map side, so neither a hot host nor a hot line
meets in one task; texts are not shuffled while the boilerplate lines found fit a broadcast (their number is
counted first), and beyond that positions to drop are joined instead, by two written tables, so that Spark's adaptive
execution splits the rows of a hot line. Lines are compared by 64-bit
hashes: a wrong drop needs a line whose hash equals that of one of the same host's few boilerplate lines.

Cases: a null text stays null and has no lines; lines without a word are never counted or dropped; a null host
is the host ""; a row is a page, so repeated rows count as pages; the result has the input's columns, with any
names, and their order; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import durable

#: Boilerplate lines of all hosts, and of one host, that are broadcast at most.
BROADCAST_LINES, HOST_LINES = 200_000, 20_000


def line_hash(line: Column) -> Column:
    return F.xxhash64(line)


def _paged(docs: DataFrame, host_col: str, text_col: str) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit("")).alias("host"), F.split(F.col(f"`{text_col}`"), "\n").alias("lines"))


def boilerplate(docs: DataFrame, max_ratio: float, min_pages: int, host_col: str, text_col: str) -> DataFrame:
    """The hosts' boilerplate lines: ``host``, ``h`` (the line's hash)."""
    pages = _paged(docs, host_col, text_col)
    worded = F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    lines = pages.select("host", F.explode(F.array_distinct(F.transform(worded, line_hash))).alias("h"))
    found = lines.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    return found.join(totals, "host").where(F.col("n") > F.lit(max_ratio) * F.col("pages")).select("host", "h")


def drop_boilerplate(docs: DataFrame, max_ratio: float = 0.1, min_pages: int = 5, host_col: str = "source", text_col: str = "text", broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """``row`` (the input's columns), ``lines`` and ``kept`` (arrays; null for a null text)."""
    drop = durable(boilerplate(docs, max_ratio, min_pages, host_col, text_col), "boilerplate")
    sizes = drop.groupBy("host").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    pages = _paged(docs, host_col, text_col)
    if (sizes.n or 0) <= broadcast_lines and (sizes.most or 0) <= HOST_LINES:
        by_host = drop.groupBy("host").agg(F.collect_set("h").alias("drop"))
        joined = pages.join(F.broadcast(by_host), "host", "left")
        # the few lines of this page that are boilerplate, by a hashed intersection; then the page's lines but those
        hit = joined.select("row", "lines", F.when(F.col("drop").isNotNull() & F.col("lines").isNotNull(), F.array_intersect(F.transform("lines", line_hash), "drop")).alias("hit"))
        kept = F.when(F.coalesce(F.size("hit"), F.lit(0)) > 0, F.filter("lines", lambda x: ~F.array_contains("hit", line_hash(x)))).otherwise(F.col("lines"))
        return hit.select("row", "lines", kept.alias("kept"))
    pages = durable(pages.withColumn("page", F.monotonically_increasing_id()), "pages")  # written once, so that page numbers stay
    placed = durable(pages.select("page", "host", F.posexplode("lines").alias("at", "line")).select("page", "host", "at", line_hash("line").alias("h")), "placed-lines")
    dropped = placed.join(drop, ["host", "h"], "left_semi").groupBy("page").agg(F.collect_set("at").alias("out"))
    kept = F.when(F.col("out").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x, i: ~F.array_contains("out", i)))
    return pages.join(dropped, "page", "left").select("row", "lines", kept.alias("kept"))


def line_dedup(docs: DataFrame, text_col: str = "text", chars_col: str | None = None, **how) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text_col``; ``chars_col`` gets the new length, if given."""
    found = drop_boilerplate(docs, text_col=text_col, **how)
    text = F.array_join("kept", "\n")
    new = {text_col: text} | ({chars_col: F.coalesce(F.length(text), F.lit(0)).cast(docs.schema[chars_col].dataType)} if chars_col else {})
    return found.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
