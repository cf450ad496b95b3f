"""The registered queries of this folder's operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import oracles
from freshet.llm.common import table

#: The rules of the registered url query.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
OP2_SQL = oracles.OP2


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freshet.llm.url_filter import url_filter

    return url_filter(table(spark, sf_dir, "pages"), URL_RULES)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    from freshet.llm.bpe import bpe_encode

    encoded = bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freshet.llm.substring_dedup import substring_dedup

    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from freshet.llm.secrets import secret_spans

    def listed(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    found = secret_spans(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    def number(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind in ("assign", "access", "hex")]
    base = listed(F.filter("spans", lambda x: x["kind"] != "guess"))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' lines by source: what is boilerplate there is dropped."""
    from freshet.llm.line_dedup import drop_boilerplate

    found = drop_boilerplate(table(spark, sf_dir, "documents"), max_ratio=0.1, min_pages=5)
    n, kept = F.greatest(F.coalesce(F.size("lines"), F.lit(0)), F.lit(0)), F.greatest(F.coalesce(F.size("kept"), F.lit(0)), F.lit(0))
    return found.select("row.doc_id", "row.source", n.cast("long").alias("n_lines"), (n - kept).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freshet.llm.quality_rules import fit_groups, judged, with_statistics
    from freshet.llm.common import durable

    stats = durable(with_statistics(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).withColumn("doc_id", F.col("row.doc_id")).drop("row"), "quality-statistics")
    return judged(stats, fit_groups(stats)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' mixture with 0.95 of the largest entropy, at most 4 epochs, and as many tokens as they have."""
    from freshet.llm.mixing import mix, word_count

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("tokens"))
    mixed = mix(docs, F.col("tokens"), ["doc_id"], target_entropy=0.95, max_repeats=4.0, budget=1.0)
    return mixed.select("row.doc_id", "source", "tokens", "epoch", "block", "position")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freshet.llm.topk import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freshet.llm.ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))[0].select("doc_id", "n_shingles", "component_id")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freshet.llm.license_scan import license_matches

    return license_matches(table(spark, sf_dir, "documents"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules alone decide of op1's rows."""
    found = op1_url_filter(spark, sf_dir)
    return found.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict"))


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fixed patterns find of op5's rows."""
    return op5_secrets(spark, sf_dir).drop("spans")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics and fixed rules of op6's rows."""
    return op6_quality_rules(spark, sf_dir).drop("kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_url_filter, op2_line_dedup, op3_bpe, op4_substring_dedup, op5_secrets, op6_quality_rules, op7_top_k, op8_mixing, op9_jaccard_join, op10_license_scan]
    return {f.__name__: f for f in [*ops, url_rules, secret_base, quality_base]}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query. ``url_rules``, ``secret_base`` and ``quality_base`` are the columns of op1, op5 and op6 that
    it can express."""
    return {"op2_line_dedup": oracles.OP2, "op7_top_k": oracles.TOP_K, "op9_jaccard_join": oracles.JACCARD, "url_rules": oracles.url_rules(URL_RULES), "secret_base": oracles.SECRET_BASE, "quality_base": oracles.QUALITY_BASE}
