"""Mixing sources to target weights by temperature, with DataFrame functions only.

Method: each source's share p of the tokens is raised to an exponent between 0 and 1 and normalised. The
exponent is bisected (SECTIONS parts at a time, one aggregate each) to the largest that gives the target entropy,
or to the least that keeps every source within the repetition limit, whichever is larger. The weights times a token
budget give each source's target, which block permutations realise: documents fall into blocks by hash; each
epoch permutes blocks and, within them, documents, and a copy is taken while its first token lies before the target.

Plan: (source, tokens) and (source, block, tokens) are pre-aggregated; running totals are over blocks, then within
a block, so no source is gathered in one task.

Cases: a null or empty text counts as one token, so it can be placed; a null source is ""; repeated rows are rows of
their own; rows with equal keys are ordered by a hash of all their columns, so that the result does not depend on the
input's order (rows that are equal throughout may change places); the result has the input's columns under ``row``, whatever their names; an empty table gives an empty
result; one source has weight 1.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from freshet.llm.common import SPACE_CLASS, durable, small

#: Parts into which the exponent's interval is cut in each round, and rounds.
SECTIONS, ROUNDS = 32, 5
#: Documents of a block, about, and blocks of a source at most.
BLOCK_DOCS, MAX_BLOCKS = 256, 65_536
#: Sources whose table is broadcast at most (about 40 bytes each); beyond, it is joined with so many salts.
BROADCAST_SOURCES, SALTS = 300_000, 64


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")).cast("long")


def exponent(shares: DataFrame, target_entropy: float, max_repeats: float, budget: float | None) -> float:
    """``shares``: a row for each source with its share ``p``. ``target_entropy`` is a part of ln(sources);
    ``budget`` is in multiples of all tokens; None: the least that takes every document once."""
    n = shares.count()
    if n < 2:
        return 1.0

    def measure(values: list[float]) -> list[tuple[float, float]]:
        """Entropy and largest repetition at each exponent, in one aggregate."""
        lp = F.log("p")
        cells = [c for i, a in enumerate(values) for c in (F.sum(F.exp(a * lp)).alias(f"z{i}"), F.sum(F.exp(a * lp) * lp).alias(f"y{i}"), F.max(F.exp((a - 1) * lp)).alias(f"u{i}"), F.max(F.exp((1 - a) * lp)).alias(f"v{i}"))]
        r = shares.agg(*cells).first()
        return [(math.log(r[f"z{i}"]) - a * r[f"y{i}"] / r[f"z{i}"], r[f"u{i}"] * r[f"v{i}"] if budget is None else budget * r[f"u{i}"] / r[f"z{i}"]) for i, a in enumerate(values)]

    def bisect(low: float, high: float, below) -> tuple[float, float]:
        """``below`` holds at exponents up to some point of the interval; the part in which it ends."""
        for _ in range(ROUNDS):
            inner = [low + (high - low) * k / SECTIONS for k in range(1, SECTIONS)]
            ends = [low, *(a for a, m in zip(inner, measure(inner)) if below(*m))]
            low, high = ends[-1], min([a for a in inner if a > ends[-1]], default=high)
        return low, high

    (h1, r1), target = measure([1.0])[0], target_entropy * math.log(n)
    chosen = 1.0
    if h1 < target:
        chosen = bisect(0.0, 1.0, lambda h, r: h >= target)[0]
    if measure([chosen])[0][1] > max_repeats > r1:
        chosen = bisect(chosen, 1.0, lambda h, r: r > max_repeats)[1]
    return 1.0 if r1 >= max_repeats else chosen


def _with_blocks(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each row with its source's number of blocks; a hot source is not gathered in either way."""
    few = small(blocks, BROADCAST_SOURCES)
    if few is not blocks:
        return rows.join(few, "source")
    salted = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod("k", F.lit(SALTS)).cast("int")).join(salted, ["source", "salt"]).drop("salt")


def mix(docs: DataFrame, tokens: Column, key: list[str], target_entropy: float = 0.95, max_repeats: float = 4.0, budget: float | None = 1.0, seed: int = 1, source_col: str = "source") -> DataFrame:
    """The mixture: ``row`` (the input's columns), ``source``, ``tokens``, ``epoch`` from 0, ``block``, ``position`` (the
    copy's first token in its source's sequence). ``key`` names the columns that are hashed for the order."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("source"), F.greatest(tokens, F.lit(1)).cast("long").alias("tokens"), F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in key]).alias("k"), F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]).alias("whole"))
    sources = durable(rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("total")), "mix-sources")
    everything = sources.agg(F.sum("total").alias("t")).first().t or 1
    shares = durable(sources.select("source", "docs", "total", (F.col("total") / F.lit(float(everything))).alias("p")), "mix-shares")
    a = exponent(shares, target_entropy, max_repeats, budget)
    r = shares.agg(F.sum(F.pow("p", F.lit(a))).alias("z"), F.max(F.pow("p", F.lit(1 - a))).alias("v")).first()
    if r.z is None:
        allowed = 0.0
    elif budget is None:
        allowed = r.z * r.v * everything
    else:
        allowed = min(budget, max_repeats) * everything
    weight = F.pow("p", F.lit(a)) / F.lit(r.z or 1.0)
    wanted = F.ceil(F.round(weight * F.lit(allowed), 3)).cast("long")
    wanted = F.greatest(wanted, F.col("total")) if budget is None else wanted
    blocks = F.least(F.ceil(F.col("docs") / BLOCK_DOCS), F.lit(MAX_BLOCKS)).cast("long")
    plan = durable(shares.select("source", "total", wanted.alias("wanted"), blocks.alias("blocks")), "mix-plan")

    blocked = _with_blocks(rows, plan.select("source", "blocks")).withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks"))).drop("blocks")
    filled = blocked.groupBy("source", "block").agg(F.sum("tokens").alias("filled")).join(plan, "source")
    epochs = filled.select("source", "block", "filled", "total", "wanted", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("wanted") / F.col("total"))).cast("int") - 1)).alias("epoch"))
    order = Window.partitionBy("source", "epoch").orderBy(F.xxhash64(F.lit(seed), "block", "epoch"), "block").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("epoch") * F.col("total") + F.coalesce(F.sum("filled").over(order), F.lit(0))
    starts = epochs.withColumn("first", first).where(F.col("first") < F.col("wanted"))
    starts = durable(starts.groupBy("source", "block").agg(F.max("wanted").alias("wanted"), F.array_sort(F.collect_list(F.struct("epoch", "first"))).alias("starts")), "mix-blocks")

    copies = blocked.join(starts, ["source", "block"]).select("row", "source", "tokens", "k", "whole", "block", "wanted", F.explode("starts").alias("s")).select("row", "source", "tokens", "k", "whole", "block", "wanted", "s.epoch", "s.first")
    inside = Window.partitionBy("source", "block", "epoch").orderBy(F.xxhash64("k", "epoch"), "k", "whole").rowsBetween(Window.unboundedPreceding, -1)
    placed = copies.withColumn("position", F.col("first") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    return placed.where(F.col("position") < F.col("wanted")).select("row", "source", "tokens", "epoch", "block", "position")
