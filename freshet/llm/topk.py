"""Exact top-k search by inner product over sparse or dense rows.

Method: exhaustive term-at-a-time accumulation. A block of candidates becomes posting lists, one for each
term (vector component) with the weights of the candidates that have it. Each query row is a sparse list of
terms; every term scatters query weight times posting weight into the query's dense array of scores. A
partition selection keeps the k best of the block, which are merged with the best so far; each task
returns k rows a query at most, and these are merged by rank.

Plan: queries and candidates are packed into blocks, a row each, and every block of queries meets every block of
candidates in one job; nothing passes through the driver. The packed queries are broadcast if they have at most
QUERY_BOUND bytes, else Spark deals out the pairs of blocks.

Weights and scores are whole numbers without a limit: 64-bit arithmetic where a bound on the sums allows it, else
integers of any size, for the rows concerned only.

Cases: vectors that are null or hold a null, NaN or infinite component take no part; shorter vectors have
no weight in the missing components; empty vectors have score 0 with everything; a query's own row is each row
with its id; a repeated query row is one query, and rows with one id and different vectors are a query each; repeated
candidate rows are candidates each; ties go to the smaller id; ranks follow the exact scores, and a score beyond 64 bits is
given as the nearest 64-bit integer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.common import durable, plain

#: Rows of a block of queries and of candidates at most, components of a block, and bytes of queries that are broadcast.
QUERY_BLOCK, CANDIDATE_BLOCK, BLOCK_VALUES, QUERY_BOUND = 4096, 2048, 1 << 20, 256_000_000
#: Sums below this stay in 64 bits; larger scores have a key of so many bytes to be ordered by.
SAFE, KEY_BYTES = 1 << 62, 320
NOTHING = -(1 << (8 * KEY_BYTES - 2))

PACKED = "block long, ids binary, twins binary, lengths binary, parts binary"


def taking_part(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id``, ``twin`` (the vector's hash) and ``vector`` (of doubles) of the rows that take part."""
    v = F.col("vector")
    rows = plain(vectors, vec_id=id_col, vector=vector_col).where(F.col("vec_id").isNotNull() & v.isNotNull())
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("vector"))
    unusable = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.where(~unusable).select("vec_id", F.xxhash64("vector").alias("twin"), "vector")


def packed_blocks(rows: DataFrame, most: int) -> DataFrame:
    """The rows in blocks of at most ``most`` rows and about BLOCK_VALUES components."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(pc.list_value_length(batch.column(2)), np.int64)
            ids, twins, flat = (np.asarray(x) for x in (batch.column(0), batch.column(1), batch.column(2).flatten()))
            ends = np.concatenate([[0], np.cumsum(lengths)])
            start = 0
            while start < len(ids):
                stop = max(start + 1, min(start + most, int(np.searchsorted(ends, ends[start] + BLOCK_VALUES, side="right")) - 1))
                parts = (ids[start:stop].astype("<i8"), twins[start:stop].astype("<i8"), lengths[start:stop].astype("<i8"), flat[ends[start] : ends[stop]].astype("<f8"))
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], ["block", "ids", "twins", "lengths", "parts"])
                start = stop

    return rows.mapInArrow(pack, PACKED).withColumn("block", F.monotonically_increasing_id())


def whole(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of finite doubles as integers: of 64 bits if all are below 2^53, else of any size."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    if not len(scaled) or np.abs(scaled).max() < 2**53:
        return scaled.astype(np.int64)
    return np.array([int(y) if math.isfinite(y) else math.floor(Fraction(x) * Fraction(scale)) for x, y in zip(values.tolist(), scaled.tolist())], object)


def unpacked(lengths: bytes, parts: bytes, scale: float) -> list[np.ndarray]:
    ends = np.cumsum(np.frombuffer(lengths, "<i8"))
    return [whole(x, scale) for x in np.split(np.frombuffer(parts, "<f8"), ends[:-1])] if len(ends) else []


def most_of(lists: list[np.ndarray]) -> np.ndarray:
    """An upper bound of the sum of the absolute weights of each list, as a double."""
    return np.asarray([float(min(sum(map(abs, x.tolist())), 1 << 1000)) * 1.001 for x in lists])


def postings(lists: list[np.ndarray], kind: type) -> list[tuple[object, np.ndarray]]:
    """For each term the candidates that have it (a slice if most do) and their weights."""
    width = max(map(len, lists), default=0)
    dense = np.zeros((len(lists), width), kind)
    for i, x in enumerate(lists):
        dense[i, : len(x)] = x
    out = []
    for t in range(width):
        weights = dense[:, t]
        held = np.flatnonzero(weights)
        out.append((slice(None), np.ascontiguousarray(weights)) if 2 * len(held) > len(lists) else (held, weights[held]))
    return out


def accumulate(queries: list[np.ndarray], lists: list[tuple[object, np.ndarray]], n: int, kind: type) -> np.ndarray:
    """The dense arrays of scores, a row for each query."""
    scores = np.zeros((len(queries), n), kind)
    for row, query in zip(scores, queries):
        terms = np.flatnonzero(query)
        for t, w in zip(terms.tolist(), query[terms].tolist()):
            if t < len(lists):
                held, posted = lists[t]
                row[held] += posted * w
    return scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k best (score, id), ties to the smaller id; ids are ascending in each row."""
    n = scores.shape[1]
    if n > k:
        kth = (np.sort(scores, axis=1) if scores.dtype == object else np.partition(scores, n - k, axis=1))[:, n - k, None]
        above, level = (scores > kth).astype(bool), (scores == kth).astype(bool)
        level &= np.cumsum(level, axis=1, dtype=np.int32) <= (k - above.sum(axis=1))[:, None]
        at = np.nonzero(above | level)[1].reshape(len(scores), k)
        scores, ids = np.take_along_axis(scores, at, 1), np.take_along_axis(ids, at, 1)
    return scores, ids


def block_best(own: np.ndarray, asked: list[np.ndarray], ids: np.ndarray, lists: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of a block of candidates for each query, or fewer and NOTHING; scores in 64 bits if all can be."""
    order = np.argsort(ids, kind="stable")
    ids, lists = ids[order], [lists[i] for i in order]
    peak = lambda rows: max((float(min(np.abs(x).max(), 1 << 1000)) if len(x) else 0.0 for x in rows), default=0.0)
    small = peak(lists) * float(most_of(asked).max(initial=0.0)) < SAFE
    kind = np.int64 if small else object
    scores = accumulate([x if small else x.astype(object) for x in asked], postings(lists, kind), len(lists), kind)
    shown = np.broadcast_to(ids, scores.shape)
    scores = np.where(shown != own[:, None], scores, np.iinfo(np.int64).min if small else NOTHING)
    return best(scores, shown, k)


def merged(a: tuple, b: tuple, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two results for the same queries."""
    if a[0].dtype != b[0].dtype:
        a, b = ((np.where(i != own[:, None], s.astype(object), NOTHING), i) for s, i in (a, b))
    s, i = np.hstack([a[0], b[0]]), np.hstack([a[1], b[1]])
    by_id = np.argsort(i, axis=1, kind="stable")
    return best(np.take_along_axis(s, by_id, 1), np.take_along_axis(i, by_id, 1), k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """For each row of ``queries`` its k best rows of ``vectors`` but those with its own id (all, if fewer):
    ``query_id``, ``rank`` from 1, ``vec_id``, ``score``."""
    candidates = packed_blocks(taking_part(vectors, id_col, vector_col), CANDIDATE_BLOCK)
    asked = taking_part(queries, id_col, vector_col).dropDuplicates(["vec_id", "vector"])
    blocks = durable(packed_blocks(asked, QUERY_BLOCK), "query-blocks")
    size = blocks.agg(F.sum(F.length("parts") + 3 * F.length("ids")).alias("n")).first().n or 0
    pairs = candidates.select("ids", "lengths", "parts", "block").toDF("ids", "lengths", "parts", "place").crossJoin(
        (F.broadcast(blocks) if size <= QUERY_BOUND else blocks).toDF("block", "own", "twins", "sizes", "asked"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}  # by block of queries: ids, twins, weights
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        place, ids, lists = None, None, None
        for batch in batches:
            for row in range(batch.num_rows):
                cell = lambda c: batch.column(c)[row].as_py()  # noqa: B023, E731
                if cell("place") != place:
                    place, ids, lists = cell("place"), np.frombuffer(cell("ids"), "<i8"), unpacked(cell("lengths"), cell("parts"), scale)
                block = cell("block")
                if block not in held:
                    held[block] = np.frombuffer(cell("own"), "<i8"), np.frombuffer(cell("twins"), "<i8"), unpacked(cell("sizes"), cell("asked"), scale)
                own, _, asked = held[block]
                here = block_best(own, asked, ids, lists, k)
                found[block] = merged(found[block], here, own, k) if block in found else here
        for block, (scores, near) in found.items():
            own, twins, _ = held[block]
            real = near != own[:, None]
            query = np.broadcast_to(np.arange(len(own))[:, None], near.shape)[real]
            values = scores[real].tolist()
            shown = [max(-(1 << 63), min((1 << 63) - 1, x)) for x in values]
            over = [(x + (1 << (8 * KEY_BYTES - 1))).to_bytes(KEY_BYTES, "big") if abs(x) >= SAFE else None for x in values]
            yield pa.RecordBatch.from_arrays([pa.array(own[query]), pa.array(twins[query]), pa.array(near[real]), pa.array(shown, pa.int64()), pa.array(over, pa.binary())], ["query_id", "twin", "vec_id", "score", "over"])

    near = pairs.mapInArrow(search, "query_id long, twin long, vec_id long, score long, over binary")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "twin").orderBy(F.desc("score"), F.desc("over"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
