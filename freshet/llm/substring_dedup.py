"""Suffix-array dedup: bytes covered by a string of LENGTH bytes that also starts earlier are removed.

Method: the suffixes that matter are sorted into an enhanced suffix array, whose common-prefix intervals are found by
a stack scan; in each interval the occurrences' left contexts are scanned in the same way, so that groups whose
members can be extended neither to the right (they lie in two intervals below or end there) nor to the left (their
left neighbours differ) come out as maximal repeats with all occurrences. Of each group all but the first
occurrence is removed. The union of these over all maximal repeats of LENGTH bytes or more is the result: a string
that starts earlier, extended as far as both places agree, is such a repeat.

Which suffixes: every window of LENGTH bytes has an anchor, its GRAM-byte string with the least hash (the leftmost
of equals). Equal windows have equal anchors at equal offsets. So it is enough to sort, for each anchor string, the
suffixes that start at its places, each with the context that its windows cover (LENGTH to 2 * LENGTH - GRAM
bytes), and windows with different anchor strings never meet.

Hot anchors, with HOT occurrences or more, are not gathered in one group: a window that starts up to WINDOW - 1 bytes
before a multiple of WINDOW holds the LENGTH - WINDOW + 1 bytes from there on, so each context is dealt to a group for each
of these strings that it holds, and windows that are equal meet in one of them.

What moves: hashes of anchors, as packed sorted differences, to find those that occur twice or more (a table of
bits, of bounded size, is broadcast; a wrong bit only moves a context more); the contexts of these anchors, packed by
range of hash; spans; and the texts once, to be joined with their spans. Within a task equal contexts are settled at
once and only the first is sent, so a passage that a third of all documents share is sent once a task.

Cases: a null or empty text has no bytes; texts shorter than LENGTH keep all; order is by doc_id (null first), then
start; rows with one doc_id and different texts are documents of their own, ordered by a hash of the text; repeated
rows with equal doc_id and text are one document and each get its result; extra columns are ignored; long texts are
taken in pieces that overlap, so nothing is cut.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm import packed
from freshet.llm.common import bounded_broadcast, durable, input_mb, plain, release_shuffles, rows_of
from freshet.llm.shingles import end_power, mixed, powers

LENGTH, GRAM = 100, 24
#: Occurrences from which an anchor is hot, and the step of the strings by which its contexts are dealt out.
HOT, WINDOW = 4096, 11
#: Bytes that are looked at together; contexts that a task holds before it sends them; anchors a MB of input, about.
PIECE, HELD, ANCHORS_MB = 500_000, 50_000, 60_000
#: log2 of the bits of each table of anchors, at most, and their bound in bytes.
TABLE_BITS, TABLE_BOUND = 28, 80_000_000
FIRST_ID = -(1 << 63)

_BYTE_VALUES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def anchors(block: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts laid end to end: each anchor's hash, its place, and the first and last window that have it."""
    n = len(block)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none.astype(np.uint64), none, none, none
    power = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[block] * power[:n], out=total[1:])
    grams = n - GRAM + 1
    h = mixed((total[GRAM:] - total[:grams]) * power[n : n - grams : -1] * end_power(n))
    keys = (h & ~np.uint64(0xFFFFFF)) | np.arange(grams, dtype=np.uint64)
    width, have = LENGTH - GRAM + 1, 1
    least = keys
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    place = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    starts = np.arange(len(place))
    inside = np.searchsorted(ends, starts, side="right") == np.searchsorted(ends, starts + LENGTH - 1, side="right")
    starts, place = starts[inside], place[inside]
    if not len(starts):
        return none.astype(np.uint64), none, none, none
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    # anchors have small hashes, being the least of many: spread them again, so that ranges of hashes fill alike
    return mixed(h[place[first]] + np.uint64(1)), place[first], starts[first], starts[last]


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list, np.ndarray]]:
    """Texts laid end to end, about PIECE bytes or an overlapping part of a longer text: (bytes, ends, keys, offsets)."""
    for batch in rows_of(batches, PIECE, "text"):
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        texts = [x or b"" for x in pc.cast(batch.column(2), pa.binary()).to_pylist()]
        if len(texts) == 1 and len(texts[0]) > PIECE:
            whole = np.frombuffer(texts[0], np.uint8)
            for start in range(0, len(whole) - LENGTH + 1, PIECE):
                part = whole[start : start + PIECE + LENGTH - 1]
                yield part, np.array([len(part)]), keys, np.array([start])
        else:
            yield np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(x) for x in texts]), keys, np.zeros(len(texts), np.int64)


def repeated_anchors(rows: DataFrame, bits: int, ranges: int, table_bits: int) -> list[np.ndarray]:
    """Tables of the anchors that occur twice or more, and of the hot ones."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed.send_counts((anchors(block, ends)[0] for block, ends, _, _ in pieces(batches)), bits, ranges)

    return packed.tables_of(rows.mapInArrow(send, packed.SENT), ranges, bits, [2, HOT], table_bits)


def dealt(anchor: int, context: bytes, left: int) -> list[int]:
    """Hashes of the groups of a hot anchor's context: one for each string of LENGTH - WINDOW + 1 bytes that it holds and that
    starts a multiple of WINDOW bytes before the anchor."""
    size = LENGTH - WINDOW + 1
    starts = range(left, max(-1, left - (LENGTH - GRAM) - 1), -WINDOW)
    return [xxhash.xxh3_64_intdigest(context[at : at + size], seed=(anchor + left - at) & ((1 << 64) - 1)) for at in starts if at + size <= len(context)]


def contexts(rows: DataFrame, tables, table_bits: int, ranges: int) -> DataFrame:
    """Packed contexts by range of anchor (``part`` 0 and up), and spans that were settled here (``part`` -1)."""
    schema = "part int, anchor binary, doc binary, twin binary, start binary, left binary, size binary, bytes binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (bit, hot), names = tables.value, [x.split()[0] for x in schema.split(", ")]
        zip_ = zstandard.ZstdCompressor(level=1)
        held: dict[tuple[bytes, int], tuple] = {}
        gone = array("q")

        def flush() -> Iterator[pa.RecordBatch]:
            out = []
            if gone:
                doc, twin, start, end = (x.tobytes() for x in np.frombuffer(gone, np.int64).reshape(-1, 4).T)
                out.append((-1, b"", doc, twin, start, b"", end, b""))
            if held:
                found = list(held.items())
                hashes = np.asarray([v[3] for _, v in found], np.uint64)
                spread = np.flatnonzero(packed.has_bit(hot, hashes, table_bits))
                if len(spread):
                    more = [(found[i], h) for i in spread.tolist() for h in dealt(found[i][1][3], *found[i][0])]
                    keep = np.delete(np.arange(len(found)), spread)
                    found = [*(found[i] for i in keep.tolist()), *(x for x, _ in more)]
                    hashes = np.concatenate([hashes[keep], np.asarray([h for _, h in more], np.uint64)])
                order = np.argsort(hashes)
                hashes = hashes[order]
                part = (hashes >> np.uint64(64 - ranges)).astype(np.int64)
                edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    some = [found[i] for i in order[a:b]]
                    doc, twin, start = (np.asarray([v[k] for _, v in some], np.int64).tobytes() for k in range(3))
                    out.append((int(part[a]), packed.squeeze(hashes[a:b]), doc, twin, start, bytes(k[1] for k, _ in some), np.asarray([len(k[0]) for k, _ in some], "<u2").tobytes(), zip_.compress(b"".join(k[0] for k, _ in some))))
            held.clear()
            del gone[:]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), *[pa.binary()] * 7))], names)

        for block, ends, keys, offsets in pieces(batches):
            hashes, place, first, last = anchors(block, ends)
            twice = packed.has_bit(bit, hashes, table_bits)
            hashes, place, first, last = hashes[twice], place[twice], first[twice], last[twice]
            text = np.searchsorted(ends, first, side="right")
            begin = np.concatenate([[0], ends])[text] - offsets[text]
            raw = block.tobytes()
            for h, a, s, e, t, b in zip(hashes.tolist(), place.tolist(), first.tolist(), (last + LENGTH).tolist(), text.tolist(), begin.tolist()):
                key, here = (raw[s:e], a - s), (*keys[t], s - b, h)
                there = held.setdefault(key, here)
                if there[:3] != here[:3]:
                    if here[:3] < there[:3]:
                        held[key], there, here = here, here, there
                    gone.extend((here[0], here[1], here[2], here[2] + e - s))
            if len(held) >= HELD or len(gone) >= 16 * HELD:
                yield from flush()
        yield from flush()

    return rows.mapInArrow(send, schema)


def common(a: bytes, b: bytes) -> int:
    """The length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] agrees, a[:high] does not
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int, list[tuple[int, int]]]]:
    """Stack scan of an LCP array (lcp[i]: common prefix of entries i - 1 and i; lcp[0] is not read): each interval
    (value, first, last, intervals just below) whose common prefix is ``least`` or more, those below first."""
    stack: list[tuple[int, int, list]] = []  # value, first entry, intervals below
    for i in range(1, len(lcp) + 1):
        value = lcp[i] if i < len(lcp) else -1
        first, below = i - 1, None
        while stack and stack[-1][0] > value:
            v, first, inner = stack.pop()
            if v >= least:
                yield v, first, i - 1, inner
            below = (first, i - 1)
            if stack and stack[-1][0] >= value:
                stack[-1][2].append(below)
                below = None
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, first, [below] if below else []))


def maximal_repeats(rights: list[bytes], lefts: list[bytes], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """All maximal repeats of ``length`` or more around one anchor: (bytes before the anchor, bytes from it on, the
    occurrences). ``rights``: texts from the anchor on; ``lefts``: texts before it, reversed."""
    order = sorted(range(len(rights)), key=rights.__getitem__)
    longest = max(map(len, lefts))
    lcp = [0, *(common(rights[i], rights[j]) for i, j in zip(order, order[1:]))]
    for right, first, last, below in intervals(lcp, max(1, length - longest)):
        child = {}
        for k, (a, b) in enumerate(below):
            child.update((order[i], k) for i in range(a, b + 1))
        members = sorted(order[first : last + 1], key=lefts.__getitem__)
        left_lcp = [0, *(common(lefts[i], lefts[j]) for i, j in zip(members, members[1:]))]
        for left, a, b, _ in intervals(left_lcp, max(0, length - right)):
            group = members[a : b + 1]  # left extensions differ here; right ones do unless all lie in one interval below
            inner = {child.get(i, ~i) for i in group}
            if len(inner) > 1:
                yield left, right, group


def spans_of(group: pa.Table) -> pa.Table:
    """The spans to remove of a packed range of anchors."""
    unzip = zstandard.ZstdDecompressor()
    hashes = np.concatenate([packed.stretch(x) for x in group.column("anchor").to_pylist()])
    doc, twin, start = (np.frombuffer(b"".join(group.column(c).to_pylist()), "<i8") for c in ("doc", "twin", "start"))
    left = np.frombuffer(b"".join(group.column("left").to_pylist()), np.uint8).astype(np.int64)
    size = np.frombuffer(b"".join(group.column("size").to_pylist()), "<u2").astype(np.int64)
    raw = b"".join(unzip.decompress(x) for x in group.column("bytes").to_pylist())
    at = np.concatenate([[0], np.cumsum(size)])
    order = np.lexsort((start, twin, doc, hashes))
    same = np.flatnonzero(np.concatenate([[True], np.diff(hashes[order]) != 0, [True]]))
    out: list[tuple[int, int, int]] = []  # occurrence, first and last byte
    sizes = np.diff(same)

    pairs = same[:-1][sizes == 2]
    for i, j in zip(order[pairs].tolist(), order[pairs + 1].tolist()):
        # the interval of a pair: its common prefix to the right, extended to the left until the bytes differ
        a, b = at[i] + left[i], at[j] + left[j]
        right = common(raw[a : at[i + 1]], raw[b : at[j + 1]])
        if right + min(left[i], left[j]) >= LENGTH:
            before = common(raw[at[i] : a][::-1], raw[at[j] : b][::-1])
            if before + right >= LENGTH and (doc[i], twin[i], start[i] + left[i]) < (doc[j], twin[j], start[j] + left[j]):
                out.append((j, left[j] - before, left[j] + right))
    for first, n in zip(same[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        some = order[first : first + n].tolist()  # by document and place
        rights = [raw[at[i] + left[i] : at[i + 1]] for i in some]
        lefts = [raw[at[i] : at[i] + left[i]][::-1] for i in some]
        places = [(doc[i], twin[i], start[i] + left[i]) for i in some]
        reach: dict[int, tuple[int, int]] = {}
        for before, right, members in maximal_repeats(rights, lefts, LENGTH):
            earliest = min(places[k] for k in members)
            for k in members:
                if places[k] != earliest:
                    b, r = reach.get(k, (0, 0))
                    reach[k] = max(b, before), max(r, right)
        out.extend((some[k], left[some[k]] - b, left[some[k]] + r) for k, (b, r) in reach.items())
    i, a, b = np.asarray(out, np.int64).reshape(-1, 3).T
    return pa.table({"key": pa.array(doc[i]), "twin": pa.array(twin[i]), "start": pa.array(start[i] + a), "end": pa.array(start[i] + b)})


def settled(group: pa.Table) -> pa.Table:
    doc, twin, start, end = (np.frombuffer(b"".join(group.column(c).to_pylist()), "<i8") for c in ("doc", "twin", "start", "size"))
    return pa.table({"key": pa.array(doc), "twin": pa.array(twin), "start": pa.array(start), "end": pa.array(end)})


def united(spans: np.ndarray) -> np.ndarray:
    """Sorted, disjoint and not adjacent spans with the same union."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], 1)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: ``doc_id``, ``n_bytes``, ``spans`` (array of start, end: the bytes that are removed),
    ``kept`` (binary: the remaining bytes)."""
    spark = docs.sparkSession
    rows = plain(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID)).alias("key"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("twin"), "text")
    kind, narrow, mb = rows.schema["doc_id"].dataType.simpleString(), rows.select("key", "twin", "text"), input_mb(docs)
    expected = ANCHORS_MB * mb
    ranges = packed.range_bits(expected * 4)
    bits = int(min(64, 40 + max(0, np.ceil(np.log2(max(mb, 1) / 2048)))))
    table_bits = int(min(TABLE_BITS, max(20, np.ceil(np.log2(max(4 * expected, 1))))))
    found = repeated_anchors(narrow, bits, ranges, table_bits)
    tables = bounded_broadcast(spark, found, sum(x.nbytes for x in found), TABLE_BOUND, "the tables of repeated anchors")

    sent = contexts(narrow, tables, table_bits, ranges)
    span = "key long, twin long, start long, end long"

    def solve(group: pa.Table) -> pa.Table:
        return spans_of(group) if group.column("part")[0].as_py() >= 0 else settled(group)

    # what is settled has no range: it is dealt out by chance
    parts = F.when(F.col("part") >= 0, F.col("part")).otherwise(-1 - F.pmod(F.xxhash64("doc"), F.lit(1 << ranges))).cast("int")
    spans = sent.withColumn("part", parts).groupBy("part").applyInArrow(solve, span)
    by_doc = durable(spans.groupBy("key", "twin").agg(F.collect_set(F.struct("start", "end")).alias("found")), "spans")
    del sent, spans  # the packed contexts are no longer needed
    release_shuffles(spark)
    joined = rows.join(by_doc, ["key", "twin"], "left").select("doc_id", "text", "found")
    of = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 8_000_000, "text"):
            sizes, spans, kept = [], [], []
            for raw, found in zip(pc.cast(batch.column(1), pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                raw = raw or b""
                out = united(np.asarray([(x["start"], x["end"]) for x in found or ()], np.int64)).tolist()
                edges = [0, *(x for pair in out for x in pair), len(raw)]
                sizes.append(len(raw))
                spans.append([{"start": a, "end": b} for a, b in out])
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, of), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")
