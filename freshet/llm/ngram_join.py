"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Method: token-combination prefixes. Shingles ("tokens") have a global order, rare ones first. If two sets x and y
are similar, x lacks at most |x| - ceil(0.8 |x|) of the tokens they share; so a prefix of x is taken until
    (rare tokens) + sum over classes of max(0, tokens of the class - 1)
exceeds that number. Then the pair shares a rare token, or two tokens of one class of frequent tokens, within both
prefixes. Rare tokens are indexed singly, frequent ones by pairs within a class, which extends the prefix by
a token for each class. Classes are hash classes; their number follows a band of set sizes, and a document near the
end of a band is indexed for the next band too. Candidates pass a size filter, a position filter and a filter by
parity bitmaps (their Hamming distance never exceeds the symmetric difference), then are verified by their whole sets.

Stages and what moves (input: texts, read by column once for each of 1 to 3 and for the sets that 4 needs):
1. exact document counts of all shingles, as packed sorted differences (about 3 bytes each); those of FREQUENT documents
   or more set a bit of a table that is broadcast (at most 2^OFTEN_BITS bits). A rare token whose bit is set by another
   one counts as frequent too, for all documents alike; so a full table costs signatures, not results, and the lists of
   rare tokens stay short at any size;
2. a node for each distinct set (hash of the set), its size, bitmap, and signatures of frequent pairs;
3. packed (token, node, size, position) of rare prefix tokens by token range; within a token's few documents the pairs
   that pass the filters are candidates; so is, for each frequent signature, its least node with each other one;
4. the sets of the candidates' nodes and of nodes with a frequent signature are written once; candidates are verified,
   and links give components;
5. rounds over the frequent signatures whose nodes lie in several components. A signature's largest component is its
   head. Each node outside the head is held against the signature's nodes in other components, by size and bitmap, in
   blocks of bounded rows and bytes, and names the k nearest nodes (k: 8, 64, 512, ... round by round). These pairs are
   verified; links unite components, refused pairs are remembered. Who found fewer than k has had all
   its pairs judged and is done, since components only grow; the next round asks the others alone, among the members of
   their signatures, and the rounds end when none is left. A link between two components so ends their comparison, and no
   pair that shares a signature is left out but those already connected. What moves is the members of the asked
   signatures and k pairs a node and round; comparisons within a signature are (nodes outside its head) times (nodes), a
   few words each, and make no rows.
``jaccard_components`` stops there: its links connect each component, but are not all of them. ``jaccard_links`` takes
every pair of a frequent signature instead of 5 (its parts against each other, bitmaps at hand), verifies what
passes, and gives all links and their number for each document; its work grows with the number of links.

Hot signatures, nodes and components: counts and least ids are pre-aggregated; a join by such a key has two written
tables at its sides, so that Spark's adaptive execution splits the hot one's rows.

Hashes: tokens and sets are 64-bit hashes; a wrong result needs two different shingles in a pair, or two different
sets in the corpus, with the same hash.

Cases: a null or empty text, or one without words, has an empty set, is linked with nothing and is its own
component; fewer words than a shingle make one shingle; copies share a node; repeated rows each give a row; extra
columns are ignored; an empty table gives an empty result; long texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm import packed
from freshet.llm.common import bounded_broadcast, durable, input_mb, plain, rows_of, text_column
from freshet.llm.components import components
from freshet.llm.shingles import mixed, shingle_lists

#: Words of a shingle; similarity as a whole-number ratio; documents from which a token is frequent.
WORDS, NUMERATOR, DENOMINATOR, FREQUENT = 5, 80, 100, 64
#: log2 of the bits, at most, of the tables of frequent tokens and of nodes to fetch, and their bound in bytes.
OFTEN_BITS, FETCH_BITS, TABLE_BOUND = 28, 28, 40_000_000
#: Set sizes a class of frequent tokens; shingles a MB of input, about.
CLASS_SIZE, SHINGLES_MB = 8, 250_000
#: Nearest nodes that a node names in the first round; eight times as many in each later one.
FIRST_NAMED = 8
#: Rows and bytes of bitmaps, about, of a block of a frequent signature.
SALTED, SALTED_BYTES = 32_768, 16 << 20


def required(n: int) -> int:
    """The least number of shared tokens for a set of n tokens."""
    return -(-NUMERATOR * n // DENOMINATOR)


def similar(common, n, m):
    return DENOMINATOR * common >= NUMERATOR * (n + m - common)


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Parity of the tokens that fall on each bit; 64 bits or the power of two that is at least four times the set's size."""
    bits = max(64, 1 << int(4 * len(tokens) - 1).bit_length())
    parity = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view("<u8")


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """A bitmap, or rows of such, as bitmaps of ``size`` words: halves are laid over each other."""
    while words.shape[-1] > size:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    size = min(a.shape[-1], b.shape[-1])
    return np.bitwise_count(folded(a, size) ^ folded(b, size)).sum(axis=-1, dtype=np.int64)


def may_link(far, n, m):
    """Whether sets of n and m tokens may be similar if they differ in ``far`` tokens at least."""
    return (n + m - far) * (NUMERATOR + DENOMINATOR) >= 2 * NUMERATOR * (n + m)


def bands(n: int) -> list[tuple[int, int]]:
    """(band, classes) under which a set of n tokens is indexed."""
    low = n.bit_length() - 1
    out = [(low, max(1, (1 << low) // CLASS_SIZE))]
    if DENOMINATOR * n >= NUMERATOR * (2 << low):
        out.append((low + 1, max(1, (2 << low) // CLASS_SIZE)))
    return out


def pair_signatures(rare: int, often: np.ndarray, n: int) -> list[np.ndarray]:
    """For each band the signatures of a set of n tokens with so many rare ones and the frequent ones in order."""
    need, out = n - required(n) + 1, []
    if rare >= need:
        return out
    for band, classes in bands(n):
        kind = (mixed(often ^ np.uint64(0x5BF0_3635)) % np.uint64(classes)).astype(np.int64)
        order = np.argsort(kind, kind="stable")
        first_of_class = np.zeros(len(often), bool)
        if len(often):
            first_of_class[order[np.flatnonzero(np.concatenate([[True], np.diff(kind[order]) != 0]))]] = True
        covered = rare + np.cumsum(~first_of_class)
        end = int(np.searchsorted(covered, need)) + 1
        sigs = []
        for start, stop in _runs(np.sort(kind[:end], kind="stable")):
            members = often[:end][np.argsort(kind[:end], kind="stable")][start:stop]
            i, j = np.triu_indices(len(members), 1)
            sigs.append(mixed(members[i] * np.uint64(3) + mixed(members[j] + np.uint64(band))))
        if sigs:
            out.append(np.concatenate(sigs))
    return out


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of two or more equal keys."""
    if len(keys):
        edges = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if b - a > 1:
                yield a, b


class Often:
    """The frequent tokens, by a table of bits."""

    def __init__(self, table: np.ndarray, bits: int):
        self.table, self.bits = table, bits

    def of(self, tokens: np.ndarray) -> np.ndarray:
        return packed.has_bit(self.table, tokens, self.bits)


def set_id(tokens: np.ndarray) -> int:
    """A hash of a sorted set."""
    spread = mixed(tokens + np.uint64(len(tokens)))
    return int(mixed(np.array([spread.sum(dtype=np.uint64) ^ (np.bitwise_xor.reduce(spread) >> np.uint64(1))], np.uint64)).view(np.int64)[0])


def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in rows_of(batches, 4_000_000, "text"):
        yield batch, [np.unique(x) for x in shingle_lists(text_column(batch, "text"), WORDS)]


def frequent_tokens(rows: DataFrame, bits: int, ranges: int, table_bits: int) -> Often:
    """The tokens of FREQUENT documents or more, by their hashes cut to ``bits``."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed.send_counts((x for _, sets in sets_of(batches) for x in sets if len(x)), bits, ranges)

    return Often(packed.frequent_bits(rows.select("text").mapInArrow(send, packed.SENT), ranges, bits, FREQUENT, table_bits), table_bits)


def nodes_of(rows: DataFrame, often, kind: str) -> DataFrame:
    """``doc_id``, ``node``, ``n``, ``bits`` (bitmap), ``pairs`` (signatures of frequent pairs)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: Often = often.value
        for batch, sets in sets_of(batches):
            pairs = []
            for x in sets:
                often_here = table.of(x)
                few = len(x) - int(often_here.sum())
                pairs.append(np.unique(np.concatenate([np.zeros(0, np.uint64), *pair_signatures(few, x[often_here], len(x))])).view(np.int64) if len(x) > 3 and often_here.any() else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([set_id(x) if len(x) else None for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([bitmap(x).tobytes() if len(x) else None for x in sets], pa.binary()), pa.array(pairs, pa.list_(pa.int64()))], ["doc_id", "node", "n", "bits", "pairs"])

    return rows.mapInArrow(make, f"doc_id {kind}, node long, n long, bits binary, pairs array<long>")


def rare_prefixes(rows: DataFrame, often, ranges: int) -> DataFrame:
    """Packed rows of the rare tokens of prefixes: ``part``, and as binaries ``token``, ``node``, ``n``, ``at``."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: Often = often.value
        held: list[tuple] = []
        total = 0

        def flush() -> pa.RecordBatch:
            token, node, n, at = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(token)
            token, node, n, at = token[order], node[order], n[order], at[order]
            ends = np.searchsorted(token, np.arange(1, 1 << ranges, dtype=np.uint64) << np.uint64(64 - ranges)).tolist() + [len(token)]
            out, start = [], 0
            for part, end in enumerate(ends):
                if end > start:
                    out.append((part, packed.squeeze(token[start:end] - (np.uint64(part) << np.uint64(64 - ranges))), node[start:end].tobytes(), n[start:end].tobytes(), at[start:end].tobytes()))
                start = end
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), *[pa.binary()] * 4))], ["part", "token", "node", "n", "at"])

        for _, sets in sets_of(batches):
            for x in sets:
                if len(x) > 3:  # smaller sets are similar to equal ones only
                    # prefixes have small hashes, being the first in order: spread them again, so that ranges fill alike
                    few = mixed(x[~table.of(x)][: len(x) - required(len(x)) + 1] + np.uint64(1))
                    k = len(few)
                    held.append((few, np.full(k, set_id(x), np.int64), np.full(k, len(x), np.uint32), np.arange(k, dtype=np.uint32)))
                    total += k
            if total >= packed.HELD:
                yield flush()
                held, total = [], 0
        if total:
            yield flush()

    return rows.select("text").mapInArrow(send, "part int, token binary, node binary, n binary, at binary")


def rare_candidates(sent: DataFrame) -> DataFrame:
    """Distinct pairs ``a`` < ``b`` of nodes that share a rare token and pass the size and position filters."""

    def pairs(group: pa.Table) -> pa.Table:
        token = np.concatenate([packed.stretch(x) for x in group.column("token").to_pylist()])
        node, n, at = (np.frombuffer(b"".join(group.column(c).to_pylist()), t).astype(np.int64) for c, t in (("node", "<i8"), ("n", "<u4"), ("at", "<u4")))
        order = np.lexsort((node, token))
        token, node, n, at = token[order], node[order], n[order], at[order]
        once = np.concatenate([[True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])])
        token, node, n, at = token[once], node[once], n[once], at[once]
        ends = np.searchsorted(token, token, side="right")
        out: list[np.ndarray] = []
        i = np.arange(len(token))
        step = 1
        while True:  # every row with the one that stands ``step`` behind it at the same token
            i = i[i + step < ends[i]]
            if not len(i):
                break
            j = i + step
            total = n[i] + n[j]
            fits = (DENOMINATOR * np.minimum(n[i], n[j]) >= NUMERATOR * np.maximum(n[i], n[j])) & ((1 + np.minimum(n[i] - at[i], n[j] - at[j]) - 1) * (NUMERATOR + DENOMINATOR) >= NUMERATOR * total)
            if fits.any():
                out.append(np.stack([node[i[fits]], node[j[fits]]], 1))
                if sum(map(len, out)) > 2_000_000:
                    out = [np.unique(np.concatenate(out), axis=0)]
            step += 1
        found = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})

    return sent.groupBy("part").applyInArrow(pairs, "a long, b long").distinct()


def star_candidates(signed: DataFrame) -> DataFrame:
    """For each frequent signature its least node with each other one."""
    least = durable(signed.groupBy("sig").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("sig", "a"), "least")
    return signed.select("sig", "node").join(least, "sig").where("a < node").select("a", F.col("node").alias("b")).distinct()


def close(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that pass the bitmap filter: ``a``, ``b``."""
    info = nodes.select("node", "n", "bits")
    both = pairs.join(info.toDF("a", "n", "bits"), "a").join(info.toDF("b", "m", "more"), "b")
    sized = both.where(DENOMINATOR * F.least("n", "m") >= NUMERATOR * F.greatest("n", "m")).select("a", "b", "n", "m", "bits", "more")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = np.asarray(batch.column(2), np.int64), np.asarray(batch.column(3), np.int64)
            far = np.asarray([int(distance(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"))) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())], np.int64)
            yield pa.RecordBatch.from_arrays([x.filter(pa.array(may_link(far, n, m))) for x in (batch.column(0), batch.column(1))], ["a", "b"])

    return sized.mapInArrow(keep, "a long, b long")


def sets_for(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node``, ``tokens`` (the sorted set as binary) of the nodes of ``wanted``. Only these sets move, and a few that
    the table of bits takes for one of them."""
    wanted = durable(wanted.distinct(), "wanted")
    bits = int(min(FETCH_BITS, max(16, np.ceil(np.log2(16 * max(wanted.count(), 1))))))
    table = packed.bit_table(wanted, "node", bits)
    fetch = bounded_broadcast(rows.sparkSession, table, table.nbytes, TABLE_BOUND, "the table of nodes to fetch")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in sets_of(batches):
            ids = np.asarray([set_id(x) if len(x) else 0 for x in sets], np.int64)
            kept = [i for i in np.flatnonzero(packed.has_bit(fetch.value, ids.view(np.uint64), bits)) if len(sets[i])]
            yield pa.RecordBatch.from_arrays([pa.array(ids[kept]), pa.array([sets[i].tobytes() for i in kept], pa.binary())], ["node", "tokens"])

    fetched = rows.select("text").mapInArrow(emit, "node long, tokens binary").groupBy("node").agg(F.first("tokens").alias("tokens"))
    return durable(fetched.join(wanted, "node", "left_semi"), "sets")


def verified(pairs: DataFrame, sets: DataFrame, label: str) -> DataFrame:
    """``a``, ``b`` of ``pairs`` and ``linked``: whether their whole sets are similar. Spark splits a hot node's pairs."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                hit.append(bool(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hit, pa.bool_())], ["a", "b", "linked"])

    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return durable(both.mapInArrow(check, "a long, b long, linked boolean"), label)


def blocks(rows, size):
    return F.greatest(F.ceil(rows / SALTED), F.ceil(size / SALTED_BYTES)).cast("int")


def number(of: str):
    """A node's block, of so many."""
    return F.pmod(F.xxhash64("node"), F.col(of)).cast("int")


def each(of: str):
    return F.explode(F.sequence(F.lit(0), F.col(of) - 1))


def nearest(asked: DataFrame, members: DataFrame, refused: DataFrame | None, k: int) -> DataFrame:
    """For each node of ``asked`` (``sig``, ``node``, ``label``, ``n``, ``bits``, ``ins``, and ``o``: its block) its k nearest nodes
    with other labels among its signatures' ``members`` (likewise; a row for each ``o`` that it is held against), of those that
    pass the filters: ``node``, ``near`` (array). ``refused``: pairs to leave out."""
    outer = asked.select("sig", "o", each("ins").alias("i"), F.lit(True).alias("outer"), "node", "label", "n", "bits")
    inner = members.select("sig", "o", number("ins").alias("i"), F.lit(False).alias("outer"), "node", "label", "n", "bits")
    if refused is None:
        outer = outer.withColumn("refused", F.lit(None).cast("array<long>"))
    else:
        both = refused.select(F.col("a").alias("node"), "b").union(refused.select(F.col("b").alias("node"), "a"))
        outer = outer.join(both.groupBy("node").agg(F.collect_set("b").alias("refused")), "node", "left")
    inner = inner.withColumn("refused", F.lit(None).cast("array<long>"))

    def hold(group: pa.Table) -> pa.Table:
        node, label, n = (np.asarray(group.column(c), np.int64) for c in ("node", "label", "n"))
        outer, bits = np.asarray(group.column("outer"), bool), group.column("bits").to_pylist()
        # sizes of a signature's sets lie in a band and next to it, so widths are few
        widths = np.asarray([len(x) // 8 for x in bits])
        full = {w: np.flatnonzero((widths == w) & ~outer) for w in set(widths.tolist())}
        maps = {w: np.frombuffer(b"".join(bits[j] for j in at), "<u8").reshape(-1, w) for w, at in full.items() if len(at)}
        out: list[tuple] = []
        for j in np.flatnonzero(outer).tolist():
            mine, found = np.frombuffer(bits[j], "<u8"), []
            refused = group.column("refused")[j].as_py()
            for w, rows in maps.items():
                at = full[w]
                fits = (label[at] != label[j]) & (DENOMINATOR * np.minimum(n[at], n[j]) >= NUMERATOR * np.maximum(n[at], n[j]))
                if refused:
                    fits &= ~np.isin(node[at], refused)
                at = at[fits]
                if len(at):
                    far = distance(rows[fits], mine)
                    near = may_link(far, n[at], n[j])
                    found.append(np.stack([far[near], node[at[near]]]))
            if found:
                far, near = np.concatenate(found, axis=1)
                order = np.lexsort((near, far))[:k]
                out.extend((node[j], f, x) for f, x in zip(far[order], near[order]))
        columns = list(zip(*out)) or [()] * 3
        return pa.table({c: pa.array(np.asarray(v, np.int64)) for c, v in zip(("node", "far", "near"), columns)})

    found = outer.unionByName(inner).groupBy("sig", "o", "i").applyInArrow(hold, "node long, far long, near long")
    # a node is in a block of each of its signatures, with k rows at most
    best = found.groupBy("node").agg(F.slice(F.array_sort(F.collect_set(F.struct("far", "near"))), 1, k).alias("best"))
    return best.select("node", F.col("best.near").alias("near"))


def united(signed: DataFrame, nodes: DataFrame, sets: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rounds: labels of all components, and the links that were found."""

    def placed(rows: DataFrame, *more: str) -> DataFrame:
        return rows.join(labels, "node", "left").select("sig", "node", F.coalesce("label", "node").alias("label"), *more)

    sizes = placed(signed, "bytes").groupBy("sig", "label").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    most = F.max_by(F.struct("label", "n", "bytes"), F.struct("n", "label"))
    sigs = sizes.groupBy("sig").agg(F.count("*").alias("parts"), most.alias("most"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).where("parts > 1")
    outside = blocks(F.col("n") - F.col("most.n"), F.col("bytes") - F.col("most.bytes"))
    heads = durable(sigs.select("sig", F.col("most.label").alias("head"), blocks(F.col("n"), F.col("bytes")).alias("ins"), outside.alias("outs")), "heads")
    # heads, sizes and bitmaps are joined once, for all rounds
    kept = ("head", "ins", "outs", "n", "bits")
    members = durable(placed(signed.join(heads, "sig").join(nodes.select("node", "n", "bits"), "node"), *kept), "members")
    asked = durable(members.where("label <> head").withColumn("o", number("outs")), "asked")
    held = members.withColumn("o", each("outs"))
    links: DataFrame | None = None
    refused: DataFrame | None = None
    k = FIRST_NAMED
    while not asked.isEmpty():
        named = durable(nearest(asked, held, refused, k), "nearest")
        near = named.select("node", F.explode("near").alias("near"))
        pairs = durable(near.select(F.least("node", "near").alias("a"), F.greatest("node", "near").alias("b")).distinct(), "named")
        if pairs.isEmpty():
            break
        judged = verified(pairs, sets, "round-links")
        new, gone = judged.where("linked").select("a", "b"), judged.where("not linked").select("a", "b")
        links = new if links is None else links.union(new)
        refused = gone if refused is None else refused.union(gone)
        if not new.isEmpty():
            labels = relabelled(labels, new)
        more = durable(named.where(F.size("near") >= k).select("node"), "asking")  # the others' pairs are all judged
        if more.isEmpty():
            break
        asked = placed(members.drop("label").join(more, "node", "left_semi"), *kept)
        asked = asked.join(labels.toDF("head", "to"), "head", "left").where("label <> coalesce(to, head)").drop("to")
        asked = durable(asked.withColumn("o", number("outs")), "asked")
        held = placed(members.drop("label").join(asked.select("sig", "o").distinct(), "sig"), *kept, "o")
        k *= 8
    return labels, links


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels of components after more links."""
    edges = links
    for end in ("a", "b"):
        edges = edges.join(labels.toDF(end, "to"), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    over = components(edges.select("a", "b"))
    moved = labels.join(over.toDF("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return durable(moved.union(over.join(labels, "node", "left_anti").select("node", "label")), "labels")


def within(signed: DataFrame, nodes: DataFrame) -> DataFrame:
    """All pairs of nodes that share a frequent signature and pass the filters. A signature's nodes are salted into parts
    of about SALTED rows, and each two parts meet in a group of their own."""
    sizes = signed.groupBy("sig").agg(F.count("*").alias("rows")).where("rows > 1")
    here = signed.select("sig", "node").join(sizes, "sig").join(nodes.select("node", "n", "bits"), "node").withColumn("salts", F.ceil(F.col("rows") / SALTED).cast("int"))
    here = here.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    met = here.select("sig", "salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("other"), "node", "n", "bits")

    def hold(group: pa.Table) -> pa.Table:
        node, n, salt = (np.asarray(group.column(c), np.int64) for c in ("node", "n", "salt"))
        one_part, bits = bool((salt == salt[0]).all()), group.column("bits").to_pylist()
        widths = np.asarray([len(x) // 8 for x in bits])
        full = {w: np.flatnonzero(widths == w) for w in set(widths.tolist())}
        maps = {w: np.frombuffer(b"".join(bits[i] for i in at), "<u8").reshape(-1, w) for w, at in full.items()}
        own, others = [], []
        for i in range(len(node)):
            mine, near = np.frombuffer(bits[i], "<u8"), []
            for w, at in full.items():
                fits = (node[at] > node[i]) & (DENOMINATOR * np.minimum(n[at], n[i]) >= NUMERATOR * np.maximum(n[at], n[i]))
                if not one_part:
                    fits &= salt[at] != salt[i]
                if fits.any():
                    fits[fits] = may_link(distance(maps[w][fits], mine), n[at[fits]], n[i])
                    near.append(node[at[fits]])
            if near and sum(map(len, near)):
                own.append(node[i])
                others.append(np.concatenate(near).tobytes())
        return pa.table({"node": pa.array(own, pa.int64()), "near": pa.array(others, pa.binary())})

    parts = met.select("sig", F.least("salt", "other").alias("low"), F.greatest("salt", "other").alias("high"), "salt", "node", "n", "bits")
    found = parts.groupBy("sig", "low", "high").applyInArrow(hold, "node long, near binary")
    return found.groupBy("node").applyInArrow(partners, "a long, b long")


def partners(group: pa.Table) -> pa.Table:
    """A node's partners in all its signatures, each once."""
    node = group.column(0)[0].as_py()
    near = np.unique(np.concatenate([np.frombuffer(x, "<i8") for x in group.column(1).to_pylist()]))
    return pa.table({"a": pa.array(np.minimum(near, node)), "b": pa.array(np.maximum(near, node))})


def prepared(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, ...]:
    """Ids and texts, each document's node, the distinct nodes, their frequent signatures, and the candidates of rare tokens."""
    spark, rows = docs.sparkSession, plain(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    mb = input_mb(docs)
    ranges, bits = packed.range_bits(SHINGLES_MB * mb), int(min(64, 40 + max(0, np.ceil(np.log2(max(mb, 1) / 512)))))
    table_bits = int(min(OFTEN_BITS, max(20, np.ceil(np.log2(max(16 * SHINGLES_MB * mb / FREQUENT, 1))))))
    table = frequent_tokens(rows, bits, ranges, table_bits)
    often = bounded_broadcast(spark, table, table.table.nbytes, TABLE_BOUND, "the table of frequent tokens")

    docs_nodes = durable(nodes_of(rows, often, kind), "nodes")
    nodes = durable(docs_nodes.where("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits")), "distinct-nodes")
    signed = durable(docs_nodes.where("size(pairs) > 0").select("node", F.length("bits").alias("bytes"), F.explode("pairs").alias("sig")).distinct(), "signatures")

    return rows, docs_nodes, nodes, signed, rare_candidates(rare_prefixes(rows, often, max(3, ranges)))


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """For each row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` (the smallest ``doc_id`` reachable by links);
    and the links between distinct sets (``a``, ``b``: nodes) that were verified, which connect every component but are not
    all of its links (``jaccard_links`` has these)."""
    rows, docs_nodes, nodes, signed, rare = prepared(docs, id_col, text_col)
    pairs = durable(close(rare.union(star_candidates(signed)).distinct(), nodes), "candidates")
    sets = sets_for(rows, ends_of(pairs).union(signed.select("node")))
    links = verified(pairs, sets, "first-links").where("linked").select("a", "b")
    labels, more = united(signed, nodes, sets, components(links))
    links = links if more is None else links.union(more)

    # the least id of each node, of each component, and back: pre-aggregated, and joined from written tables
    least = durable(docs_nodes.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least")), "least-of-nodes")
    joined = durable(labels.join(least, "node"), "labelled")
    of_label = durable(joined.groupBy("label").agg(F.min("least").alias("component")), "least-of-labels")
    of_node = durable(joined.join(of_label, "label").select("node", "component"), "components")
    own = durable(least.join(of_node, "node", "left").select("node", F.coalesce("component", "least").alias("component")), "least")
    placed = docs_nodes.select("doc_id", "n", "node").join(own, "node", "left")
    return placed.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")), links


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """For each row of ``docs``: ``doc_id``, ``n_shingles``, ``node`` (null: no words), ``n_links`` (other rows of similarity
    0.8 or more, copies among them); and all links between distinct sets (``a`` < ``b``: nodes)."""
    rows, docs_nodes, nodes, signed, rare = prepared(docs, id_col, text_col)
    pairs = durable(close(rare, nodes).union(within(signed, nodes)).distinct(), "all-candidates")
    links = verified(pairs, sets_for(rows, ends_of(pairs)), "all-links").where("linked").select("a", "b")
    copies = durable(docs_nodes.where("node is not null").groupBy("node").agg(F.count("*").alias("copies")), "copies")
    ends = links.select("a", "b").union(links.select("b", "a")).toDF("node", "to")
    linked = ends.join(copies.toDF("to", "m"), "to").groupBy("node").agg(F.sum("m").alias("m"))
    number = durable(copies.join(linked, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("m", F.lit(0))).alias("n_links")), "numbers")
    counted = docs_nodes.select("doc_id", "n", "node").join(number, "node", "left")
    return counted.select("doc_id", F.col("n").alias("n_shingles"), "node", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), links
