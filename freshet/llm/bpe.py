"""BPE encoding and decoding with a public word-end vocabulary.

Method: a contiguous rank array. A word is held as a row of parts with the rank of each adjacent pair
beside it; the least rank is found by a scan, the boundary between its two parts is deleted, and the
ranks on both sides are refreshed, until no pair can be merged.

Characters that Python's Unicode tables do not know yet are normalised and classed by the library's; all merging is done here.

Cases: of pairs with equal rank, which are the same pair, the leftmost is merged first; a null text is an empty text; an empty text has no tokens and decodes to an empty text; a very
long chunk without white space is merged through a heap with the same result; repeated rows each give
a row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from freshet.llm.common import bounded_broadcast, plain, rows_of, text_column

#: Bytes of a vocabulary file that are broadcast at most.
VOCABULARY_BOUND = 64_000_000
#: Chunks and words that are remembered, the longest that are, and the longest word that is scanned.
CHUNKS, REMEMBERED, REMEMBERED_CHARS, SCANNED = 80_000, 200_000, 32, 400
NO_RANK, ID_BITS, ID_MASK = 1 << 60, 24, (1 << 24) - 1

#: How the vocabulary splits text into words.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
SPACES = regex.compile(r"\p{White_Space}+")
SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next letter from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, hidden = [""] * 256, 0
    for b in range(256):
        if b in shown:
            letters[b] = chr(b)
        else:
            letters[b] = chr(0x100 + hidden)
            hidden += 1
    return letters


class WordBPE:
    """An encoder and decoder for a vocabulary file of the word-end kind."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        letters = byte_letters()
        self.inner = [vocab[x] for x in letters]
        self.last = [vocab[x + self.end] for x in letters]
        # (left, right) as one number, to the rank of their merge and its id as one number: the least has the least rank
        self.merged: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merged.setdefault(vocab[left] << ID_BITS | vocab[right], rank << ID_BITS | vocab[left + right])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.text_of = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.text_of[i] = token
        # tuples of integers are not followed by the garbage collector
        self.known: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        parts = [self.inner[b] for b in word]
        parts[-1] = self.last[word[-1]]
        if len(parts) > SCANNED:
            return self.merge_long(parts)
        find = self.merged.get
        ranks = [find(left << ID_BITS | right, NO_RANK) for left, right in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != NO_RANK:
            at = ranks.index(least)
            parts[at] = new = least & ID_MASK
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = find(parts[at - 1] << ID_BITS | new, NO_RANK)
            if at < len(ranks):
                ranks[at] = find(new << ID_BITS | parts[at + 1], NO_RANK)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same for a long word: the pairs wait in a heap, and boundaries are links."""
        find, n = self.merged.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found, i, parts[i], parts[i + 1]) for i in range(n - 1) if (found := find(parts[i] << ID_BITS | parts[i + 1]))]
        heapq.heapify(heap)
        while heap:
            merged, i, left, right = heapq.heappop(heap)
            j = after[i] if parts[i] == left else n
            if j >= n or parts[j] != right:
                continue
            parts[i], parts[j] = merged & ID_MASK, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (found := find(parts[a] << ID_BITS | parts[b])):
                    heapq.heappush(heap, (found, a, parts[a], parts[b]))
        return [x for x in parts if x >= 0]

    def word(self, word: str) -> tuple[int, ...]:
        if (ids := self.words.get(word)) is None:
            ids = tuple(self.merge(word.encode("utf-8")))
            if len(word) <= REMEMBERED_CHARS:
                if len(self.words) >= REMEMBERED:
                    self.words.clear()
                self.words[word] = ids
        return ids

    def chunk(self, chunk: str) -> tuple[int, ...]:
        """The ids of a text without white space and special tokens."""
        if chunk.isascii():
            lowered = chunk.lower()
            words = (lowered,) if lowered.isalpha() else ASCII_WORDS.findall(lowered)
        else:
            words = self.other_words(chunk)
        ids = self.word(words[0]) if len(words) == 1 else tuple(i for word in words for i in self.word(word))
        if len(chunk) <= REMEMBERED_CHARS:
            if len(self.known) >= CHUNKS:
                self.known.clear()
            self.known[chunk] = ids
        return ids

    @functools.cached_property
    def library_rules(self):
        """The library's normal form and split into words."""
        import tokenizers

        normal = tokenizers.normalizers.Sequence([tokenizers.normalizers.NFC(), tokenizers.normalizers.Lowercase()])
        return normal, tokenizers.pre_tokenizers.Split(tokenizers.Regex(self.pattern), "removed", invert=True)

    def other_words(self, chunk: str) -> tuple[str, ...] | list[str]:
        """The words of a chunk that is not ASCII."""
        if any(unicodedata.category(c) == "Cn" for c in chunk):
            # not in Python's Unicode tables: normal form, case and class are those of the library's own tables
            normal, split = self.library_rules
            return [w for w, _ in split.pre_tokenize_str(normal.normalize_str(chunk))]
        lowered = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        return (lowered,) if lowered.isalpha() else WORDS.findall(lowered)

    def ordinary(self, text: str) -> list[int]:
        chunks = SPACES.split(text) if SEPARATORS.search(text) else text.split()
        known, out = self.known.get, []
        for x in chunks:
            ids = known(x)
            out.extend(self.chunk(x) if ids is None else ids)
        return out

    def encode(self, text: str) -> list[int]:
        if self.specials is None or "<" not in text:
            return self.ordinary(text)
        ids: list[int] = []
        for piece in self.specials.split(text):
            if piece in self.special:
                ids.append(self.special[piece])
            else:
                ids.extend(self.ordinary(piece))
        return ids

    def decode(self, ids: list[int]) -> str:
        """The tokens' texts with a space between, as a vocabulary file without a decoder says."""
        return " ".join(map(self.text_of.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def encoder(spec: bytes) -> WordBPE:
    return WordBPE(json.loads(spec))


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode it again: a row per row of ``docs`` with ``doc_id``, ``n_tokens``,
    ``ids`` (little-endian unsigned 32-bit integers) and ``decoded``. ``vocabulary`` is a file of the
    driver; its bytes are broadcast, up to VOCABULARY_BOUND."""
    spark, spec = docs.sparkSession, read_vocabulary(vocabulary)
    shared = bounded_broadcast(spark, spec, len(spec), VOCABULARY_BOUND, "the vocabulary")
    rows = plain(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(shared.value)
        for batch in rows_of(batches, 4_000_000, "text"):
            counts, packed, decoded = [], [], []
            for text in text_column(batch, "text"):
                ids = bpe.encode(text)
                counts.append(len(ids))
                packed.append(np.asarray(ids, "<u4").tobytes())
                decoded.append(bpe.decode(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(packed, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return rows.mapInArrow(encode, f"doc_id {kind}, n_tokens long, ids binary, decoded string")


def bpe_decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Decode the ``ids`` of ``bpe_encode``'s form: ``doc_id``, ``decoded``; null ids decode to an empty text."""
    spark, spec = encoded.sparkSession, read_vocabulary(vocabulary)
    shared = bounded_broadcast(spark, spec, len(spec), VOCABULARY_BOUND, "the vocabulary")
    rows = plain(encoded, doc_id="doc_id", ids="ids")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(shared.value)
        for batch in batches:
            texts = [bpe.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return rows.mapInArrow(decode, f"doc_id {kind}, decoded string")
