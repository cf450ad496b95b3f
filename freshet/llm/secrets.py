"""Secret scans: fixed patterns, and the guess cost of values in credential contexts.

Method: a value that follows a credential word is cut into dictionary words, dates, repeats, keyboard walks, references
and brute-force spans; dynamic programming finds the segmentation that costs an attacker the fewest guesses, and values
that cost at least MIN_COST powers of ten are secrets. A word costs its rank in a dictionary: the words that attackers try
first, then the whole words of a public vocabulary in its own order (its path is a parameter; without one the first
list alone). A brute-force character costs its class (10 digits, 26 letters of a case, 33 other ASCII characters,
100 others). References (``${NAME}``, dotted names before a bracket, dotted names and names in capitals made of dictionary words) are not values. The
method adds spans of kind ``guess`` where no span of a fixed pattern holds the whole value.

Cases: a null text is an empty text without spans; spans are in code points, end exclusive; repeated rows each
give a row; extra columns are ignored; values have no limit of length (the programme is linear in it); of segmentations
with equal cost the one found first counts, which changes no span.
"""

from __future__ import annotations

import bisect
import functools
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from freshet.llm.common import bounded_broadcast, plain, rows_of, text_column

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "guess")
#: Powers of ten of guesses from which a value is a secret, and the least length of a value.
MIN_COST, MIN_VALUE = 8.0, 8

#: Fixed patterns. Greedy runs filtered by length equal runs with that least length for access and hex.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_HINT = re.compile(r"passw|secret|token|api_?key", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Where a value is a credential: a word for one, a separator, and quotes that may stand around the value.
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|credential|bearer|token|api[_-]?key|private[_-]?key|access[_-]?key|auth[_-]?key)s?["']?[\x20\t]*(?:=>|:=|[:=])[\x20\t]*["'`]?([^\s"'`<>,;]+)""", re.ASCII | re.IGNORECASE)
CONTEXT_HINT = re.compile(r"pass|pwd|secret|credential|bearer|token|[_-]?key", re.ASCII | re.IGNORECASE)

#: Words that attackers try first, most common first.
COMMON = """password admin secret welcome login user test root master dragon monkey letmein football baseball shadow sunshine princess
qwerty love hello freedom whatever trustno superman batman access default guest changeme example sample demo your token api key
my the and for this that summer winter spring autumn house horse correct battery staple orange apple banana flower tiger lion eagle
computer internet server database system service company google amazon michael jennifer jordan daniel thomas robert andrew charlie
insert here value string enter none null true false redacted placeholder xxxxx pass word""".split()
#: Words of a dictionary are of so many letters; bytes of a dictionary that are broadcast at most.
WORD_LETTERS, DICTIONARY_BOUND = (3, 24), 64_000_000
LEET = str.maketrans("@4301!$57", "aaeoiisst")
#: Rows of keys; a walk goes from a key to a neighbour in its row or in the next rows.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
PLACE = {c: (r, i) for r, keys in enumerate(ROWS) for i, c in enumerate(keys)}
DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:1[0-2]|0?[1-9])\1(?:[12]\d|3[01]|0?[1-9])|(?:[12]\d|3[01]|0?[1-9])([-/._]?)(?:1[0-2]|0?[1-9])\2(?:19|20)?\d\d|(?:19|20)\d\d)", re.ASCII)
DATE_COST, WALK_START, WALK_STEP, REPEAT_COST, SEGMENT_COST, REFERENCE_COST = 4.5, 1.7, 0.35, 0.5, 0.3, 2.0
#: Names that stand for a value: in marks, or (made of words) dotted or in capitals.
MARKED = re.compile(r"\$\{[^{}]*\}|\{\{[^{}]*\}\}|\$[A-Za-z_]\w*|%[A-Za-z_]\w*%", re.ASCII)
NAMED = re.compile(r"[A-Za-z_]+(?:\.[A-Za-z_]+)+[\[(]?|[A-Z]+(?:_[A-Z]+)+")
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
LOOK_BACK = 16


def ranked_words(path: str | None) -> list[str]:
    """The words that are tried first, then the whole words of a vocabulary file with a mark at a word's end."""
    words = list(COMMON)
    if path is not None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end = model.get("end_of_word_suffix") or ""
        whole = sorted((i, t[: len(t) - len(end)]) for t, i in model["vocab"].items() if t.endswith(end))
        words += [w for _, w in whole if w.isascii() and w.isalpha() and WORD_LETTERS[0] <= len(w) <= WORD_LETTERS[1]]
    return words


class Dictionary:
    """What a word costs, in powers of ten."""

    def __init__(self, words: list[str]):
        self.cost: dict[str, float] = {}
        for rank, word in enumerate(words):
            self.cost.setdefault(word.lower(), math.log10(rank + 2))
        self.longest = max(map(len, self.cost), default=0)


@functools.lru_cache(maxsize=2)
def dictionary(words: tuple[str, ...]) -> Dictionary:
    return Dictionary(list(words))


def brute_cost(c: str) -> float:
    """One character by the size of its class."""
    return math.log10(10 if "0" <= c <= "9" else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100)


def neighbours(a: str, b: str) -> bool:
    x, y = PLACE.get(a), PLACE.get(b)
    return x is not None and y is not None and a != b and abs(x[0] - y[0]) <= 1 and abs(x[1] - y[1]) <= 1


def segments(value: str, known: Dictionary) -> list[list[tuple[int, float, str]]]:
    """For each end the segments (start, cost, kind) that may end there, but the brute-force ones."""
    n, lower = len(value), value.lower() if value.isascii() else "".join(c.lower() if c.isascii() else c for c in value)
    plainer = lower.translate(LEET)
    out: list[list[tuple[int, float, str]]] = [[] for _ in range(n + 1)]
    for i in range(n):
        if m := DATE.match(value, i):
            out[m.end()].append((i, DATE_COST, "date"))
        if value[i] in "${%" and (m := MARKED.match(value, i)):
            out[m.end()].append((i, REFERENCE_COST, "reference"))
        if plainer[i].isalpha():
            for j in range(i + 2, min(n, i + known.longest) + 1):
                if (cost := known.cost.get(lower[i:j])) is not None:
                    out[j].append((i, cost + 0.3 * (value[i:j] != lower[i:j]), "word"))
                elif (cost := known.cost.get(plainer[i:j])) is not None:
                    out[j].append((i, cost + 0.6, "word"))
    for m in NAMED.finditer(value):
        if m[0][-1] in "[(" or all(len(w) < 3 or w.lower() in known.cost for w in NAME_WORDS.findall(m[0])):
            out[m.end()].append((m.start(), REFERENCE_COST, "reference"))
    walk = same = 0  # starts of the walk and of the run of one character that go on at this place
    for i in range(n):
        if i and not neighbours(lower[i - 1], lower[i]):
            walk = i
        if i and value[i] != value[i - 1]:
            same = i
        for start in {walk, *range(max(walk, i - LOOK_BACK), i - 2)}:
            if i + 1 - start >= 4:
                out[i + 1].append((start, WALK_START + WALK_STEP * (i + 1 - start), "walk"))
        for start in {same, *range(max(same, i - LOOK_BACK), i - 1)}:
            if i + 1 - start >= 3:
                out[i + 1].append((start, brute_cost(value[i]) + REPEAT_COST + math.log10(i + 1 - start), "repeat"))
        for size in range(2, 9):  # the block that ends here, if it repeats the block before it
            if i + 1 >= 2 * size and value[i + 1 - size : i + 1] == value[i + 1 - 2 * size : i + 1 - size]:
                out[i + 1].append((i + 1 - size, REPEAT_COST, "repeat"))
    return out


def segmentation(value: str, known: Dictionary | None = None) -> tuple[float, list[tuple[int, int, str]]]:
    """The least cost of guessing ``value``, in powers of ten, and its segments (start, end, kind). A segment costs
    SEGMENT_COST besides; a brute-force span, of characters that follow each other, is one segment."""
    n, ending = len(value), segments(value, known or dictionary(tuple(COMMON)))
    # by last segment: not brute force, brute force; what each place was reached from: (place, which, kind)
    best: list[list[float]] = [[0.0, math.inf]] + [[math.inf, math.inf] for _ in range(n)]
    came: list[list[tuple[int, int, str]]] = [[(0, 0, ""), (0, 0, "")] for _ in range(n + 1)]
    for j in range(1, n + 1):
        plain_, brute = best[j - 1]
        cost = brute_cost(value[j - 1])
        if brute <= plain_ + SEGMENT_COST:
            best[j][1], came[j][1] = brute + cost, (j - 1, 1, "brute")
        else:
            best[j][1], came[j][1] = plain_ + SEGMENT_COST + cost, (j - 1, 0, "brute")
        for i, cost, kind in ending[j]:
            which = 0 if best[i][0] <= best[i][1] else 1
            if (total := best[i][which] + cost + SEGMENT_COST) < best[j][0]:
                best[j][0], came[j][0] = total, (i, which, kind)
    parts: list[tuple[int, int, str]] = []
    j, which = n, 0 if best[n][0] <= best[n][1] else 1
    least = best[n][which]
    while j:
        i, before, kind = came[j][which]
        if kind == "brute" and parts and parts[-1][2] == "brute" and parts[-1][0] == j:
            parts[-1] = (i, parts[-1][1], kind)
        else:
            parts.append((i, j, kind))
        j, which = i, before
    return least, parts[::-1]


def scan(text: str, known: Dictionary | None = None) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind as listed."""
    spans = []
    if ASSIGN_HINT.search(text):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text)]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    if CONTEXT_HINT.search(text):
        starts, reach = [], [0]  # of the fixed patterns' spans: starts in order, and how far those up to each one reach
        for s, e in sorted((s, e) for _, s, e in spans):
            starts.append(s)
            reach.append(max(reach[-1], e))
        for m in CONTEXT.finditer(text):
            start, end = m.span(1)
            if end - start >= MIN_VALUE and reach[bisect.bisect_right(starts, start)] < end and segmentation(m[1], known)[0] >= MIN_COST:
                spans.append(("guess", start, end))
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def secret_spans(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: ``doc_id``, ``spans`` (array of kind, start, end). ``vocabulary``: a file of the driver,
    whose words are broadcast, up to DICTIONARY_BOUND bytes."""
    rows, words = plain(docs, doc_id=id_col, text=text_col), tuple(ranked_words(vocabulary))
    shared = bounded_broadcast(docs.sparkSession, words, sum(map(len, words)), DICTIONARY_BOUND, "the dictionary")
    kind = rows.schema["doc_id"].dataType.simpleString()
    of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dictionary(shared.value)
        for batch in rows_of(batches, 8_000_000, "text"):
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(x, known)] for x in text_column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, of)], ["doc_id", "spans"])

    return rows.mapInArrow(find, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")
