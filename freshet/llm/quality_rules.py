"""Quality rules: fixed rules, and robust multivariate outliers, with DataFrame functions only.

Method: each text has a vector of transformed statistics (log mean word length, log symbols a word, share of
repeated lines, share of words in repeated 3-word windows). For each language and source the minimum
covariance determinant is estimated. It has three fixed starts (medians with absolute deviations, means with covariances,
medians with the covariance of spatial signs). Concentration steps take the rows with the least Mahalanobis
distance, three quarters or a little more, and estimate mean and covariance anew, corrected for the share that was
taken; after FIRST_STEPS each group keeps the start with the least determinant, and goes on until its determinant falls no
more (STEPS at most). Rows whose distance under the estimate exceeds a chi-square quantile are rejected.

Each step is one pre-aggregated shuffle of (group, distance bin) sums, so a hot group is never gathered; the
three quarters are taken by whole bins of distance, so rows of equal distance stay together. A group with fewer than MIN_GROUP usable rows takes its
language's estimate, then that of all rows; where even these are fewer, no row is rejected by the method. The
variance of each statistic has a floor (its resolution), since most texts have no symbol or repeat.

Cases: a null text is an empty text (no words, so it fails the fixed rules); a null language or source is ""; texts
of any length are judged whole; repeated rows count as rows; extra columns are kept and may have any names.
3-word windows are compared by 64-bit hashes within a text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from freshet.llm.common import SPACE_CLASS, durable, small

SYMBOLS = r"[#*$%&|<>]"
DIMENSIONS = 4
#: Least standard deviation of each statistic: its resolution. A share of repeated lines or words of 0.25 above the
#: group's centre is beyond the cutoff by itself.
FLOORS = (0.08, 0.05, 0.05, 0.05)
#: Rows from which a group has its own estimate; share of the rows that are concentrated on; chi-square quantile.
MIN_GROUP, SUBSET, QUANTILE = 40, 0.75, 0.9999
#: Concentration steps of every start, and of the best one at most; the fall of ln(determinant) from which steps go on.
FIRST_STEPS, STEPS, FALL = 2, 10, 1e-3
#: Bins of ln(distance^2) to one unit; groups whose estimates are broadcast at most (about 200 bytes each); files of their table.
BINS, BROADCAST_GROUPS, FILES = 8, 50_000, 4


def chi_square(x: float, half: int) -> float:
    """The distribution function of chi-square with 2 * half degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(half))


def chi_square_quantile(p: float, half: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, half) < p else (low, middle)
    return high


CUTOFF = chi_square_quantile(QUANTILE, DIMENSIONS // 2)
#: What makes the covariance of the inner rows that of all, for normal rows, by their share: from SUBSET to 1 in steps of 1/SHARES.
SHARES = 200


def consistency(share: float) -> float:
    return 1.0 if share >= 1 else share / chi_square(chi_square_quantile(share, DIMENSIONS // 2), DIMENSIONS // 2 + 1)


CONSISTENCY = [consistency(k / SHARES) for k in range(int(SUBSET * SHARES), SHARES + 1)]


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_CLASS), "")


def repeated_words(words: Column, hashes: Column) -> Column:
    """Words in 3-word windows found twice or more: the windows' hashes are sorted with their places, equal
    neighbours give the places, and the union of the 3-word intervals at these is measured."""
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def union(sorted_windows: Column) -> Column:
        twice = F.filter(sorted_windows, lambda x, k: (x["h"] == F.get(sorted_windows, k - 1)["h"]) | (x["h"] == F.get(sorted_windows, k + 1)["h"]))
        places = F.array_sort(F.transform(twice, lambda x: x["i"]))
        return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last")), lambda s: s["n"])

    # transform over a one-element array binds the sorted windows to a variable, so that they are made once
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.get(F.transform(F.array(placed), union), F.lit(0))).otherwise(F.lit(0))


def with_statistics(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``row`` (the input's columns), ``lang``, ``source``, the counts, ``base_failed`` and ``x0`` to ``x3``."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), name(lang_col).alias("lang"), name(source_col).alias("source"), text.alias("t"), words_of(text).alias("words"))
    window = lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    some = F.size("words") > 2
    hashed = whole.withColumn("hashes", F.when(some, F.transform(F.sequence(F.lit(0), F.when(some, F.size("words") - 3).otherwise(0)), window)).otherwise(F.array().cast("array<bigint>")))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = hashed.select(
        "row", "lang", "source", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), lines.alias("lines"), repeated_words(F.col("words"), F.col("hashes")).cast("long").alias("n_repeat_words"),
    )
    counted = counted.select("row", "lang", "source", "n_words", "word_chars", "n_symbols", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words")
    n, d = F.greatest("n_words", F.lit(1)).cast("double"), lambda c: F.col(c).cast("double")
    vector = (F.log(1 + d("word_chars") / n), F.log(1 + d("n_symbols") / n), d("n_dup_lines") / F.greatest("n_lines", F.lit(1)), d("n_repeat_words") / n)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    named = {"base_failed": failed} | {f"x{j}": F.round(v, 6) for j, v in enumerate(vector)}
    # the one-element generator is a barrier: what refers to these columns does not compute them anew
    made = [F.col(c) for c in COUNTS] + [v.alias(k) for k, v in named.items()]
    return counted.select("row", "lang", "source", F.inline(F.array(F.struct(*made))))


PAIRS = [(i, j) for i in range(DIMENSIONS) for j in range(i + 1)]


def _factor(groups: DataFrame, covariance: dict[tuple[int, int], Column]) -> DataFrame:
    """Adds the Cholesky factor ``l_ij`` of the covariance with floors, an entry at a time, and ``size``, ln(determinant)."""
    for i in range(DIMENSIONS):
        for j in range(i + 1):
            rest = covariance[i, j] + (F.lit(FLOORS[i] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            groups = groups.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2 / 4))) if i == j else rest / F.col(f"l{j}{j}"))
    return groups.withColumn("size", 2 * sum((F.log(f"l{i}{i}") for i in range(1, DIMENSIONS)), F.log("l00")))


MODEL = [f"m{i}" for i in range(DIMENSIONS)] + [f"l{i}{j}" for i in range(DIMENSIONS) for j in range(i + 1)]


def _with_distance(rows: DataFrame) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance, by forward substitution."""
    for i in range(DIMENSIONS):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"z{k}")
        rows = rows.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", sum((F.col(f"z{i}") ** 2 for i in range(1, DIMENSIONS)), F.col("z0") ** 2))


KEY = ["level", "g_lang", "g_source"]


def starts(rows: DataFrame) -> DataFrame:
    """The three starts of each group that has rows enough: KEY, ``start``, ``n``, the columns MODEL, ``size``."""
    x = [f"x{i}" for i in range(DIMENSIONS)]
    middle = durable(rows.groupBy(KEY).agg(F.count("*").alias("n"), *[F.percentile(F.round(c, 3), F.lit(0.5)).alias(f"m{i}") for i, c in enumerate(x)]).where(F.col("n") >= MIN_GROUP), "mcd-medians", FILES)
    spread = rows.join(small(middle, BROADCAST_GROUPS), KEY).groupBy(KEY).agg(*[F.percentile(F.round(F.abs(F.col(c) - F.col(f"m{i}")), 3), F.lit(0.5)).alias(f"s{i}") for i, c in enumerate(x)])
    centre = middle.join(spread, KEY).select(*KEY, "n", *[f"m{i}" for i in range(DIMENSIONS)], *[F.greatest(1.4826 * F.col(f"s{i}"), F.lit(FLOORS[i])).alias(f"s{i}") for i in range(DIMENSIONS)], *[F.col(f"s{i}").alias(f"d{i}") for i in range(DIMENSIONS)])
    centre = durable(centre, "mcd-centres", FILES)
    off = rows.join(small(centre, BROADCAST_GROUPS), KEY).select(*KEY, *[(F.col(x[i]) - F.col(f"m{i}")).alias(f"o{i}") for i in range(DIMENSIONS)], *[((F.col(x[i]) - F.col(f"m{i}")) / F.col(f"s{i}")).alias(f"z{i}") for i in range(DIMENSIONS)])
    off = off.withColumn("length", sum((F.col(f"z{i}") ** 2 for i in range(1, DIMENSIONS)), F.col("z0") ** 2))
    sums = off.groupBy(KEY).agg(*[F.avg(f"o{i}").alias(f"a{i}") for i in range(DIMENSIONS)], *[F.avg(F.col(f"o{i}") * F.col(f"o{j}")).alias(f"b{i}{j}") for i, j in PAIRS], *[F.avg(F.col(f"z{i}") * F.col(f"z{j}") / F.greatest("length", F.lit(1e-9))).alias(f"g{i}{j}") for i, j in PAIRS])
    known = durable(centre.join(sums, KEY), "mcd-sums", FILES)
    ways = [
        ([F.col(f"m{i}") for i in range(DIMENSIONS)], {(i, j): (F.col(f"d{i}") * 1.4826) ** 2 if i == j else F.lit(0.0) for i, j in PAIRS}),
        ([F.col(f"m{i}") + F.col(f"a{i}") for i in range(DIMENSIONS)], {(i, j): F.col(f"b{i}{j}") - F.col(f"a{i}") * F.col(f"a{j}") for i, j in PAIRS}),
        ([F.col(f"m{i}") for i in range(DIMENSIONS)], {(i, j): DIMENSIONS * F.col(f"s{i}") * F.col(f"s{j}") * F.col(f"g{i}{j}") for i, j in PAIRS}),
    ]
    each = [known.select(*KEY, F.lit(k).alias("start"), "n", *[m.alias(f"m{i}") for i, m in enumerate(means)], *[c.alias(f"c{i}{j}") for (i, j), c in cov.items()]) for k, (means, cov) in enumerate(ways)]
    return durable(_factor(each[0].union(each[1]).union(each[2]), {(i, j): F.col(f"c{i}{j}") for i, j in PAIRS}).select(*KEY, "start", "n", *MODEL, "size"), "mcd-starts", FILES)


def concentrated(rows: DataFrame, model: DataFrame) -> DataFrame:
    """One step: each start's estimate from the rows that are nearest under ``model``."""
    by = [*KEY, "start"]
    near = _with_distance(rows.join(small(model, BROADCAST_GROUPS), KEY)).withColumn("bin", F.floor(BINS * F.log(F.col("d2") + 1e-6)))
    off = [(F.col(f"x{i}") - F.col(f"m{i}")) for i in range(DIMENSIONS)]
    sums = near.groupBy(*by, "bin").agg(F.count("*").alias("c"), *[F.sum(o).alias(f"a{i}") for i, o in enumerate(off)], *[F.sum(off[i] * off[j]).alias(f"b{i}{j}") for i, j in PAIRS])
    before = Window.partitionBy(by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    inner = sums.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))).join(model.select(*by, "n"), by).where(F.col("before") < F.col("n") * SUBSET)
    total = inner.groupBy(by).agg(F.sum("c").alias("c"), *[F.sum(f"a{i}").alias(f"a{i}") for i in range(DIMENSIONS)], *[F.sum(f"b{i}{j}").alias(f"b{i}{j}") for i, j in PAIRS])
    moved = model.select(*by, "n", *[F.col(f"m{i}").alias(f"o{i}") for i in range(DIMENSIONS)]).join(total, by)
    moved = moved.withColumns({f"m{i}": F.col(f"o{i}") + F.col(f"a{i}") / F.col("c") for i in range(DIMENSIONS)})
    share = F.floor(F.col("c") / F.col("n") * SHARES).cast("int") - int(SUBSET * SHARES)
    scale = F.get(F.array(*[F.lit(c) for c in CONSISTENCY]), F.greatest(share, F.lit(0)))
    covariance = {(i, j): scale * (F.col(f"b{i}{j}") / F.col("c") - F.col(f"a{i}") / F.col("c") * F.col(f"a{j}") / F.col("c")) for i, j in PAIRS}
    return _factor(moved, covariance).select(*by, "n", *MODEL, "size")


def estimates(rows: DataFrame) -> DataFrame:
    """Each group's estimate of the least determinant: KEY, ``start``, the columns MODEL, ``size``."""
    by = [*KEY, "start"]
    model = starts(rows)
    for _ in range(FIRST_STEPS):
        model = durable(concentrated(rows, model), "mcd-step", FILES)
    chosen = model.groupBy(KEY).agg(F.min(F.struct("size", "start")).alias("best")).select(*KEY, "best.start")
    done = model = durable(model.join(chosen, by), "mcd-chosen", FILES)
    for _ in range(STEPS - FIRST_STEPS):  # ``done``: the best of each group so far; ``model``: those that still fall
        if model.isEmpty():
            break
        after = durable(concentrated(rows, model), "mcd-step", FILES)
        fallen = after.join(model.select(*by, F.col("size").alias("was")), by).where(F.col("size") < F.col("was") - FALL).drop("was")
        fallen = durable(fallen, "mcd-fallen", FILES)
        done = durable(done.join(fallen.select(by), by, "left_anti").unionByName(fallen), "mcd-done", FILES)
        model = fallen
    return done


def fit_groups(stats: DataFrame) -> DataFrame:
    """The estimate of each language and source: ``lang``, ``source``, and the columns MODEL (null: none)."""
    x = [f"x{i}" for i in range(DIMENSIONS)]
    levels = F.array(*[F.struct(F.lit(i).alias("level"), a.alias("g_lang"), b.alias("g_source")) for i, (a, b) in enumerate([(F.col("lang"), F.col("source")), (F.col("lang"), F.lit("")), (F.lit(""), F.lit(""))])])
    model = estimates(stats.where(~F.col("base_failed")).select(F.explode(levels).alias("key"), *x).select("key.*", *x))

    groups = stats.select("lang", "source").distinct()
    for k, by in enumerate((["lang", "source"], ["lang"], [])):
        own = model.where(F.col("level") == k).select(F.struct(*MODEL).alias(f"model{k}"), *[F.col(f"g_{c}").alias(c) for c in by])
        groups = groups.join(own, by, "left") if by else groups.join(F.broadcast(own), F.lit(True), "left")  # one row at most
    chosen = F.coalesce("model0", "model1", "model2")
    return durable(groups.select("lang", "source", chosen.alias("model")).select("lang", "source", "model.*"), "mcd-groups", FILES)


def judged(stats: DataFrame, groups: DataFrame) -> DataFrame:
    """``stats`` with ``d2`` and ``kept``. The groups' table is broadcast where Spark finds it small enough."""
    rows = _with_distance(stats.join(small(groups, BROADCAST_GROUPS), ["lang", "source"], "left"))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("d2").isNull() | (F.col("d2") <= CUTOFF)))


def quality_filter(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that the rules and the method keep. Texts are not shuffled: statistics are taken
    once for the estimate and once for the verdict."""
    stats = with_statistics(docs, **how)
    groups = fit_groups(durable(stats.drop("row"), "quality-statistics"))
    # the generator keeps the optimizer from computing the statistics anew inside the filter
    verdict = judged(stats, groups).select("row", F.explode(F.array("kept")).alias("kept"))
    return verdict.where("kept").select("row.*")
