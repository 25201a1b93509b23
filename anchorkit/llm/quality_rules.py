"""Quality rules whose cutoffs hold a stated rate of false rejections, stratum by stratum.

Signals are ratios of counts taken over the whole text. A rule rejects a document whose signal is
above the cutoff of the document's stratum. Cutoffs come from a labelled holdout: for a cutoff that
rejects k of n good documents, the exact binomial test of "false rejection rate >= allowed" has the
p-value P(Bin(n, allowed) <= k). Candidates of one signal are tested from the mildest to the
strictest and the first failure stops (k grows along the way, so the sequence needs no further
correction); over strata and signals the level is divided by their number (Bonferroni), and the
allowed rate of a document is divided by the number of signals. With probability ``1 - level`` all
strata reject at most ``allowed`` of their good documents.

Everything is DataFrame expressions: one narrow pass over texts, one aggregate over the holdout.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorkit.llm.rows import bound, fresh, named, words_of
from anchorkit.operators.joins import balanced_join
from anchorkit.session import staged

SYMBOLS, WORD = "[#*$%&|<>]", r"[^\x20\x09-\x0D]"
#: Tested cutoffs per signal, chosen before any data is seen; the mildest is tested first.
CANDIDATES = {
    "symbol_ratio": tuple(x / 200 for x in range(100, 1, -2)),
    "dup_line_ratio": tuple(x / 100 for x in range(90, 4, -3)),
    "repeat_ratio": tuple(x / 100 for x in range(48, 1, -2)),
    "word_length": tuple(x / 4 for x in range(80, 24, -2)),
}
ALLOWED = 0.05
LEVEL = 0.05
MIN_WORDS = 50


def _windows(words: Column) -> Column:
    """64-bit hashes of the 3-word windows, by place."""
    n = F.greatest(F.size(words) - 2, F.lit(0))

    def join(h: Column) -> Column:
        pairs = F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(2), n), lambda a, b: F.xxhash64(a, b))
        return F.zip_with(pairs, F.slice(h, F.lit(3), n), lambda a, b: F.xxhash64(a, b))

    return bound(F.transform(words, lambda x: F.xxhash64(x)), join)


def _covered_words(windows: Column) -> Column:
    """Words inside windows (array of hashes by place) that occur twice or more, each word once.

    Pairs of hash and place are sorted, which brings equal windows together. Starts of repeated
    windows, in order, cover three words each, less what the start before already covers.
    """
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("hash"), i.cast("long").alias("place"))))

    def starts(p: Column) -> Column:
        n = F.size(p) - 1
        here, after = F.slice(p, F.lit(1), n), F.slice(p, F.lit(2), n)
        near = lambda a, b: a["hash"] == b["hash"]
        one = F.zip_with(here, after, lambda a, b: F.when(near(a, b), a["place"]))
        two = F.zip_with(here, after, lambda a, b: F.when(near(a, b), b["place"]))
        return F.sort_array(F.array_distinct(F.array_compact(F.concat(one, two))))

    def total(s: Column) -> Column:
        gaps = F.zip_with(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))),
                          F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: F.least(F.lit(3), b - a))
        # the last start covers three words; windows that aren't all unlike have one
        return F.aggregate(gaps, F.lit(3).cast("long"), lambda n, g: n + g)

    return bound(bound(placed, starts), total)


def text_counts(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``df`` plus the counts of ``text``: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long).

    Null and empty texts count zero everywhere. Existing columns of these names are replaced; give a
    ``prefix`` to keep them. Windows are compared by a 64-bit hash of their three words.
    """
    body = F.coalesce(named(df, text), F.lit(""))
    words, windows, lines = (fresh(df, x) for x in ("words_held", "windows_held", "lines_held"))
    # arrays that several expressions use are columns of their own, so that each is made once
    df = df.withColumns({words: words_of(body), lines: F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))})
    df = df.withColumn(windows, _windows(F.col(words)))
    none = F.lit(0).cast("long")
    unlike = F.size(F.array_distinct(windows)) == F.size(windows)
    return df.withColumns({
        f"{prefix}n_words": F.size(words).cast("long"),
        f"{prefix}word_chars": F.aggregate(F.col(words), none, lambda n, x: n + F.length(x)),
        f"{prefix}n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
        f"{prefix}n_lines": F.size(lines).cast("long"),
        f"{prefix}n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        f"{prefix}n_repeat_words": F.when(unlike, none).otherwise(_covered_words(F.col(windows))),
    }).drop(words, windows, lines)


def signals(prefix: str = "") -> dict[str, Column]:
    """Signals from the counts; a document without the base of a ratio has the signal zero."""
    part = lambda a, b: F.coalesce(F.try_divide(F.col(prefix + a), F.col(prefix + b)), F.lit(0.0))
    return {"symbol_ratio": part("n_symbols", "word_chars"), "dup_line_ratio": part("n_dup_lines", "n_lines"),
            "repeat_ratio": part("n_repeat_words", "n_words"), "word_length": part("word_chars", "n_words")}


def _log_factorial(x: Column) -> Column:
    """ln(x!) by Stirling's series at x + 9, brought down by the factors between."""
    y = x + 9.0
    series = ((y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
              - 1 / (1680 * y**7))
    for step in range(1, 9):
        series = series - F.log(x + float(step))
    return series


def binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """P(Bin(n, rate) <= k), summed from k downward; one when k is at or above the mean n * rate.

    Below the mean the terms fall at least geometrically; those under 1e-17 of the sum, which a
    double can't hold, lie more than 12 standard deviations + 60 terms away and are left out.
    """
    n, k = n.cast("double"), k.cast("double")
    peak = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(rate)
                 + (n - k) * math.log1p(-rate))
    far = F.least(k, F.ceil(12 * F.sqrt(n * rate)) + 60).cast("int")
    first = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    odds = (1 - rate) / rate

    def step(a: Column, j: Column) -> Column:
        at = k - j.cast("double")
        term = a["term"] * (at + 1) / (n - at) * odds
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    steps = F.when(far >= 1, F.sequence(F.lit(1), F.greatest(far, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.when(k >= n * rate, F.lit(1.0)).otherwise(peak * F.aggregate(steps, first, step, lambda a: a["sum"]))


def risk_cutoffs(good: DataFrame, stratum: str, allowed: float = ALLOWED, level: float = LEVEL,
                 candidates: dict[str, Sequence[float]] | None = None) -> DataFrame:
    """One row per stratum of ``good`` (labelled good documents with a column per signal).

    Columns: ``stratum``, ``n_good`` and a double per signal, the strictest cutoff whose test and all
    milder ones passed; null when none passed (a stratum with too few labels has no rule). A null
    stratum is a stratum. The number of strata is counted in ``good``.
    """
    candidates = candidates or CANDIDATES
    counts = good.groupBy(F.col(stratum)).agg(F.count(F.lit(1)).alias("n_good"), *[
        F.array(*[F.sum((F.col(s) > F.lit(c)).cast("long")) for c in cuts]).alias(f"k_{s}")
        for s, cuts in candidates.items()])
    counts = staged(counts, "quality-counts")
    tests = max(1, counts.count() * len(candidates))
    rate = allowed / len(candidates)
    columns = []
    for s, cuts in candidates.items():
        ordered = F.arrays_zip(F.col(f"k_{s}").alias("k"), F.array(*[F.lit(float(c)) for c in cuts]).alias("cut"))
        failed = F.filter(ordered, lambda z: binomial_tail(F.col("n_good"), z["k"], rate) > level / tests)
        mildest_failed = F.coalesce(F.array_max(F.transform(failed, lambda z: z["cut"])), F.lit(float("-inf")))
        passed = F.filter(ordered, lambda z: z["cut"] > mildest_failed)
        columns.append(F.array_min(F.transform(passed, lambda z: z["cut"])).alias(s))
    return counts.select(stratum, "n_good", *columns)


def learn_cutoffs(counted: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", label: str = "quality",
                  prefix: str = "", **options) -> DataFrame:
    """Cutoffs (written below the shared folder) from the documents that ``labels`` calls good (label 1).

    ``counted`` has the columns of :func:`text_counts`. A document with several labels counts as good
    if all of them are 1; null labels and null keys are no labels.
    """
    own = labels.select(named(labels, key).alias("k"), named(labels, label).alias("q")).where("k is not null and q is not null")
    own = own.groupBy("k").agg(F.min("q").alias("q"), F.max("q").alias("top")).where("q = 1 and top = 1").select("k")
    seen = counted.select(named(counted, key).alias("k"), named(counted, stratum).alias("stratum"),
                          *[c.alias(s) for s, c in signals(prefix).items()])
    return staged(risk_cutoffs(seen.join(own, "k", "left_semi").drop("k"), "stratum", **options), "quality-cutoffs")


def apply_cutoffs(counted: DataFrame, cutoffs: DataFrame, stratum: str = "lang", prefix: str = "",
                  min_words: int = MIN_WORDS) -> DataFrame:
    """``counted`` (with the columns of :func:`text_counts`) plus ``base_failed`` and ``kept`` (boolean, names with ``prefix``).

    base_failed: under ``min_words`` words, or more than half of the words in repeated windows.
    kept: not base_failed and no signal above the cutoff of the row's stratum; a stratum without
    cutoffs keeps all that pass the base rule. Every row stays, repeated rows too.
    """
    at = fresh(counted, "cut_stratum")
    names = {s: fresh(counted, f"cut_{s}") for s in signals()}
    tag = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))
    right = cutoffs.select(tag(F.col("stratum")).alias(at), *[F.col(s).alias(n) for s, n in names.items()])
    out = balanced_join(counted.withColumn(at, tag(named(counted, stratum))), right, [at], "left")
    words, repeats = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    out = out.withColumn(f"{prefix}base_failed", (words < min_words) | (100 * repeats > 50 * words))
    over = F.lit(False)
    for s, value in signals(prefix).items():
        over = over | F.coalesce(value > F.col(names[s]), F.lit(False))
    return out.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & ~over).drop(at, *names.values())
