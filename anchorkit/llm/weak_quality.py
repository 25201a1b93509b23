"""Quality classifier taught by weak labels.

Heuristic labellers look at a text and vote good, bad or nothing; so does the table of annotators'
labels where it knows the document. Expectation maximisation over the counts of vote patterns (at most
3^labellers of them, counted over all documents) estimates how often each labeller is right in either
class, and gives every pattern the probability that its document is good. These posterior labels teach
a linear scorer over hashed words, word beginnings and the labellers' signals; the scorer alone decides.

Two questions are asked in the same way, whether a text is well formed and whether it is abusive; a
document is kept if the first is answered yes and the second no.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anchorkit.llm.rows import named
from anchorkit.llm.slices import alone, slices, tidy
from anchorkit.llm.word_arrays import indices, word_arrays

#: English words of abuse that the abuse labellers know.
ABUSE = frozenset("idiot idiots moron morons stupid dumb loser losers clown clowns trash scum pathetic worthless disgusting garbage "
                  "imbecile bastard bitch whore slut retard retarded asshole fuck fucking shit vermin parasite subhuman".split())
SYMBOLS = b"#*$%&|<>~^_=+{}[]\\"
SIGNALS = ("symbols", "capitals", "shouts", "variety", "echo", "abuse", "abuse_share", "foreign", "log_words")
#: Hashed features; a fixed size, whatever the vocabulary.
BUCKETS = 1 << 18
#: The scorer is fitted on about so many documents, drawn by a hash of key and text.
TRAIN_ROWS = 15_000
QUESTIONS = ("good", "abusive")
#: Kept with this probability of good form at least, and less than this one of abuse.
GOOD, ABUSIVE = 0.5, 0.9
STEPS, RATE, DECAY, SEEN, BLOCK = 100, 0.05, 1e-4, 3, 2000


def signals(texts: pa.Array, hashed: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signals (texts x SIGNALS), and if ``hashed`` the distinct (text, feature) pairs of every text in order of texts."""
    words, bounds = word_arrays(texts, lower=False)
    texts = texts.cast(pa.string()).fill_null("")
    n, word = np.diff(bounds), indices(words)
    owner = np.repeat(np.arange(len(texts)), n)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0]:offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    offsets -= offsets[0]

    def share(table: np.ndarray, of: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        return np.diff(sums[offsets]) / np.maximum(of, 1)

    table = lambda values: np.isin(np.arange(256), list(values)).astype(np.uint8)
    ones = np.ones(len(texts))
    blank = share(table([32, 9, 10, 11, 12, 13]), ones)
    chars = np.diff(offsets) - blank
    capitals, small = share(table(range(65, 91)), ones), share(table(range(97, 123)), ones)
    high = share(table(range(128, 256)), ones)

    distinct = np.unique(owner * max(len(words.dictionary), 1) + word) if len(word) else np.zeros(0, np.int64)
    text_of, word_of = np.divmod(distinct, max(len(words.dictionary), 1))
    kinds = np.bincount(text_of, minlength=len(texts))
    same = np.zeros(len(word))
    if len(word):
        same[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    raw = words.dictionary.to_pylist()
    plain = [w.decode("utf-8", "replace").lower().strip(".,;:!?\"'()[]{}…«»“”„’‘-–—*#$%&|<>") for w in raw]
    abuse = np.array([w in ABUSE for w in plain], np.float64)
    hits = np.bincount(owner, weights=abuse[word] if len(word) else None, minlength=len(texts)) if len(word) else np.zeros(len(texts))
    out = np.stack([
        share(table(SYMBOLS), chars), capitals / np.maximum(capitals + small, 1), share(table(b"!"), chars),
        kinds / np.maximum(n, 1), np.bincount(owner, weights=same, minlength=len(texts)) / np.maximum(n, 1) if len(word) else np.zeros(len(texts)),
        hits, hits / np.maximum(n, 1), high / np.maximum(capitals + small + high, 1), np.log1p(n)], axis=1)
    if not hashed:
        return out, np.zeros(0, np.int64), np.zeros(0, np.int64)
    feature = np.array([[xxhash.xxh32_intdigest(w) % BUCKETS, xxhash.xxh32_intdigest(w[:5], 1) % BUCKETS] for w in plain], np.int64).reshape(-1, 2)
    pairs = np.concatenate([text_of * BUCKETS + feature[word_of, 0], text_of * BUCKETS + feature[word_of, 1]])
    text_of, feature_of = np.divmod(np.unique(pairs), BUCKETS)
    return out, text_of, feature_of


def votes(values: np.ndarray) -> np.ndarray:
    """Votes (1 yes, -1 no, 0 none) of the labellers: six on good form, three on abuse.

    Each of the first five knows one kind of bad form and says nothing otherwise; the sixth calls
    texts good in which none of these kinds shows. Abuse is known by number and by share of abusive
    words; texts in plain ASCII without any are called clean.
    """
    s = {name: values[:, i] for i, name in enumerate(SIGNALS)}
    words = np.expm1(s["log_words"])
    bad = lambda test: np.where(test, -1, 0)
    plain = ((s["symbols"] < 0.004) & (s["capitals"] < 0.15) & (s["shouts"] < 0.002) & (s["echo"] < 0.03)
             & ((s["variety"] > 0.5) | (words < 10)) & (words >= 1))
    return np.stack([
        bad(s["symbols"] > 0.03), bad((s["capitals"] > 0.3) & (words >= 5)), bad(s["shouts"] > 0.02),
        bad((s["variety"] < 0.4) & (words >= 10)), bad((s["echo"] > 0.15) & (words >= 5)), np.where(plain, 1, 0),
        -bad(s["abuse"] >= 2), -bad(s["abuse_share"] > 0.004), bad((s["abuse"] == 0) & (s["foreign"] < 0.01))], axis=1).astype(np.int8)


#: Labellers of each question; the annotators' vote comes last.
OWN = {"good": (0, 1, 2, 3, 4, 5), "abusive": (6, 7, 8)}
HEURISTICS = 9


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Posterior probability of "yes" per pattern of votes, and the accuracy of each labeller.

    A vote is right with its labeller's accuracy, independently given the class; saying nothing tells
    nothing, and no class is preferred beforehand, so a pattern without votes has one half. Accuracies
    start at 0.9 (0.95 for the last labeller, the annotators) and stay between 0.55 and 0.995; they
    carry four pseudo-votes, three of them right.
    """
    said = patterns != 0
    accuracy = np.array([0.9] * (patterns.shape[1] - 1) + [0.95])
    post = np.full(len(patterns), -1.0)
    for _ in range(rounds):
        new = 1 / (1 + np.exp(-(patterns @ np.log(accuracy / (1 - accuracy)))))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
        right = np.where(patterns > 0, post[:, None], 1 - post[:, None]) * said
        accuracy = np.clip((counts @ right + 3) / (counts @ said + 4), 0.55, 0.995)
    return post, accuracy


@dataclass(frozen=True)
class Scorer:
    """Linear scorer of one question: weights of hashed features and of signals, and the scale of the signals."""

    hashed: np.ndarray
    dense: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def probability(self, values: np.ndarray, text_of: np.ndarray, feature_of: np.ndarray) -> np.ndarray:
        n = len(values)
        sums = np.bincount(text_of, weights=self.hashed[feature_of], minlength=n) if len(text_of) else np.zeros(n)
        dense = np.column_stack([np.clip((values - self.mean) / self.scale, -8, 8), np.ones(n)])
        return 1 / (1 + np.exp(-np.clip(sums + dense @ self.dense, -60, 60)))


def fit(values: np.ndarray, text_of: np.ndarray, feature_of: np.ndarray, target: np.ndarray, weight: np.ndarray) -> Scorer:
    """Logistic regression on soft targets by full gradients with adaptive steps; rows of weight 0 teach nothing.

    Features of fewer than SEEN texts get no weight.
    """
    n = len(values)
    mean, scale = values.mean(axis=0), values.std(axis=0) + 1e-6
    dense = np.column_stack([np.clip((values - mean) / scale, -8, 8), np.ones(n)])
    # blocks of texts, so that nothing but the numbers of texts and features is held for all of them
    seen = np.bincount(feature_of, minlength=BUCKETS) >= SEEN
    cuts = np.searchsorted(text_of, np.arange(0, n + BLOCK, BLOCK))
    blocks = []
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        kept = seen[feature_of[a:b]]
        blocks.append((slice(i * BLOCK, min(n, (i + 1) * BLOCK)), text_of[a:b][kept] - i * BLOCK, feature_of[a:b][kept]))
    weights = np.zeros(BUCKETS + dense.shape[1])
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, STEPS + 1):
        slope = np.zeros_like(weights)
        for own, t, f in blocks:
            size = own.stop - own.start
            z = np.bincount(t, weights=weights[f], minlength=size) + dense[own] @ weights[BUCKETS:]
            error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - target[own]) * weight[own]
            slope[:BUCKETS] += np.bincount(f, weights=error[t], minlength=BUCKETS)
            slope[BUCKETS:] += dense[own].T @ error
        slope /= max(weight.sum(), 1)
        slope[:-1] += DECAY * weights[:-1]
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        weights -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Scorer(weights[:BUCKETS], weights[BUCKETS:], mean, scale)


@F.arrow_udf(T.StringType())
def _voted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    alone("weak_quality")
    for batch in batches:
        for part in slices(batch):
            yield pa.array([" ".join(map(str, v)) for v in votes(signals(part, hashed=False)[0]).tolist()], pa.string())
        if not len(batch):
            yield pa.array([], pa.string())
        batch = part = None  # else it is held until the next one is read


def _annotated(docs: DataFrame, labels: DataFrame | None, key: str, held_out: Column | None) -> DataFrame:
    """``docs`` (k, ...) plus the annotators' votes ``good`` and ``abusive``; contradicting labels are none."""
    none = F.lit(0)
    if labels is None:
        return docs.withColumns({q: none for q in QUESTIONS})
    own = labels.select(named(labels, key).alias("k"), *[(F.col(c) * 2 - 1).cast("int").alias(q) for c, q in zip(("quality", "toxic"), QUESTIONS)])
    own = own.where("k is not null")
    if held_out is not None:
        own = own.where(~held_out)
    own = own.groupBy("k").agg(*[F.when(F.min(q) == F.max(q), F.min(q)).alias(q) for q in QUESTIONS])
    return docs.join(own, "k", "left").withColumns({q: F.coalesce(F.col(q), none) for q in QUESTIONS})


def learn(docs: DataFrame, labels: DataFrame | None, key: str = "doc_id", text: str = "text", held_out: Column | None = None,
          train_rows: int = TRAIN_ROWS) -> tuple[dict[str, Scorer], dict[str, np.ndarray]]:
    """A scorer per question, and the labellers' estimated accuracies (annotators last).

    ``labels`` (key, quality, toxic; 1 and 0) is one labeller among others and may be absent;
    ``held_out``, a condition on its key as column ``k``, takes labels out for a test. Votes are counted
    over all documents. The scorer is fitted in one task on about ``train_rows`` documents.
    """
    rows = docs.select(named(docs, key).alias("k"), F.coalesce(named(docs, text), F.lit("")).alias("body"))
    voted = _annotated(rows.select("k", _voted("body").alias("votes")), labels, key, held_out)
    counted = voted.groupBy("votes", *QUESTIONS).agg(F.count(F.lit(1)).alias("n")).collect()
    patterns = np.array([[int(x) for x in r["votes"].split()] + [r[q] for q in QUESTIONS] for r in counted], np.int64).reshape(-1, HEURISTICS + 2)
    counts = np.array([r["n"] for r in counted], np.float64)
    total, accuracies, known = counts.sum(), {}, {}
    for at, q in enumerate(QUESTIONS):
        own = [*OWN[q], HEURISTICS + at]
        distinct, back = np.unique(patterns[:, own], axis=0, return_inverse=True)
        post, accuracies[q] = expectation_maximisation(distinct, np.bincount(back.ravel(), weights=counts, minlength=len(distinct)))
        known[q] = {tuple(p): float(x) for p, x in zip(distinct.tolist(), post)}

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("weak_quality")
        values, text_of, feature_of, marks, base = [np.zeros((0, len(SIGNALS)))], [], [], [], 0
        for batch in batches:
            at = 0
            for part in slices(batch.column(0)):
                v, t, f = signals(part)
                gold = [batch.column(1 + i).slice(at, len(part)).to_numpy(zero_copy_only=False) for i in range(2)]
                at += len(part)
                marks.append(np.column_stack([votes(v), *gold]))
                values.append(v)
                text_of.append((t + base).astype(np.int32))
                feature_of.append(f.astype(np.int32))
                base += len(part)
        if not base:
            return
        values, text_of, feature_of, marks = map(np.concatenate, (values, text_of, feature_of, marks))
        for at, q in enumerate(QUESTIONS):
            own = marks[:, [*OWN[q], HEURISTICS + at]]
            target = np.array([known[q].get(tuple(p), 0.5) for p in own.tolist()])
            s = fit(values, text_of, feature_of, target, own.any(axis=1).astype(float))
            tidy()
            yield pa.RecordBatch.from_pydict({"question": [q], "hashed": [s.hashed.astype("<f8").tobytes()], "rest": [json.dumps(
                [s.dense.tolist(), s.mean.tolist(), s.scale.tolist()])]})

    drawn = F.pmod(F.xxhash64("k", "body", F.lit("train")), F.lit(1_000_000)) < F.lit(int(min(1.0, train_rows / max(total, 1)) * 1_000_000))
    sample = _annotated(rows.where(drawn), labels, key, held_out).select("body", *QUESTIONS)
    fitted = sample.repartition(1).sortWithinPartitions(F.xxhash64("body"), "body").mapInArrow(train, "question string, hashed binary, rest string").collect()
    found = {}
    for r in fitted:
        found[r["question"]] = Scorer(np.frombuffer(r["hashed"], "<f8"), *map(np.array, json.loads(r["rest"])))
    blank = Scorer(np.zeros(BUCKETS), np.zeros(len(SIGNALS) + 1), np.zeros(len(SIGNALS)), np.ones(len(SIGNALS)))
    return {q: found.get(q, blank) for q in QUESTIONS}, accuracies


def score(df: DataFrame, scorers: dict[str, Scorer], text: str = "text", to: str = "scores") -> DataFrame:
    """``df`` plus the struct ``to``: ``good`` and ``abusive`` (probabilities) and ``kept`` (good >= GOOD, abusive < ABUSIVE).

    Null and empty texts are scored like any text, from signals of zero. All rows and columns stay.
    """
    shared = df.sparkSession.sparkContext.broadcast(scorers)
    result = T.StructType([*(T.StructField(q, T.DoubleType()) for q in QUESTIONS), T.StructField("kept", T.BooleanType())])

    @F.arrow_udf(result)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        alone("weak_quality")
        names = [*QUESTIONS, "kept"]
        for batch in batches:
            for part in slices(batch):
                found = signals(part)
                good, bad = (np.round(shared.value[q].probability(*found), 9) for q in QUESTIONS)
                yield pa.StructArray.from_arrays([pa.array(good), pa.array(bad), pa.array((good >= GOOD) & (bad < ABUSIVE))], names)
            if not len(batch):
                yield pa.StructArray.from_arrays([pa.array([], pa.float64())] * 2 + [pa.array([], pa.bool_())], names)
            batch = part = None  # else it is held until the next one is read

    return df.withColumn(to, run(named(df, text)))
