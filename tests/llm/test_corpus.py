"""Language model, SimHash, benchmark overlaps, weak labels and the pipeline against brute force."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from anchorkit.llm import decontamination, elias_fano, ngram_trie, queries, simhash, weak_quality, word_arrays


def words_of(text):
    return (text or "").encode().lower().split()


# ---- SimHash

def plain_fingerprint(text):
    words = words_of(text)
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    """Smallest id of each id's group, by comparing all pairs."""
    distinct = sorted(set(prints.values()))
    parent = {f: f for f in distinct}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f
    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for d, f in prints.items():
        least[root(f)] = min(least.get(root(f), d), d)
    return {d: least[root(f)] for d, f in prints.items()}


def test_simhash_query(spark, sf):
    rows = queries.QUERIES["op4_simhash_groups"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    prints = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    assert prints == {d: plain_fingerprint(t) for d, t in texts.items()}
    assert {r.doc_id: r.component_id for r in rows} == plain_groups(prints)


@pytest.mark.parametrize("most", [64, 3])
def test_links_lose_none_in_crowded_values(spark, most):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    prints = {centre ^ rng.getrandbits(6) ^ rng.getrandbits(3) << 40 for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(p,) for p in [*signed, None, signed[0]]], "fp long"), "fp", 3, most).collect()}
    mask = (1 << 64) - 1
    assert got == {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & mask).bit_count() <= 3}


def test_components_of_a_path_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(100, 140)] + [(5, x) for x in range(6, 60)] + [(7, 7)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 5 for i in range(5, 60)}}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_odd_rows(spark, odd, none):
    out = simhash.near_duplicates(odd)
    rows = out.collect()
    assert len(rows) == odd.count() and out.columns.count("fingerprint") == 1
    blank = [r for r in rows if not (r.text or "").strip()]
    assert {r.component_id for r in blank} == {2} and sum(r.is_first for r in blank) == 1
    same = [r for r in rows if r.text == "one two three four"]
    assert {r.component_id for r in same} == {1} and sum(r.is_first for r in same) == 1
    assert simhash.near_duplicates(none).count() == 0


# ---- benchmark overlaps

def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_overlaps_exact_and_substituted(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    bench = {i: [word() for _ in range(n)] for i, n in enumerate([6, 11, 15, 20, 40, 90, 4, 0])}
    noise = lambda n: [word() for _ in range(n)]
    docs, want = [], set()
    for i, w in bench.items():
        for wrong in range(3):
            changed = list(w)
            for k in range(wrong):
                if len(w) >= 20:
                    changed[len(w) * (k + 1) // 4] = "zzz"
            n = len(docs)
            docs.append((n, " ".join(noise(30) + [x.upper() + "," for x in changed] + noise(7))))
            if len(w) >= 5:
                want.add((n, i))
    n = len(docs)
    docs += [(n, " ".join(noise(300))), (n + 1, None), (n + 2, ""), (None, " ".join(bench[4])), (n + 3, " ".join(bench[5][:12])), (0, docs[0][1])]
    rows = [(i, " ".join(w)) for i, w in bench.items()] + [(4, " ".join(bench[4])), (None, " ".join(bench[4])), (50, None)]
    found = decontamination.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), items(spark, rows)).collect()
    assert {(r.key, r.item) for r in found} == want | {(None, 4)}
    assert len([r for r in found if r.key == 0]) == 2  # a repeated document is a row of its own
    assert all(r.equal == len(bench[r.item]) for r in found if r.key is not None and r.key % 3 == 0)


def best_equal(same):
    """Most equal tokens of any stretch with 4 of 5 of them equal, and the tokens of the shortest such stretch."""
    whole = [(sum(same[a:b]), a - b) for a in range(len(same)) for b in range(a + 1, len(same) + 1) if 5 * sum(same[a:b]) >= 4 * (b - a)]
    equal, length = max(whole, default=(0, 0))
    return (equal, -length) if equal else (0, 0)


def test_diagonals_against_brute_force():
    signs = ["EEDEEEEEEEEEEDE", "EEEEDEEEDEEEDEEE DEEEDEEEE DEEEDEEEE".replace(" ", "")]
    same = [[x == "E" for x in w] for w in signs]
    same += [[k not in away for k in range(15)] for n in (1, 2, 3) for away in itertools.combinations(range(15), n)]
    rng = random.Random(8)
    same += [[rng.random() < 0.8 for _ in range(rng.randrange(1, 40))] for _ in range(200)]
    for eq in same:
        item = np.arange(1, len(eq) + 1, dtype=np.int64)
        doc = np.concatenate([[0, 0, 0], np.where(eq, item, 0)])
        equal, length, begin, item_begin = decontamination.compare(doc, item, 3)
        assert (equal, length) == best_equal(eq) and begin == item_begin + 3
        assert int(np.sum(doc[begin:begin + length] == item[item_begin:item_begin + length])) == equal
    assert decontamination.compare(np.arange(1, 16), np.where(np.isin(np.arange(15), [2, 12]), 0, np.arange(1, 16)), 0)[:2] == (13, 15)


def test_overlaps_keep_what_meets_the_rule(spark):
    bench = [[f"w{k}x{j}" for j in range(n)] for k, n in enumerate([15, 34])]
    away = {0: {2, 12}, 1: {j for j, x in enumerate("EEEEDEEEDEEEDEEEDEEEDEEEEDEEEDEEEE") if x == "D"}}
    docs = [(k, " ".join(["no"] * 20 + ["zzz" if j in away[k] else w for j, w in enumerate(bench[k])] + ["no"] * 20)) for k in away]
    found = decontamination.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), items(
        spark, [(k, " ".join(w)) for k, w in enumerate(bench)])).collect()
    got = {(r.key, r.item): (r.equal, r.length) for r in found}
    assert got == {(k, k): best_equal([j not in away[k] for j in range(len(bench[k]))]) for k in away}


def test_long_overlaps_are_whole_wherever_they_lie(spark):
    long = [f"q{j}" for j in range(700)]
    fifth = [f"s{j}" for j in range(300)]
    bench = [(0, " ".join(long)), (1, " ".join(fifth))]
    sparse = [w if j % 5 != 4 else "zzz" for j, w in enumerate(fifth)]
    parts = [["no"] * k + long + ["no"] * 9 for k in (0, 100, 200, 255)] + [["no"] * 30 + sparse]
    docs = [(k, " ".join(w)) for k, w in enumerate(parts)]
    want = {(k, 0, 700, 700, b, 1) for k, b in enumerate((0, 100, 200, 255))}
    same = [a == b for a, b in zip(sparse, fifth)]
    doc, item = np.array([1] * 30 + [2 if x else 3 for x in same]), np.full(len(same), 2)
    equal, length, begin, _ = decontamination.compare(doc, item, 30)
    want.add((4, 1, equal, length, begin, 1))
    assert length == 299
    for partitions in (1, 3):
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(partitions)
        found = decontamination.overlaps(df, items(spark, bench)).collect()
        assert {(r.key, r.item, r.equal, r.length, r.begin, r.places) for r in found} == want and len(found) == len(want)


def test_overlaps_query_against_brute_force(spark, sf):
    def tokens(text):
        return [t for t in (re.sub(r"^[\W_]+|[\W_]+$", "", w.lower()) for w in re.split(r"[ \t-\r]+", text or "")) if t]
    docs = {r.doc_id: tokens(r.text) for r in queries.table(spark, sf, "documents").collect()}
    bench = {r.item_id: tokens(r.text) for r in queries.table(spark, sf, "benchmark").collect()}
    want = {(d, i) for d, w in docs.items() for i, b in bench.items()
            if len(b) >= 5 and any(w[k] == b[0] and w[k:k + len(b)] == b for k in range(len(w) - len(b) + 1))}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op7_benchmark_overlaps"](spark, sf).collect()}
    assert want <= got
    for d, i in got - want:  # what isn't there word by word is there with substitutions
        best = max(sum(x == y for x, y in zip(docs[d][k:], bench[i])) for k in range(len(docs[d])))
        assert best >= 13


def test_decontamination_odd_rows(spark, odd, none):
    bench = items(spark, [(1, "one two three four five six"), (2, " ".join(f"w{i}" for i in range(300, 340)))])
    kept = decontamination.without_benchmark(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2  # the two long texts hold the second item
    assert decontamination.without_benchmark(none, bench).count() == 0
    assert decontamination.without_benchmark(odd, bench.limit(0)).count() == odd.count()


# ---- Elias-Fano and language model

@pytest.mark.parametrize("n, universe", [(0, 1), (1, 1), (5, 6), (700, 500), (1000, 1 << 20), (3000, 1 << 63)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, universe, n, dtype=np.uint64))
    if n > 100:
        values[n // 4:n // 2] = values[n // 4] + np.minimum(np.arange(n // 2 - n // 4), universe - 1 - int(values[n // 4])).astype(np.uint64)
    values = np.sort(values)  # runs of neighbours beside spread ones
    coded = elias_fano.EliasFano(elias_fano.from_buffer(np.frombuffer(elias_fano.to_bytes(elias_fano.encode(values, universe)), np.uint8)))
    asked = np.concatenate([values, values + np.uint64(1), rng.integers(0, universe, 500, dtype=np.uint64)])
    at = np.searchsorted(values, asked)
    want = np.array([int(i) if i < n and values[i] == x else -1 for i, x in zip(at, asked)])
    assert (coded.find(asked) == want).all() and (coded.get(np.arange(n)) == values).all()


def test_words_are_hashed_together(monkeypatch):
    """Only words of 32 bytes or more are hashed one by one, and all as xxhash does it."""
    rng, digest, single = np.random.default_rng(4), xxhash.xxh64_intdigest, []
    words = [bytes(rng.integers(0, 256, n % 80, dtype=np.uint8)) for n in range(800)]
    want = [digest(w) for w in words]
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda w: single.append(len(w)) or digest(w))
    for at, n in [(0, 800), (3, 700), (31, 2), (5, 0), (0, 1)]:
        some = pa.array(words, pa.binary()).slice(at, n)
        assert word_arrays.xxh64(some).tolist() == want[at:at + n]
    hashes = ngram_trie._hashes(pa.array([w for w in words if len(w) < 32], pa.binary()).dictionary_encode())
    assert min(single) == 32 and len(hashes) == len({w for w in words if len(w) < 32}) and (hashes > 0).all()


def test_scoring_asks_for_each_pair_once_in_order(spark, odd, monkeypatch):
    model, asked = ngram_trie.train(odd, shard_tokens=5000), []
    find = elias_fano.EliasFano.find
    monkeypatch.setattr(elias_fano.EliasFano, "find", lambda self, values: asked.append(values) or find(self, values))
    texts = pa.array([f"w{i % 90} w{i % 7} unheard w{i % 90} w{i % 7}" for i in range(3000)])
    ngram_trie._loaded(ngram_trie.Words, model), ngram_trie._loaded(ngram_trie.Trie, model)
    one, alone = ngram_trie._scores(model, texts), [ngram_trie._scores(model, texts.slice(i, 1)) for i in (0, 1, 2999)]
    assert [x[i] for i in (0, 1, 2999) for x in one] == pytest.approx([x[0] for rows in alone for x in rows])
    asked.clear()
    key = np.array([(a + 1) << 32 | (b + 1) for a in range(-1, 300) for b in (-1, 3, 8)], np.uint64)
    ngram_trie.Trie(model).pairs(key, np.zeros(len(key)))
    contexts = sum(len(v) for v in asked[::2])  # first words, then their successors, shard after shard
    assert contexts <= 301 and all((np.diff(v.astype(np.int64)) > 0).all() for v in asked[1::2])


@pytest.mark.parametrize("width", [1, 7, 31, 57, 58, 63, 64])
def test_packed_numbers_of_every_width(width):
    rng = np.random.default_rng(width)
    values = np.sort(rng.integers(0, 1 << 64, 300, dtype=np.uint64) >> np.uint64(64 - width))
    low = elias_fano._packed(values, width)
    coded = elias_fano.EliasFano({"head": np.array([300, width]), "low": low, "high": np.zeros(1, np.uint64), "zeros": np.zeros(2, np.uint32)})
    assert (coded._lows(np.arange(300)) == values).all()


def test_unknown_word_is_no_context(spark):
    """The number -1 of an unknown word lies in no level, however dense its first words are."""
    dense = elias_fano.EliasFano(elias_fano.encode(np.arange(5, dtype=np.uint64), 6))
    assert dense.find(np.array([-1, 0, 4], np.int64)).tolist() == [-1, 0, 4]
    model = ngram_trie.train(spark.createDataFrame([("a b c d",), ("b c a",), ("c c d",)], "text string"))
    for r in ngram_trie.score(spark.createDataFrame([("x",), ("x y",), ("x y x",)], "text string"), model, to="s").collect():
        # nothing is known of what follows an unknown word: every token scores as a single word
        assert r["s"].n_known == 1 and r["s"].score == pytest.approx(r["s"].base_score, abs=1e-9)


def test_lm_query_against_counts(spark, sf):
    rows = {r.doc_id: r for r in queries.QUERIES["op1_lm_scores"](spark, sf).collect()}
    end = b"\n"
    texts = {r.doc_id: words_of(r.text) + [end] for r in queries.table(spark, sf, "documents").collect()}
    learnt = [w for d, w in texts.items() if zlib.crc32(str(d).encode()) % 7 != 2]
    one, two, three = Counter(), Counter(), Counter()
    for w in learnt:
        one.update(w)
        two.update(zip(w, w[1:]))
        three.update(zip(w, w[1:], w[2:]))
    after, kinds = Counter(), Counter()
    for key, n in [*two.items(), *three.items()]:
        after[key[:-1]] += n
        kinds[key[:-1]] += 1
    total, d = sum(one.values()), ngram_trie.DISCOUNT

    def p(context, w):
        if not context:
            return (one[w] + 1) / (total + len(one) + 1)
        lower = p(context[1:], w)
        if not after[context]:
            return lower
        n = (two if len(context) == 1 else three)[*context, w]
        return (max(n - d, 0) + d * kinds[context] * lower) / after[context]

    held = [0.0, 0.0]
    for doc, w in texts.items():
        r = rows[doc]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(one[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(sum(math.log10(p((), x)) for x in w), abs=1e-6)
        want = sum(math.log10(p(tuple(w[max(0, i - 2):i]), x)) for i, x in enumerate(w))
        assert abs(r.score - want) < 0.03 * len(w) + 0.1  # the quantiser's error
        held = [held[0] + r.base_score * r.held_out, held[1] + r.score * r.held_out]
    assert held[1] > held[0]


def test_lm_in_small_shards_and_odd_rows(spark, odd, none):
    whole = ngram_trie.train(odd)
    parts = ngram_trie.train(odd, shard_tokens=5000, shard_words=100)
    assert parts.shards > 5 and len(parts.starts) > 4 and parts.words == whole.words
    a, b = ([(r.doc_id, r["s"]) for r in ngram_trie.score(odd, m, to="s").collect()] for m in (whole, parts))
    assert len(a) == odd.count()
    for (k, x), (_, y) in zip(a, b):
        assert (x.n_tokens, x.n_known) == (y.n_tokens, y.n_known) and abs(x.score - y.score) < 0.05 * x.n_tokens
    blank = ngram_trie.train(none)
    assert (blank.words, blank.tokens) == (0, 0)
    assert all(r["s"].base_score == 0 and r["s"].n_known == 0 for r in ngram_trie.score(odd, blank, to="s").collect())
    assert ngram_trie.score(none, whole).count() == 0


# ---- weak labels

def test_em_recovers_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.3
    right = np.array([0.9, 0.7, 0.8, 0.95])
    marks = np.where(rng.random((20_000, 4)) < right, 1, -1) * np.where(truth, 1, -1)[:, None] * (rng.random((20_000, 4)) < 0.7)
    patterns, counts = np.unique(marks, axis=0, return_counts=True)
    post, accuracy = weak_quality.expectation_maximisation(patterns, counts.astype(float))
    assert np.abs(accuracy - right).max() < 0.06 and ((post > 0) & (post < 1)).all()


def test_classifier_on_held_out_labels(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    scorers, accuracy = weak_quality.learn(docs, labels, held_out=F.crc32(F.col("k").cast("string").cast("binary")) % 3 == 0)
    assert min(accuracy["good"]) > 0.8
    rows = weak_quality.score(docs, scorers).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0).collect()
    clean = [r.scores.kept for r in rows if r.quality == 1 and r.toxic == 0]
    bad = [r.scores.good < 0.5 for r in rows if r.quality == 0]
    assert np.mean(clean) > 0.97 and np.mean(bad) > 0.9


def test_classifier_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    scorers, _ = weak_quality.learn(odd, labels)
    out = weak_quality.score(odd, scorers, to="verdict")
    assert out.count() == odd.count() and all(r.verdict.kept is not None for r in out.collect())
    blank, _ = weak_quality.learn(none, None)
    assert weak_quality.score(odd, blank).count() == odd.count() and weak_quality.score(none, scorers).count() == 0


# ---- pipeline

def test_pipeline_against_its_operators(spark, sf):
    import corpus_pipeline

    docs = queries.table(spark, sf, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.staged(stage(spark, kept, sf), "test")
        assert out.columns == docs.columns, name
        assert out.join(kept, "doc_id", "left_anti").count() == 0 and out.count() == out.select("doc_id").distinct().count()
        if name == "SimHash near-dedup":
            groups = plain_groups({r.doc_id: plain_fingerprint(r.text) for r in kept.collect()})
            assert {r.doc_id for r in out.collect()} == set(groups.values())
        kept = out
    rows = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in kept.collect())


def test_summing_and_building_a_shard_of_triples_stays_small(tmp_path):
    """Two tasks of an executor sum or build a shard each beside the JVM: a whole shard may take 100 MB."""
    import tracemalloc

    n, rng = 200_000, np.random.default_rng(3)
    words = rng.integers(0, 2000, n + 2).astype(np.uint64)
    model = ngram_trie.Model(f"file://{tmp_path}", (0,), 2000, n, 1)
    key, last, count = ngram_trie._summed(words[:-2] << np.uint64(32) | words[1:-1], words[2:].astype(np.uint32) + np.uint32(1), None)
    context, sizes = ngram_trie._by_context(key)
    row = ngram_trie._row(0, "triples", {"context": context, "size": sizes.astype(np.uint32), "word": last, "count": count.astype(np.uint32)})
    tracemalloc.start()
    out = ngram_trie._sum_triples(model)((pa.scalar(0),), pa.table({"data": row["data"]}))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak / len(last) * ngram_trie.SHARD_TOKENS < 100e6
    held = ngram_trie._joined([d for d, k in zip(out["data"], out["kind"].to_pylist()) if k == "triples"], ngram_trie._TRIPLES)
    assert (held["context"] == key).all() and (held["word"] == last - 1).all() and (held["count"] == count).all()


def test_blocks_of_contexts_cut_none():
    context = np.repeat(np.array([1, 4, 9], np.uint64), [3, ngram_trie.BLOCK + 5, 2])
    assert [(s.start, s.stop) for s in ngram_trie._blocks(context)] == [(0, ngram_trie.BLOCK + 8), (ngram_trie.BLOCK + 8, ngram_trie.BLOCK + 10)]
    assert not list(ngram_trie._blocks(context[:0]))
