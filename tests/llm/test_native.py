"""Licence scan, quality rules and sharding against plain Python, and their odd inputs."""

import hashlib
import math
import re
import textwrap
from collections import Counter

import numpy as np
import pytest
from compare import compare, duck
from pyspark.sql import functions as F

from anchorkit.llm import licences, quality_rules, queries, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, sf, name):
    assert compare(spark, duck(sf), sf, name, queries.QUERIES[name], queries.ORACLES[name]) is None


def repeat_words(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)})


def test_counts_against_python(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abc"), n)) + "\n" * int(n % 3) for n in range(0, 60)]
    texts += ["x y z x y z", "a a a a", "a a a", "p q r s p q r t p q", "#1 * $\n\n#1 * $\n \n", "a\x0bb\x0cc\rd\te"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.text_counts(df).collect():
        words = WORD.findall(r.text)
        lines = [x for x in r.text.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", r.text)), len(lines), len(lines) - len(set(lines)), repeat_words(r.text))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) == want, r.text


def test_windows_are_compared_by_whole_hashes(spark):
    # the first two differ in their lowest bit only
    df = spark.createDataFrame([([1 << 40, (1 << 40) + 1, 5, 77 << 30, 5],), ([-8, -7, -6, -5, 3, 3],)], "w array<long>")
    assert [r[0] for r in df.select(quality_rules._covered_words(F.col("w"))).collect()] == [5, 4]


def test_binomial_tail(spark):
    def exact(n, k, p):
        return sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p))
                   for j in range(k + 1))
    cases = [(1, 0), (10, 0), (100, 0), (100, 1), (5000, 40), (5000, 61), (200_000, 2400), (3, 3)]
    df = spark.createDataFrame(cases, "n long, k long")
    for r in df.withColumn("p", quality_rules.binomial_tail(F.col("n"), F.col("k"), 0.0125)).collect():
        want = exact(r.n, r.k, 0.0125) if r.k < r.n * 0.0125 else 1.0
        assert r.p == pytest.approx(want, rel=1e-9, abs=1e-300)


def test_cutoffs_keep_the_allowed_rate(spark):
    rng = np.random.default_rng(1)
    rows = [("a", *map(float, x)) for x in rng.random((4000, 4))] + [(None, 0.0, 0.0, 0.0, 5.0)] * 3
    good = spark.createDataFrame(rows, "stratum string, symbol_ratio double, dup_line_ratio double, repeat_ratio double, word_length double")
    grid = {s: tuple(x / 1000 for x in range(1000, 900, -1)) for s in quality_rules.CANDIDATES}
    found = {r.stratum: r for r in quality_rules.risk_cutoffs(good, "stratum", 0.05, 0.05, grid).collect()}
    values = np.array([r[1:] for r in rows if r[0] == "a"])
    cuts = np.array([found["a"][s] for s in grid])
    assert ((values > cuts).mean(axis=0) < 0.0125).all() and (cuts < 1).all()
    assert found[None].n_good == 3 and found[None].symbol_ratio is None  # too few labels: no rule


def test_rules_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1), (5, None)], "doc_id long, quality int")
    counted = quality_rules.text_counts(odd, prefix="q_")
    out = quality_rules.apply_cutoffs(counted, quality_rules.learn_cutoffs(counted, labels, prefix="q_"), prefix="q_")
    rows = out.collect()
    assert len(rows) == odd.count() and set(odd.columns) <= set(out.columns)
    assert all(r.q_n_words == 0 and r.q_base_failed and not r.q_kept for r in rows if not (r.text or "").strip())
    assert {r.q_n_repeat_words for r in rows if r.doc_id in (5, 6)} == {60_000}
    assert all(r.n_words == "own n_words" for r in rows)
    empty = quality_rules.text_counts(none)
    assert quality_rules.apply_cutoffs(empty, quality_rules.learn_cutoffs(empty, labels.limit(0))).count() == 0


def test_licences(spark, odd, none):
    texts = ["Copyright (c) 2020 A. Author\n" + licences.KNOWN[0][1].upper(), "released UNDER  the mit licence!", "x\nReleased under the MIT License.\ny",
             "This program mentions the MIT License.", "Licensed under CC-BY 4.0", licences.KNOWN[6][1].replace(",", " ;\n"), "", None, "©"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = licences.known_digests(spark)
    got = {r.doc_id: (r.licence, r.notices, r.n_notices) for r in licences.scan_licences(df, known).collect()}
    assert got == {0: ("MIT", None, 0), 1: ("MIT", "MIT", 1), 2: (None, "MIT", 1), 3: (None, None, 0), 4: ("CC-BY-4.0", "CC-BY-4.0", 1),
                   5: ("BSD-2-Clause", None, 0), 6: (None, None, 0), 7: (None, None, 0), 8: (None, None, 0)}
    out = licences.scan_licences(odd, known)
    assert out.count() == odd.count() and out.columns.count("digest") == 1
    assert licences.scan_licences(none, known).count() == 0
    # no known text at all, and ties between names
    assert licences.scan_licences(df, known.limit(0)).where("licence is not null or n_notices > 0").count() == 0
    two = licences.known_digests(spark, [("B", "same text"), ("A", "Same, text."), ("C", " . ")])
    assert [(r.licence, r.digest) for r in two.collect()] == [("A", hashlib.sha256(b"same  text").hexdigest())]


def test_known_licences_wrapped_at_any_width(spark):
    holders = ["", "Copyright (c) 2020 A. Author\n\n", "Copyright 2019-2021 The Authors. All rights reserved.\n\n", " * (c) Acme Corp.\n",
               "© 2020 Some One\nCopyright Some One\nCOPYRIGHT BY SOME ONE\n\n"]
    rows = []
    for licence, text in licences.KNOWN:
        for width in (18, 24, 37, 50, 60, 66, 70, 72, 75, 79, 80, 100):
            wrapped = "\n".join(textwrap.fill(line, width, break_long_words=False) for line in text.split("\n"))
            rows += [(len(rows) + k, licence, h + t) for k, (h, t) in enumerate([(holders[len(rows) % 5], wrapped), ("", wrapped.upper())])]
    df = spark.createDataFrame(rows, "doc_id long, want string, text string")
    out = licences.scan_licences(df, licences.known_digests(spark)).collect()
    assert [(r.doc_id, r.want, r.licence) for r in out if r.licence != r.want] == [] and len(out) == len(rows)
    usual = ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\n"
             "copyright notice and this permission notice appear in all copies.\n\n")
    isc = next(t for n, t in licences.KNOWN if n == "ISC" and t.startswith("Permission"))
    df = spark.createDataFrame([(0, "ISC License\n\nCopyright (c) 2020, A. Author\n\n" + usual + isc.split("\n\n")[1])], "doc_id long, text string")
    assert licences.scan_licences(df, licences.known_digests(spark)).first().licence == "ISC"


@pytest.mark.parametrize("piece_rows", [200_000, 20])
def test_shards_are_exact_and_gapless(spark, odd, none, piece_rows):
    df = spark.range(0, 1003, 1, 7).selectExpr("id div 3 as doc_id", "id as own")
    rows = sharding.uniform_shards(df, 16, seed=3, piece_rows=piece_rows).collect()
    assert sorted(r.own for r in rows) == list(range(1003))
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 16
    for s, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    again = sharding.uniform_shards(df, 16, seed=3, piece_rows=piece_rows).collect()
    assert {(r.own, r.shard, r.slot) for r in rows} == {(r.own, r.shard, r.slot) for r in again}
    out = sharding.uniform_shards(odd, 16)
    assert out.count() == odd.count() and {f.name: f.dataType.simpleString() for f in out.schema}["slot"] == "bigint"
    assert sharding.uniform_shards(none, 4).count() == 0


def test_communication_matrix_margins_and_law():
    counts, sizes = [5, 0, 7, 3], sharding.exact_sizes(15, 4)
    tables = [sharding.communication_matrix(counts, sizes, seed) for seed in range(2000)]
    assert all((m.sum(axis=1) == counts).all() and (m.sum(axis=0) == sizes).all() and (m >= 0).all() for m in tables)
    mean = np.mean(tables, axis=0)
    assert np.abs(mean - np.outer(counts, sizes) / 15).max() < 0.1
    draw = np.random.default_rng(0)
    large = [sharding._hypergeometric(draw, 3_000_000_000, 5_000_000_000, 8000) for _ in range(400)]
    assert abs(np.mean(large) - 3000) < 10 and 30 < np.std(large) < 58
