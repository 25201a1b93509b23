"""Vector codes, conversation tries and repeated windows against brute force, through their queries too."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from anchorkit.llm import conversation_trie, queries, repeated_windows, vector_codes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- prefix trie of conversations

def rebuilt(rows):
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            said[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(s)] for c, s in said.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + own[c][h:]
    return out


def trie_rows(convs):
    members, below, children, ends = defaultdict(list), defaultdict(set), defaultdict(set), defaultdict(list)
    for c, said in convs.items():
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
        ends[tuple(said)].append(c)
    for path in members:
        for d in range(len(path) + 1):
            below[path[:d]].add(path)
        if path:
            children[path[:-1]].add(path)
    return sorted((
        min(m), len(path), min(members[path[:-1]]) if path else None, len(m), len(children[path]),
        sum(not children[x] for x in below[path]), sum((len(members[x]) - 1) * len(x[-1][1]) for x in below[path] if x),
        hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest()) for path, m in members.items())


def conversations(seed=1):
    rng = np.random.default_rng(seed)
    rows = [(int(c), t, ["user", "assistant"][t % 2], f"t{rng.integers(3)} é" * int(rng.integers(3)))
            for c in [*range(0, 350, 7), *range(600, 700, 9), -5, -200] for t in range(int(rng.integers(0, 9)))]
    # copies of one conversation, a long one, repeated rows, ties, nulls, a second long one that parts late
    rows += [(c, t, "user", "same") for c in range(800, 860) for t in range(7)]
    rows += [(c, t, "user", f"long {t}" if t < 300 else f"end {c}") for c in (900, 901) for t in range(400)]
    rows += [(5000, 1, "user", "twice"), (5000, 1, "user", "twice"), (5001, None, None, None), (5001, 3, None, "x"), (None, 1, "user", "none")]
    return rows


def written(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def key(row):
    return tuple((x is not None, x) for x in row)


def test_trie_query_against_brute_force(spark, tmp_path):
    rows = conversations()
    at = written(spark, tmp_path, "conversations", rows, "conv_id long, turn long, role string, text string")
    found = queries.op12_conversation_trie(spark, at)
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r[c] for c in cols) for r in found.collect()), key=key) == sorted(trie_rows(rebuilt(rows)), key=key)


def test_trie_doesn_t_depend_on_blocks(spark):
    rows = [r for r in conversations() if r[0] is None or r[0] < 900]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    nodes, ends = conversation_trie.conversation_trie(df, block_conversations=5, block_turns=30)
    convs = defaultdict(list)
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1])):
        convs[conv].append((role or "", text or ""))
    found = nodes.join(conversation_trie.end_digests(ends), conversation_trie.PATH, "left").collect()
    none = hashlib.sha256(b"").hexdigest()
    got = [(r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved"], r["ends_sha256"] or none) for r in found]
    assert sorted(got, key=key) == sorted(trie_rows(convs), key=key)


def test_walk_keeps_order_and_spans():
    keys = [bytes([i]) * 16 for i in range(4)]
    nodes = conversation_trie.walk([3, 5, 9], [[0, 1], [0, 2], []], keys, [1, 2, 3, 4])
    assert [(n[0], n[1], n[6], n[7]) for n in nodes] == [(4, 0, 3, 3), (3, 1, 3, 2), (1, 2, 3, 1), (1, 2, 5, 1)]
    assert [n[-1] for n in nodes] == [[9], [], [3], [5]]


def test_trie_of_clashing_columns_and_empty_tables(spark):
    rows = [(1, 0, "u", "a", "x", 1), (1, 1, "u", "b", "x", 1), (2, 0, "u", "a", "x", 2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position string, size long")
    nodes, ends = conversation_trie.conversation_trie(df)
    assert sorted(tuple(r) for r in nodes.select("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved").collect()) == [
        (1, 0, 2, 1, 1, 1), (1, 1, 2, 1, 1, 1), (1, 2, 1, 0, 1, 0)]
    assert sorted(x for r in ends.collect() for x in r["conv_ids"]) == [1, 2]
    nodes, ends = conversation_trie.conversation_trie(df.limit(0))
    assert nodes.count() == ends.count() == 0
    nulls = df.withColumn("conv_id", F.lit(None).cast("long"))
    assert conversation_trie.conversation_trie(nulls)[0].count() == 0


# ---- repeated windows

def without_repeats(rows, size=20):
    docs = [(k is None, k or 0, WORD.findall(t or "")) for k, t in rows]
    first = {}
    for none, k, w in docs:
        for i in range(len(w) - size + 1):
            x = tuple(w[i:i + size])
            first[x] = min(first.get(x, (none, k, i)), (none, k, i))
    out = []
    for none, k, w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if (none, k, i) > first[tuple(w[i:i + size])]:
                gone[i:i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((None if none else k, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=key)


def repeating_documents():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)] + ["É'é", "日本", "a b"]
    text = lambda n: " ".join(rng.choice(words, n))
    passage, other = text(60), text(25)
    rows = [(i, text(int(rng.integers(1, 200)))) for i in range(60)]
    rows += [(100 + i, f"{text(30)}\n\t{passage}  {text(10)} {other}") for i in range(40)]
    rows += [(200 + i, rows[7][1]) for i in range(30)] + [(300, passage), (301, other + " " + other), (302, " ".join(["x"] * 500))]
    rows += [(303, " ".join(f"{i % 33}" for i in range(40_000))), (None, passage), (None, text(50)), (304, None), (305, ""), (306, " \n\t "),
             (307, passage), (307, passage), (308, text(19)), (308, passage + " " + text(30)), (309, " ".join(["y"] * 21))]
    return rows


def test_repeats_query_against_brute_force(spark, tmp_path):
    rows = repeating_documents()
    at = written(spark, tmp_path, "documents", rows, "doc_id long, text string")
    found = queries.op13_repeated_windows(spark, at).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted((tuple(r) for r in found.collect()), key=key) == without_repeats(rows)


def test_repeats_don_t_depend_on_sketch_tasks_or_chunks(spark):
    rows = repeating_documents()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts, bits, held in ((1, 16, 500), (13, 20, 3000)):
        out = repeated_windows.remove_repeated(df.repartition(parts), most_bits=bits, held=held)
        got = [(r["doc_id"], r["dedup"]["n_words"], r["dedup"]["n_removed"], hashlib.sha256(r["dedup"]["kept"].encode()).hexdigest())
               for r in out.collect()]
        assert sorted(got, key=key) == without_repeats(rows)


def test_sketch_overestimates_and_is_smaller_than_the_windows(spark):
    df = spark.createDataFrame([(t,) for _, t in repeating_documents()], "text string")
    sketch = repeated_windows.repeated_cells(df)
    h1, h2, *_ = repeated_windows.window_hashes(pa.array([r[0] for r in df.collect()]))
    keys, counts = np.unique(np.stack([h1, h2]), axis=1, return_counts=True)
    seen = sketch.hits(sketch.row(0, keys[0]), {}) & sketch.hits(sketch.row(1, keys[1]), {})
    assert seen[counts > 1].all() and seen[counts == 1].mean() < 0.2
    full = repeated_windows.repeated_cells(df, most_bits=16)
    assert full.cells == 1 << 16 and full.hits(full.row(0, keys[0]), {})[counts > 1].all()


@pytest.mark.parametrize("size", [1, 2, 3, 7, 20, 33])
def test_window_hashes_of_any_size(size):
    texts = ["a b c a b c a b c", None, "", " ".join(str(i % 50) for i in range(300)), "a b c"]
    h1, h2, text, start, *_ = repeated_windows.window_hashes(pa.array(texts), size)
    seen = {}
    words = [WORD.findall(t or "") for t in texts]
    assert len(h1) == sum(max(0, len(w) - size + 1) for w in words)
    for a, b, t, s in zip(h1, h2, text, start):
        assert seen.setdefault((a, b), words[t][s:s + size]) == words[t][s:s + size]
    assert len(seen) == len({tuple(w[i:i + size]) for w in words for i in range(len(w) - size + 1)})


def test_repeats_of_odd_rows(spark, odd, none):
    out = repeated_windows.remove_repeated(odd.withColumn("dedup", F.lit("own")))
    assert out.columns == [*odd.columns, "dedup"] and out.count() == odd.count()
    kept = {(r["doc_id"], r["dedup"]["n_words"], r["dedup"]["n_removed"]) for r in out.collect()}
    # the cycle of 700 words repeats inside text 5; text 6 equals it and loses all
    assert {(5, 60_000, 59_300), (6, 60_000, 60_000), (2, 0, 0), (3, 0, 0), (4, 0, 0), (1, 4, 0)} <= kept
    assert repeated_windows.remove_repeated(none).count() == 0


# ---- vector codes

def brute_codes(rows, parts=16, entries=64, rounds=2):
    rows = [(k, v, lab) for k, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    whole = [[int(np.floor(256 * float(x))) for x in v] for _, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, whole[i]))
    n = len(whole[order[0]])
    w = n // parts
    cut = lambda v, p: v[p * w:(p + 1) * w]
    order = [i for i in order if len(whole[i]) == n]
    books = [[cut(whole[i], p) for i in order[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            held = defaultdict(list)
            for i in order:
                held[near(cut(whole[i], p), book)[1]].append(cut(whole[i], p))
            books[p] = [[sum(c) // len(held[e]) for c in zip(*held[e])] if held[e] else book[e] for e in range(len(book))]
    out, total = [], defaultdict(int)
    for i in range(len(rows)):
        if len(whole[i]) != n:
            out.append((rows[i][0], None, None, rows[i][2]))
            continue
        found = [near(cut(whole[i], p), books[p]) for p in range(parts)]
        out.append((rows[i][0], "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), rows[i][2]))
        total[rows[i][2]] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((k, c, e, total[lab] if lab in total else None, digest) for k, c, e, lab in out), key=key)


def vectors(n, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.6, (9, 32))
    rows = [(int(i), [float(np.float32(x)) for x in centres[i % 9] + rng.normal(0, 0.15, 32)], int(i % 4) if i % 5 else None) for i in range(n)]
    return rows


def test_codes_query_against_brute_force(spark, tmp_path):
    rows = vectors(180)
    bad = [(500, None, 1), (501, [None] * 32, 1), (502, [float("nan")] * 32, 2), (-3, [float("inf")] * 32, 2), (503, rows[3][1], 3), (503, rows[3][1], 3),
           (None, rows[4][1], None), (504, [0.0] * 32, None), (505, [1.0] * 7, 1), (506, [], 1)]
    bad += [(600 + i, [0.25] * 32, 0) for i in range(90)]
    at = written(spark, tmp_path, "embeddings", rows + bad, "vec_id long, embedding array<float>, label int")
    found = queries.op11_vector_codes(spark, at).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert sorted((tuple(r) for r in found.collect()), key=key) == brute_codes(rows + bad)


def test_ball_search_equals_full_search_with_ties_and_less_work():
    rng = np.random.default_rng(8)
    for spread, size in ((2, 40), (50, 64), (400, 64)):
        book = rng.integers(-spread, spread, (size, 4))
        book[5] = book[3]
        parts = np.concatenate([book[rng.integers(0, size, 3000)] + rng.integers(-2, 3, (3000, 4)), rng.integers(-spread, spread, (500, 4))])
        before, _ = vector_codes.full_search(parts, book)
        moved = book + rng.integers(-1, 2, book.shape)
        for old in (before, rng.integers(0, size, len(parts))):
            code, far, compared = vector_codes.ball_search(parts, moved, old)
            want, near = vector_codes.full_search(parts, moved)
            assert (code == want).all() and (far == near).all()
        if spread == 400:
            _, _, compared = vector_codes.ball_search(parts, moved, before)
            assert compared < 0.2 * len(parts) * size


def test_codes_of_few_rows_and_clashes(spark):
    schema = "vec_id long, embedding array<float>, label int, whole string, row string, coded string, code string"
    df = spark.createDataFrame([(2, [1.0] * 16, 1, "a", "b", "c", "d"), (1, [-0.5] * 16, None, "a", "b", "c", "d")], schema)
    out, books = vector_codes.product_codes(df)
    assert books.shape == (16, 2, 1) and out.columns == ["vec_id", "embedding", "label", "whole", "row", "code", "coded"]
    assert {r["vec_id"]: (bytes(r["coded"]["code"]), r["coded"]["error"]) for r in out.collect()} == {1: (bytes(16), 0), 2: (b"\x01" * 16, 0)}
    out, books = vector_codes.product_codes(df.limit(0))
    assert out.count() == 0 and books.size == 0
    only_null = df.withColumn("embedding", F.lit(None).cast("array<float>"))
    assert vector_codes.product_codes(only_null)[0].count() == 0
    with pytest.raises(Exception, match="too large"):
        vector_codes.product_codes(df.withColumn("embedding", F.array_repeat(F.lit(1e30), 16)))[0].collect()


# ---- spaced seeds

def test_masks_miss_no_acceptable_pattern_of_changes():
    """Every pattern of changed tokens that the rule accepts leaves a window of some mask untouched; all are tried."""
    from itertools import combinations

    from anchorkit.llm.decontamination import MASKS, MIN_EQUAL, SPAN

    for n in range(SPAN, 24):
        windows = [sum(1 << (at + i) for i, sign in enumerate(m) if sign == "1") for m in MASKS for at in range(n - len(m) + 1)]
        for changed in range(1, n // 5 + 1):
            if n - changed < min(MIN_EQUAL, -(-4 * n // 5)):
                continue
            for places in combinations(range(n), changed):
                gone = sum(1 << p for p in places)
                assert any(not w & gone for w in windows), (n, places)
    # a longer stretch with a fifth changed has a part of 12 tokens with 2, or of 15 with 3 changes at most
    for n in range(24, 200):
        changed = n // 5
        parts = [n // k for k in range(2, n // 12 + 1) if n // k >= 12]
        assert any(changed // (n // size) <= (2 if size < 15 else 3) for size in parts)


# ---- earlier queries, through their own columns

@pytest.fixture(scope="module")
def small_documents(spark, tmp_path_factory):
    rng = np.random.default_rng(6)
    words = ["alpha", "Été", "日本語", "😀", "don't", "x" * 40, "can", "<|endoftext|>", "▁", "  ", "\n\n", "12345"]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 60))))) for i in range(40)]
    rows += [(40, None), (41, ""), (42, " \n"), (42, " \n"), (None, "no key"), (43, "word " * 3000), (44, "é" * 70 + " tail")]
    folder = tmp_path_factory.mktemp("docs")
    return written(spark, folder, "documents", rows, "doc_id long, text string"), rows


def test_token_query_against_the_library(spark, small_documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    at, rows = small_documents
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [(k, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in rows]
    got = [tuple(r) for r in queries.op3_token_counts(spark, at).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()]
    assert sorted(got, key=key) == sorted(((*w, w[2] > 1024) for w in want), key=key)


def test_piece_query_against_the_library(spark, small_documents):
    import public_tokenizers
    import sentencepiece

    at, rows = small_documents
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for k, t in rows:
        ids = library.encode(t or "", add_bos=False, add_eos=True)
        want.append((k, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    got = [tuple(r) for r in queries.op9_piece_spans(spark, at).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_shard_query_columns(spark, small_documents):
    at, rows = small_documents
    out = queries.op10_exact_shards(spark, at).collect()
    own = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in out), key=key) == sorted(((k, *own(t)) for k, t in rows), key=key)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1 and {r["law"] for r in out} == {"rows"} and {r["grown_shard"] for r in out} == {None}


def test_short_merges_equal_the_library_on_rare_segments(spark):
    """Segments of strange characters, long runs of marks and pieces of one score leave the numbers' way."""
    import public_tokenizers
    import sentencepiece

    from anchorkit.llm.piece_spans import Pieces

    path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        own = Pieces(f.read())
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = np.random.default_rng(3)
    letters = list("abcdefghijklmnopqrstuvwxyzéèçü") + ["▁", "ก", "中", "\n", "-", "1"]
    texts = ["".join(rng.choice(letters, int(rng.integers(1, 90)))) for _ in range(2000)]
    texts += ["▁" * n for n in range(1, 40)] + [" " * n + "x" for n in range(40)] + ["a" * n for n in range(1, 130)]
    for t in texts:
        ids, _ = own.encode(t)
        assert ids.tolist() == library.encode(t)
        assert own.decode(ids) == library.decode(ids.tolist())
