"""Token counts, pieces and page texts against the public libraries or hand-made cases."""

import random
import sys

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from anchorkit.llm import decontamination, html_text, piece_spans, slices, token_counts, word_arrays

ODD = ["", " ", "   x", "'s'S 's''re 'rx we'll 'lx", "don't  we \n\n x\n y  ", "\t'tis\x0b\x0c", "<|endoftext|>a<|endoftext|> <|endoftext|>",
       "日本語 テスト　全角", "😀😀 é à ²³½ a1b2 3c'd", "''s", "\x00\x01 \x1c\x1f \x85", "a" * 3000, " " * 700 + "x", "'s" * 300, "▁ ▁▁ a▁b", "x " * 2000]


def many(seed):
    rng = random.Random(seed)
    return ODD + ["".join(rng.choice("abst'revlmd 12 \n\t .,!é▁'  ") for _ in range(rng.randint(0, 50))) for _ in range(800)] + [
        "".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x3000), rng.randint(0x1F000, 0x1FAFF), 32, 10])) for _ in range(30))
        for _ in range(300)]


@pytest.fixture(scope="module")
def definition():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


@pytest.mark.parametrize("max_states", [1 << 16, 50])
def test_token_counts(definition, max_states):
    texts = many(1) if max_states > 50 else many(1)[:60]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    counter = token_counts.TokenCounter(definition, max_states)
    assert counter.counts(texts).tolist() == want
    assert counter.counts([""]).tolist() == [0]


def test_chunk_maps_compose():
    to, out = token_counts._tables()
    rng = np.random.default_rng(2)
    classes = (rng.integers(0, 15, 5000) * 16).astype(np.uint8)
    state, marks = token_counts.FRESH, []
    for c in classes:
        marks.append(out[state + c])
        state = to[state + c]
    want = (np.array(marks) & 1).astype(bool)
    want[:-1] |= np.array(marks)[1:] > 1
    for chunk in (1, 7, 512, 6000):
        assert (token_counts.borders(classes, to, out, chunk) == want).all()


@pytest.fixture(scope="module")
def pieces():
    path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return piece_spans.Pieces(f.read(), remembered=100), sentencepiece.SentencePieceProcessor(model_file=path)


def test_pieces_spans_and_decoding(pieces):
    own, library = pieces
    for text in many(2):
        ids, ends = own.encode(text)
        proto = library.encode(text, return_type="proto")
        assert ids.tolist() == [p.id for p in proto.pieces] and ends.tolist() == [p.end for p in proto.pieces], text
        assert own.decode(ids) == library.decode(ids.tolist())
    rng = random.Random(3)
    for _ in range(500):
        ids = [rng.randint(0, 500) for _ in range(rng.randint(0, 9))]
        assert own.decode(np.array(ids, np.int32)) == library.decode(ids), ids


def model_bytes():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def test_remembered_segments_stay_small():
    """Texts of ever new words fill no more than some 50 MB of a worker."""
    own = piece_spans.Pieces(model_bytes())
    own._encode = lambda segment: b"\0" * 32  # four pieces; how they are found is of no matter here
    for begin in range(0, 400_000, 1000):
        own.encode(" ".join(f"word{i}" for i in range(begin, begin + 1000)))
    kept = [own._young, own._old]
    assert sum(map(sys.getsizeof, kept)) + sum(sys.getsizeof(x) for held in kept for pair in held.items() for x in pair) < 60e6


def test_operators_let_go_what_others_keep_in_a_worker():
    model = model_bytes()
    decontamination.token_hashes(pa.array(["one two three"]))
    list(decontamination._seeds(iter([])))
    assert decontamination._token_hash.cache_info().currsize
    own = piece_spans.loaded(model)
    assert not decontamination._token_hash.cache_info().currsize
    assert piece_spans.loaded(model) is own
    list(decontamination._seeds(iter([])))
    assert not piece_spans._LOADED
    assert piece_spans.loaded(model) is not own
    slices.alone("another")
    assert not piece_spans._LOADED


def test_pieces_are_kept_from_task_to_task(spark):
    """A worker reads the model once, not for every task."""
    docs = spark.range(0, 64, 1, 64).selectExpr("id as doc_id", "concat('a text of number ', id) as text")
    piece_spans.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")).write.format("noop").mode("overwrite").save()

    def held(batches):
        from anchorkit.llm import piece_spans as module

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"held": pa.array([len(module._LOADED)], pa.int64())})

    assert any(r["held"] for r in spark.range(0, 64, 1, 64).mapInArrow(held, "held long").collect())


def test_general_normaliser_agrees_with_the_short_way(pieces):
    own, _ = pieces
    for text in ODD:
        body, source = own.normalise(text)
        assert body == (("▁" if text else "") + text.replace(" ", "▁")) and source[-1] == len(text.encode())


def charsmap(rules):
    """A double-array trie for a few one-byte keys, laid out as the format asks."""
    strings, values = b"", {}
    for key, to in rules.items():
        values[key] = len(strings)
        strings += to.encode() + b"\0"
    units = [0] * 1024
    units[0] = 1 << 10 | 0  # children of the root at 1 ^ label
    for n, (key, value) in enumerate(values.items()):
        node, leaf = 1 ^ key, 256 + 2 * n
        units[node] = (node ^ leaf) << 10 | 1 << 8 | key
        units[leaf] = 1 << 31 | value
    data = b"".join(u.to_bytes(4, "little") for u in units)
    return len(data).to_bytes(4, "little") + data + strings


def test_character_map_longest_prefix_and_alignment(pieces):
    own, _ = pieces
    table = piece_spans.CharacterMap(charsmap({ord("A"): "a", ord("~"): "", ord("&"): "and"}))
    assert table.longest(b"xA&", 1) == (1, b"a") and table.longest(b"x", 0) is None and not piece_spans.CharacterMap(b"")
    held, own.map = own.map, table
    try:
        body, source = own.normalise("A~é&")
        assert body == "▁aéand" and source.tolist() == [0, 0, 2, 4, 4, 4, 5]
        ids, ends = own.encode("A~é&")
        assert ends[-1] == 5 and (np.diff(ends) >= 0).all()
    finally:
        own.map = held


def test_operators_on_odd_rows(spark, odd, none):
    path, model = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    counted = token_counts.count_tokens(odd, path, to="count").collect()
    library = Tokenizer.from_file(path)
    assert len(counted) == odd.count()
    assert all(r["count"] == len(library.encode(r.text or "", add_special_tokens=False).ids) for r in counted)
    encoded = piece_spans.encode_decode(odd, model, to="enc").collect()
    processor = sentencepiece.SentencePieceProcessor(model_file=model)
    for r in encoded:
        want = processor.encode(r.text or "", add_eos=True)
        assert r.enc.ids == want and r.enc.decoded == processor.decode(want) and r.enc.ends[-1] == len((r.text or "").encode())
    assert token_counts.count_tokens(none, path).count() == 0 and piece_spans.encode_decode(none, model).count() == 0


def test_slices_and_words():
    texts = pa.array(["A b", None, "", "  \tÉ x\x1c", "z" * 100])
    assert [len(p) for p in slices.slices(texts, 4)] == [3, 1, 1]
    words, bounds = word_arrays.word_arrays(texts[1:])
    assert [w.decode() for w in words.to_pylist()] == ["É", "x\x1c", "z" * 100] and bounds.tolist() == [0, 0, 0, 2, 3]


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("<p>", ""), ("plain &lt; text", "plain < text"),
    ("<body><nav><a href=x>Menu, a, b, c</a></nav><article><h1>T</h1><p>One,\n two<br>three.<p>Four</article><footer>F, f, f</footer>", "T\n\nOne, two three.\n\nFour"),
    ("<div class='ad'>Buy, buy, buy, buy</div><div id=main><p>Real, text here.</p></div><div class=comments><p>a, b, c, d, e, f</p></div>", "Real, text here."),
    ("<div><div><p>One, two.</p></div><div><p>Three, four.</p></div></div>", "One, two.\n\nThree, four."),
    ("<script>var t='</p>';</script><style>p{}</style><p>x, y &amp; z</p><form><input><p>sign, up, now, please</p></form>", "x, y & z"),
    ("<header>Site, name</header><main><header><h1>Title</h1></header><p>Body</p><ul><li><a>l1</a><li><a>l2</a><li><a>l3</a></ul></main><aside>s</aside>", "Title\n\nBody"),
    ("<div class='site-header'>Name, of, site</div><div class='content with-sidebar'><div class='post-header'><h2>Head</h2></div><p>Text, here.</p></div>"
     "<div class=sidebarLeft>x, y, z</div><section id=comments><p>c, c, c, c, c, c</p></section>", "Head\n\nText, here."),
    ("<p><b>bold <p>next</p> tail", "bold\n\nnext\n\ntail"), ("<p hidden>a, b</p><p>c&nbsp;&nbsp;d</p><!-- x --> <p title='>'>e</p>", "c d\n\ne"),
    ("<div>" * 5000 + "deep, text" + "</div>" * 5000, "deep, text"),
])
def test_main_text(page, want):
    assert html_text.main_text(page) == want


PARAGRAPHS = [f"Paragraph {k}, with a few words, and some more of them, that tell what happened." for k in range(6)]
BODY, STORY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS), "\n\n".join(PARAGRAPHS)
MENU = "<div class=menu><ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul></div>"


@pytest.mark.parametrize("page", [
    f"<body>{MENU}<div class='content-sidebar-wrap'><main><article>{BODY}</article></main><aside>Side, a, b</aside></div></body>",
    f"<body>{MENU}<div class='widget'><article>{BODY}</article></div><div class=footer>Imprint, phone, mail</div></body>",
    f"<body><form id=aspnetForm>{MENU}<div>{BODY}</div></form><div class=footer>Imprint, phone</div></body>",
    f"<body><form id=aspnetForm>{MENU}<div>{BODY}</div></form><div><p>Imprint, phone, mail.</p></div></body>",
    f"<body>{MENU}<div class='notice search'>{BODY}<div class=share>Share, like</div></div><div class=footer>Imprint.</div></body>",
    f"<article>{BODY}</article><div class=related><article><p>Another, story, to read.</p></article></div>",
    f"<div>{BODY}</div><div class=comments>{BODY * 5}</div><div class=sidebar><p>Side, a, b</p></div>",
])
def test_names_and_forms_drop_no_article(page):
    assert html_text.main_text(page) == STORY


def test_extract_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "<p>a</p>", "y"), (None, "", "z")], "page_id long, html string, text_own string")
    rows = html_text.extract(df).collect()
    assert sorted((r.text, r.text_own) for r in rows) == [("", "x"), ("", "z"), ("a", "y")]
    assert html_text.extract(df.limit(0)).count() == 0
