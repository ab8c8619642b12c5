"""Corpus encoding, packing and pieces: against the tokenizer itself, by limits, and by exact round trips."""

from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lumenpage.llm import packing, pieces, tokens

TEXTS = [
    "", None, " ", "\n\n\n", "a", "def f(x):\n    return x  # ½ ² Ⅷ\n\n\nclass A:\n\tpass\n", "<|endoftext|> is text", "naïve café — “quoted” 日本語のテキスト 👩‍🔧", "﻿BOM\r\nline\r\n", "x" * 5000,
    "word " * 3000, "\x1c\x1d sep \x85 nel\xa0nbsp", "0123456789" * 400, "\x00\x01 control", "it's we'll they've I'm you're he'd", "// header\n// licence\n\nint main() { return 0; }\n" * 40,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "extra") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + rows[:6], "doc_id long, text string, ids string")


@pytest.mark.parametrize("head", [1_000_000, 60, 3])
def test_ids(spark, docs, head):
    enc = tokens.encoder()
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(docs, "doc_id", "text", head=head).collect()}
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    assert tokens.encode_corpus(docs.limit(0), "doc_id", "text").count() == 0


def test_decode(spark, docs):
    ids = tokens.encode_corpus(docs, "doc_id", "text")
    assert {r.doc_id: r.text for r in tokens.decode_corpus(ids, "doc_id", "ids").collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_words_join_and_encode(text):
    words = tokens.split_words(text)
    enc = tokens.encoder()
    assert "".join(words) == text
    assert [i for w in words for i in enc._encode_single_piece(w)] == enc.encode_ordinary(text)


def test_pack_limits():
    rng = np.random.default_rng(1)
    sizes = np.stack([rng.integers(0, 100, 500), np.ones(500), rng.integers(0, 60, 500)], axis=1).astype(float)
    limits = np.array([100.0, 5.0, 90.0])
    bins = packing.dot_product_pack(sizes, limits)
    used = np.zeros((bins.max() + 1, 3))
    np.add.at(used, bins, sizes)
    assert (bins >= 0).all() and (used <= limits + 1e-9).all()
    assert bins.max() + 1 <= 1.1 * max(np.ceil(sizes.sum(axis=0) / limits))


def test_pack_rows(spark, docs):
    sizes = packing.item_sizes(docs, "doc_id", "text")
    enc = tokens.encoder()
    assert {r.doc_id: r.tokens for r in sizes.collect()} == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(TEXTS)}
    rows = packing.pack(packing.as_items(sizes, "doc_id", 500, 480), "doc_id", capacity=500, segments=6, loss=480, shard=8).collect()
    used = defaultdict(lambda: [0, 0, 0])
    per = defaultdict(int)
    for r in rows:
        for k, v in enumerate((r.n_tokens, 1, r.loss_tokens)):
            used[r.bin_id][k] += v
        per[r.doc_id] += r.n_tokens
    assert all(a <= 500 and b <= 6 and c <= 480 for a, b, c in used.values())
    assert per == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(TEXTS)} and len({(r.doc_id, r.part_no) for r in rows}) == len(rows)
    assert packing.pack(packing.as_items(sizes.limit(0), "doc_id", 500, 480), "doc_id").count() == 0


@pytest.mark.parametrize("limit,overlap,chunk", [(1024, 64, 65536), (200, 20, 700), (120, 0, 500)])
def test_pieces(spark, docs, limit, overlap, chunk):
    enc = tokens.encoder()
    by = defaultdict(list)
    for r in pieces.cut_pieces(docs, "doc_id", "text", limit=limit, overlap=overlap, chunk=chunk).collect():
        by[r.doc_id].append(r)
    for i, t in enumerate(TEXTS):
        ps = sorted(by[i], key=lambda r: (r.piece_no, r.part))
        assert "".join(p.text[p.overlap_chars :] for p in ps) == (t or "")
        for a, p in zip([None, *ps], ps):
            n = len(enc.encode_ordinary(p.text))
            assert n == p.n_tokens <= limit
            assert (t or "")[p.start_char : p.end_char] == p.text
            if a is not None:
                assert a.text.endswith(p.text[: p.overlap_chars]) or p.overlap_chars > len(a.text)
    assert pieces.cut_pieces(docs.limit(0), "doc_id", "text").count() == 0


def test_pieces_about_the_limit(spark):
    """A text of 1,024 tokens or fewer stays whole, also if its tokens are long; a longer one gives about as few pieces as can be."""
    enc = tokens.encoder()
    rows = [(n, " a" * n) for n in range(1012, 1030)] + [(1, " " * 70_000 + "x"), (2, ("-" * 64 + "\n") * 300)] + [(9000 + n, "Some words. And more of them here.\n" * n) for n in (200, 1000, 5000)]
    by = defaultdict(list)
    for r in pieces.cut_pieces(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect():
        by[r.doc_id].append(r)
    for i, t in rows:
        n = len(enc.encode_ordinary(t))
        assert max(r.n_tokens for r in by[i]) <= 1024 and (len(by[i]) == 1) == (n <= 1024)
        assert len(by[i]) <= max(1, 1.05 * -(-(n - 64) // 960) + 1)
    assert {r.cut_at for r in by[14000]} <= {"section", "line", "blank line"}


def test_pieces_of_spans(spark, monkeypatch):
    """A text of many spans, each cut by itself, still joins up."""
    monkeypatch.setattr(pieces, "SPAN", 2)
    text = "".join(f"Line {i} of a long file, with some words; 日本語 {i}.\n" for i in range(3000))
    rows = sorted(pieces.cut_pieces(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id", "text", chunk=2000).collect(), key=lambda r: (r.piece_no, r.part))
    assert "".join(r.text[r.overlap_chars :] for r in rows) == text and max(r.n_tokens for r in rows) <= 1024


def test_limits_bind(spark):
    """On the driver's texts each limit decides: packed without it, some container would break it."""
    sizes = packing.item_sizes(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"), "doc_id", "text")
    rows = packing.as_items(sizes, "doc_id", packing.CAPACITY, packing.LOSS).collect()
    x = np.array([(r.n_tokens, 1, r.loss_tokens) for r in rows], dtype=float)
    limits = np.array([packing.CAPACITY, packing.SEGMENTS, packing.LOSS], dtype=float)
    used = lambda bins: np.stack([np.bincount(bins, x[:, k]) for k in range(3)], axis=1)
    packed = used(packing.dot_product_pack(x, limits))
    assert (packed <= limits).all() and len(packed) <= 1.01 * max(np.ceil(x.sum(axis=0) / limits)) + 1
    for k in range(3):
        free = limits.copy()
        free[k] = 1e9
        assert (used(packing.dot_product_pack(x, free))[:, k] > limits[k]).any()
