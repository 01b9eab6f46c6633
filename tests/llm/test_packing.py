"""Packing: every id in one piece, sequences without gaps or padding, ids as the library's, least squares against a small exact search."""

import itertools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tarnwood.llm.packing import END, Ids, Plan, combinations, op11_nnls_packing, pack, repeats

PATH = public_tokenizers.path("word_bpe_49k.json")


def truth(texts):
    t = Tokenizer.from_file(PATH)
    return [[*t.encode(x or "", add_special_tokens=False).ids, END] for x in texts]


def check_sequences(pieces, window):
    """pieces: (sequence, offset, length). The padding of each sequence that is neither full nor a power of two."""
    by = defaultdict(list)
    for seq, off, n in pieces:
        by[seq].append((off, n))
    pad = 0
    for some in by.values():
        at = 0
        for off, n in sorted(some):
            assert off == at and n > 0
            at += n
        assert at <= window
        pad += window - at if at & (at - 1) else 0
    return pad


def check_documents(rows, ids, window):
    docs = defaultdict(list)
    for r in rows:
        docs[r.doc_id].append((r.start, r.length, r.doc_tokens, r.ids))
    assert set(docs) == set(ids)
    for i, some in docs.items():
        at = 0
        for start, n, total, packed in sorted(some):
            assert start == at and total == len(ids[i]) and list(np.frombuffer(packed, dtype="<u4")) == ids[i][start : start + n]
            at += n
        assert at == len(ids[i])
    assert check_sequences([(r.sequence_id, r.offset, r.length) for r in rows], window) == 0


TEXTS = [None, "", " \n", "Hello, World!", "it's 12 O'Clock DON'T", "café NAÏVE ÀÉ ß İ Σας ΟΔΟΣ", "é Å x́y", "日本語 text", "<|endoftext|> and <|startoftext|>x", "a\x1cb \x00 c d", "Hello, World!", "z" * 500, "many words here " * 900, "🙂 ok", "×÷ Æ ñ"]


def test_odd_texts(docs):
    for window in (16, 256, 4096):
        rows = pack(docs(*TEXTS), PATH, window=window).collect()
        check_documents(rows, dict(enumerate(truth(TEXTS))), window)


def test_null_ids_and_repeated_rows(docs):
    rows = pack(docs("one two", "one two", "three", ids=[None, None, 5]), PATH).collect()
    assert sorted((str(r.doc_id), r.doc_tokens) for r in rows) == [("5", 2), ("None", 3), ("None", 3)]
    assert pack(docs("x").where("doc_id < 0"), PATH).collect() == []


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    ids = dict(zip([r.doc_id for r in docs], truth([r.text for r in docs]), strict=True))
    rows = op11_nnls_packing(spark, sf).collect()
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes())
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    assert check_sequences([(r.sequence_id, r.offset, r.length) for r in rows], 4096) == 0
    assert len(rows) < 1.2 * len(docs) + len(rows) * 0 + sum(len(x) // 4096 for x in ids.values())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("abSt 'é1.,É<|> "), max_size=20), max_size=4))
def test_ids_are_the_librarys(texts):
    coder = Ids(PATH) if not hasattr(test_ids_are_the_librarys, "coder") else test_ids_are_the_librarys.coder
    test_ids_are_the_librarys.coder = coder
    got = [[*np.frombuffer(x, dtype=coder.kind).tolist(), END] for x in coder.of_batch([t.encode() for t in texts])]
    assert got == truth(texts)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 31), st.integers(1, 40), max_size=12))
def test_plan_places_each_document_once(histogram):
    p = Plan(histogram, window=32, steps=20)
    pieces = [(seq, off, n) for length, count in histogram.items() for k in range(count) for _, n, seq, off in p.place(length, k)]
    assert check_sequences(pieces, 32) == 0
    assert sum(n for _, _, n in pieces) == sum(a * b for a, b in histogram.items())
    assert {s for s, _, _ in pieces} == set(range(p.count))
    # documents are cut in the line only, one at each end of a window or of a power of two
    cut = sum(len(p.place(length, k)) - 1 for length, count in histogram.items() for k in range(count))
    assert cut <= p.count - p.sequences


def test_combinations_fill_the_window():
    h = np.zeros(16, dtype=np.int64)
    h[[2, 3, 5, 8]] = [4, 9, 2, 2]
    lengths, times = combinations(h, 16)
    got = {tuple(sorted((int(a), int(m)) for a, m in zip(x, y, strict=True) if m)) for x, y in zip(lengths, times, strict=True)}
    want = set()
    for a, b in itertools.combinations([2, 3, 5, 8], 2):
        for i, j in itertools.product(range(10), repeat=2):
            if i * a + j * b == 16 and i <= h[a] and j <= h[b]:
                want.add(tuple(sorted((n, m) for n, m in ((a, i), (b, j)) if m)))
    want |= {tuple((n, 1) for n in c) for c in itertools.combinations([2, 3, 5, 8], 3) if sum(c) == 16}
    assert got == want


def test_repeats_solve_least_squares():
    rng = np.random.default_rng(5)
    h = np.zeros(16, dtype=np.int64)
    h[[1, 3, 4, 6, 10, 12]] = [40, 30, 20, 25, 18, 9]
    lengths, times = combinations(h, 16)
    a = np.zeros((16, len(lengths)))
    for c in range(3):
        np.add.at(a, (lengths[:, c], np.arange(len(lengths))), times[:, c])
    x = repeats(lengths, times, h, 3000)
    best = np.square(a @ x - h).sum()
    assert (x >= 0).all()
    gradient = a.T @ (a @ x - h)
    assert (gradient > -1).all() and abs(gradient @ x) < 1 + 1e-3 * h.sum()  # the optimum's conditions
    for _ in range(200):
        assert np.square(a @ np.abs(x + rng.normal(0, 1, len(x))) - h).sum() >= best - 1
