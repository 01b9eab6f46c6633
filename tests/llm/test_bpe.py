import base64
import copy
import hashlib
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwood.llm.bpe import PairTable, coder, decode, encode, public_vocabulary, round_trip

TEXTS = ["", None, "Hello world's", "a" * 3000, " " * 700 + "x", "é" * 400, "日本語 テキスト 😀😀", "ab\n\n  cd\t\te'll", "x1y22z333 " * 50, "\u0000\u0001", "den den der", "<|endoftext|>"]


@pytest.fixture(scope="module")
def truth():
    path, pattern = public_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def as_bytes(ids):
    return np.array(ids, dtype="<u4").tobytes()


def test_texts_encode_as_the_library_does(docs, truth):
    for r in round_trip(docs(*TEXTS), *public_vocabulary()).collect():
        t = TEXTS[r.doc_id] or ""
        ids = truth.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(as_bytes(ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_encode_then_decode(docs):
    v = public_vocabulary()
    got = {r.doc_id: bytes(r.bytes).decode() for r in decode(encode(docs(*TEXTS), *v), *v).collect()}
    assert got == {i: t or "" for i, t in enumerate(TEXTS)}


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_any_text(truth, text):
    c = coder(*public_vocabulary())
    (ids,) = c.encode([text])
    assert ids == as_bytes(truth.encode_ordinary(text))
    assert c.decode(ids) == text.encode()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abetnrsé", min_size=1, max_size=9), min_size=1, max_size=6), st.integers(1, 400), st.randoms(use_true_random=False))
def test_long_pieces(truth, parts, times, rng):
    """Letters alone are one piece: thousands of bytes in one row."""
    c = coder(*public_vocabulary())
    for text in ("".join(parts) * times, "".join(rng.choice(parts) for _ in range(2 * times))):
        assert c.encode([text]) == [as_bytes(truth.encode_ordinary(text))]


def test_a_piece_of_a_hundred_thousand_bytes(truth):
    rng = random.Random(5)
    c = coder(*public_vocabulary())
    for text in ("".join(rng.choice("etaoinshrdlu") for _ in range(100_000)), "ab" * 50_000, "z" * 99_999):
        assert c.encode([text]) == [as_bytes(truth.encode_ordinary(text))]


def test_a_merge_that_brings_a_lower_rank():
    """bc ranks after abc, which a and bc make: all places of bc at once would be wrong."""
    c = coder(*public_vocabulary())
    own = copy.copy(c)
    a, b, x = 0, 1, 2
    own.pairs = {(b, x): 20, (a, 20): 10, (20, a): 15, (10, 10): 30}
    own.table = PairTable(own.pairs)
    own.settled = np.ones(40, dtype=bool)
    own.settled[20] = False
    own.single = np.arange(256, dtype=np.int32)

    def slow(ids):
        while True:
            r, i = min(((own.pairs.get((ids[i], ids[i + 1]), 99), i) for i in range(len(ids) - 1)), default=(99, 0))
            if r == 99:
                return ids
            ids = [*ids[:i], r, *ids[i + 2 :]]

    rng = random.Random(1)
    for _ in range(200):
        raw = bytes(rng.choice((a, b, x, b, x)) for _ in range(rng.randint(1, 200)))
        assert own.by_row(raw) == as_bytes(slow(list(raw))) == own.by_matrix([raw], 256)[0]


def test_empty_table(docs):
    assert round_trip(docs(), *public_vocabulary()).collect() == []
