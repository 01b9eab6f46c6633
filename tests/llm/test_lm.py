import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from tarnwood.llm import lm
from tarnwood.llm.lm import bucket_filter, bucket_of, op9_lm_bloom, score, taken, train


def toks(t):
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] + ["end"]


def brute(rows):
    """base columns of (doc_id, text)s."""
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    c = Counter(w for i, t in rows if not held[i] for w in toks(t))
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(toks(t)), sum(c[w] > 0 for w in toks(t)), n, sum(log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks(t))) for i, t in rows}


def check(got, rows):
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9)


@pytest.fixture
def sf(spark, tmp_path):
    def make(df):
        df.write.parquet(str(tmp_path / "documents.parquet"))
        return str(tmp_path)

    return make


def test_base_is_exact_whatever_is_broadcast(docs, sf, spark, monkeypatch):
    monkeypatch.setattr(lm, "COMMON", 3)
    monkeypatch.setattr(lm, "SHARD_BYTES", 40)
    texts = [None, "", "a b a", "the the The the", "x " * 5000, *(f"w{i % 7} u{i} the and of" for i in range(60)), " \t\n"]
    one = op9_lm_bloom(spark, sf(docs(*texts))).collect()
    check(one, list(enumerate(texts)))
    assert all(r.score < 0 for r in one)


def test_shards_add_up(docs, monkeypatch):
    df = docs(*(f"the cat{i % 5} sat on mat{i % 3}" for i in range(50)))
    model = train(df)
    a = sorted((r.doc_id, r.score) for r in score(df, model).collect())
    monkeypatch.setattr(lm, "SHARD_BYTES", 30)
    assert len(list(lm._shards(model))) > 1
    b = sorted((r.doc_id, r.score) for r in score(df, model).collect())
    assert [x[0] for x in a] == [x[0] for x in b] and [x[1] for x in a] == pytest.approx([x[1] for x in b])


def shard_of(bits):
    z, none = np.zeros(1, np.int64), np.array([], np.uint64)
    return lm.Shard(none, np.array([]), np.array([]), z, np.array([len(bits)]), bits, 1.0, 1.0, none, 1.0, 0.0)


def test_counts_are_never_too_low():
    rng = np.random.RandomState(1)
    keys = np.unique(rng.randint(0, 2**63, 4000, dtype=np.int64).astype(np.uint64) << np.uint64(1))
    counts = rng.randint(1, 3000, len(keys))
    bits = bucket_filter(keys, counts)
    s = shard_of(bits)
    got = s.count(keys, np.zeros(len(keys), np.int64))
    q = 2 ** np.floor(np.log2(counts))
    assert (got >= q).all() and (got == q).mean() > 0.97
    absent = s.count(keys + np.uint64(1), np.zeros(len(keys), np.int64))
    assert (absent > 0).mean() == pytest.approx(taken(bits), abs=0.01) and taken(bits) < 0.02
    assert bucket_of(keys, 7).max() < 7


def pair(model, v, w):
    v, w = (np.array([lm.START if x is None else lm.tokens(x)[0]]) for x in (v, w))
    return lm.pair_keys(v, w, model.hot)


def test_pairs_seen_once_are_held(docs):
    model = train(docs("b c", *["a b", "c d"] * 3))
    (s,) = lm._shards(model)
    keys = pair(model, b"b", b"c")
    assert s.count(keys, bucket_of(keys, model.buckets)).tolist() == [1.0]
    got = {r.doc_id: r.score for r in score(docs("b c", "b a"), model).collect()}
    assert got[0] > got[1] + 0.1


TEXTS = ["the cat sat on the mat", "the cat sat", "the dog sat on the cat", "a dog", "", "the the the cat"] * 3 + [f"the u{i} sat" for i in range(30)]


def model_by_hand(texts):
    """(c, N, V, T, q) by counting; q as counts are quantised."""
    c, pairs = Counter(), Counter()
    for t in texts:
        seq = toks(t)
        c.update(seq)
        pairs.update(zip([None, *seq[:-1]], seq, strict=True))
    q = {p: 2 ** (n.bit_length() - 1) for p, n in pairs.items()}
    sums = Counter()
    for (v, _), x in q.items():
        sums[v] += x
    return c, sum(c.values()), len(c), sums, q


def p_by_hand(model, v, w, noise, q_of=None):
    c, n, types, sums, q = model
    t = sums[v]
    lam = t / (t + noise + lm.DAMP)
    x = q.get((v, w), 0) if q_of is None else q_of(v, w)
    return lam * min(t, x) / max(t + noise, 1.0) + (1 - lam) * (c[w] + 0.5) / (n + 0.5 * (types + 1))


@pytest.mark.parametrize(("hot", "common", "shard_bytes"), [(512, 500_000, 64_000_000), (1, 3, 64), (1, 500_000, 64)])
def test_scores_against_a_model_by_hand(docs, monkeypatch, hot, common, shard_bytes):
    monkeypatch.setattr(lm, "HOT", hot)
    monkeypatch.setattr(lm, "COMMON", common)
    monkeypatch.setattr(lm, "SHARD_BYTES", shard_bytes)
    model, hand = train(docs(*TEXTS), bits_each=40_000), model_by_hand(TEXTS)  # so roomy that no absent pair is taken for present
    assert model.start == hand[3][None] and model.taken < 1e-6
    new = [*TEXTS, "the zebra sat on a u7", "u1 u2 zz", None]
    for r in score(docs(*new), model).collect():
        seq = toks(new[r.doc_id])
        want = sum(log10(p_by_hand(hand, v, w, model.noise)) for v, w in zip([None, *seq[:-1]], seq, strict=True))
        assert r.score == pytest.approx(want, rel=1e-9)


def test_probabilities_add_up_to_one(docs):
    """Over all words, the end and an unknown one, after every context: as counted, and with the filter's own answers on average."""
    hand = model_by_hand(TEXTS)
    words = [*hand[0], b"never seen"]
    for v in [None, *(w for w in hand[0] if w != "end"), b"never seen"]:
        assert sum(p_by_hand(hand, v, w, 0.0) for w in words) == pytest.approx(1)
    rng = random.Random(4)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7)) % 700}" for _ in range(60)) for _ in range(150)]
    hand = model_by_hand(texts)
    tokens = np.array([lm.END if w == "end" else lm.tokens(w)[0] for w in hand[0]])
    for bits_each in (6, 4000):  # at 6, many absent pairs are taken for present, so a context's sum is one only on average
        model = train(docs(*texts), bits_each=bits_each)
        (s,) = lm._shards(model)
        sums = []
        for v, w in [(None, lm.START), *((w, lm.tokens(w)[0]) for w in hand[0] if w != "end")]:
            keys = lm.pair_keys(np.full(len(tokens), w), tokens, model.hot)
            q = dict(zip(hand[0], s.count(keys, bucket_of(keys, model.buckets)), strict=True))
            sums.append(sum(p_by_hand(hand, v, w, model.noise, lambda _, w, q=q: q[w]) for w in hand[0]) + p_by_hand(hand, v, "never seen", model.noise, lambda *_: 0))
        if bits_each == 6:
            assert model.taken > 0.01 and np.mean(sums) == pytest.approx(1, abs=0.02)
        else:
            assert sums == pytest.approx([1] * len(sums), abs=1e-3)


def test_scores_do_not_depend_on_what_is_broadcast(docs, monkeypatch):
    df = docs(None, "", *(f"the cat{i % 5} sat on mat{i % 3} u{i}" for i in range(50)))
    new = docs("u1 the", "zz u2 u3 zz", "cat1 sat on u7 mat2", "", ids=[1, 1, None, 3])
    run = lambda some: sorted(((r.doc_id or -1, r.n_tokens, r.n_known), r.base_score, r.score) for r in score(some, train(df)).collect())
    want = [run(df), run(new)]
    monkeypatch.setattr(lm, "COMMON", 4)
    assert train(df).least_common > 1
    for shard_bytes in (64_000_000, 30):
        monkeypatch.setattr(lm, "SHARD_BYTES", shard_bytes)
        for got, exact in zip([run(df), run(new)], want, strict=True):
            assert [x[0] for x in got] == [x[0] for x in exact]
            assert [y for x in got for y in x[1:]] == pytest.approx([y for x in exact for y in x[1:]], rel=1e-9)


def test_repeated_rows_null_ids_and_empty_tables(docs, sf, spark):
    df = docs("a b", "a b", "c", ids=[4, 4, None])
    got = score(df, train(df)).collect()
    assert len(got) == 3
    assert score(docs(), train(docs())).collect() == []
    assert score(df, train(docs())).where("n_known = 0").count() == 3


def test_query_and_held_out_gain(spark):
    path = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    got = op9_lm_bloom(spark, path).collect()
    check(got, rows)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_a_filter_of_many_shards_takes_no_more_passes(docs, monkeypatch):
    """Once a shard was a pass over all texts, written out by itself."""
    df = docs(None, "", "a b a", "a b a", *(f"the cat{i % 5} sat on mat{i % 3} u{i}" for i in range(60)))
    model = train(df)
    texts = docs("u1 the", "u1 the", "zz u2 u3 zz", "cat1 sat on u7 mat2", "", ids=[1, 1, None, 3, 4])
    run = lambda some: sorted(((r.doc_id or -1, r.n_tokens, r.n_known), r.base_score, r.score) for r in score(some, model).collect())
    want = [run(df), run(texts)]
    monkeypatch.setattr(lm, "SHARD_BYTES", 30)
    monkeypatch.setattr(lm, "ROW", 2)
    assert len(list(lm._shards(model))) > 3
    for most in (4, 1_000_000):  # many chunks, some of them equal; one chunk a task
        monkeypatch.setattr(lm, "ASKED", most, raising=False)
        passes, real = [], lm.stash
        with monkeypatch.context() as m:
            m.setattr(lm, "stash", lambda *a, **k: passes.append(a) or real(*a, **k))
            got = [run(df), run(texts)]
        assert len(passes) == 2
        for a, b in zip(got, want, strict=True):
            assert [x[0] for x in a] == [x[0] for x in b]
            assert [y for x in a for y in x[1:]] == pytest.approx([y for x in b for y in x[1:]], rel=1e-9)
