"""Alignment against two pointers that walk both tokenizers' whole-text results."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwood.llm import alignment
from tarnwood.llm.alignment import align, op12_token_alignment, pair, units

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def walk(two, t, a, b):
    if not t or not two.whole(t, a, b):
        return None
    i = j = x = y = 0
    links, groups, left, right = [], [], [], []
    while i < len(a) and j < len(b):
        links.append((a[i], b[j]))
        p, q = x + len(two.a_bytes[a[i]]), y + len(two.b_bytes[b[j]])
        if p <= q:
            left.append(str(a[i]))
            i, x = i + 1, p
        if q <= p:
            right.append(str(b[j]))
            j, y = j + 1, q
        if p == q:
            groups.append(",".join(left) + "|" + ",".join(right))
            left, right = [], []
    return links, ";".join(groups), len(groups), len(a), len(b)


def brute(ids, texts):
    two = pair(*PATHS)
    texts = [t or "" for t in texts]
    found = [walk(two, t, a, b) for t, a, b in zip(texts, *two.encode(texts), strict=True)]
    count = Counter(x for r in found if r for x in r[0])
    top = defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    out = []
    for i, r in zip(ids, found, strict=True):
        if r is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            links, groups, k, n, m = r
            out.append((i, n, m, k, len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), groups))
    return sorted(out, key=str)


TEXTS = [None, "", " ", "  ", "a", "a ", " a", "a  b", "a \n b\t c \n", "don't stop, it's 12,345.67!", "日本語のテキスト と 한국어", "naïve café ß", "x▁y", "▁", "<|endoftext|> and <s> </s>", "\x00 \x1c x", "a b  c", "same text", "same text", "🙂🙃 é", "q" * 3000, "word " * 2000 + "end", "　x  　 y"]


@pytest.mark.parametrize("most", [alignment.COMMON, 3])
def test_odd_texts(docs, most):
    ids = [*range(len(TEXTS) - 1), None]
    got = align(docs(*TEXTS, ids=ids), *PATHS, most=most)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(ids, TEXTS)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab 'st1.,\n\t\r \x1cé日́🙂S"), max_size=40))
def test_units_are_tokenized_as_in_their_text(text):
    two = pair(*PATHS)
    us = units(text)
    assert "".join(" " + u for u in us) == " " + text
    if text:
        a, b = two.encode(us)
        whole_a, whole_b = two.encode([text])
        assert [x for u in a for x in u] == whole_a[0] and [x for u in b for x in u] == whole_b[0]


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in brute([r.doc_id for r in rows], [r.text for r in rows])]
    assert sorted(map(tuple, op12_token_alignment(spark, sf).collect()), key=str) == sorted(want, key=str)


def test_empty_table(docs):
    df = docs("x").where("doc_id < 0")
    assert align(df, *PATHS).collect() == []
