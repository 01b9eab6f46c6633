"""Vector codes against whole-number arithmetic in plain Python."""

import hashlib
import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwood.llm.vector_codes import PARTS, compress, nearest, op13_vector_codes


def brute(rows, entries=64, rounds=2):
    fine = [(i, v, l) for i, v, l in rows if v and len(v) % PARTS == 0 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(fine, key=lambda r: (r[0] is None, r[0] or 0, len(r[1]), r[1]))
    if not first:
        return []
    width = len(first[0][1])
    kept = [(i, [math.floor(256 * x) for x in v], l) for i, v, l in first if len(v) == width]
    w = width // PARTS
    parts = [[v[p * w : (p + 1) * w] for _, v, _ in kept] for p in range(PARTS)]
    books = [ps[:entries] for ps in parts]

    def assign():
        return [[min(((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))) for x in parts[p]] for p in range(PARTS)]

    for _ in range(rounds):
        at = assign()
        new = [list(b) for b in books]
        for p in range(PARTS):
            for e in range(len(books[p])):
                mine = [x for x, (_, f) in zip(parts[p], at[p], strict=True) if f == e]
                if mine:
                    new[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
        books = new
    at = assign()
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    errors = [sum(at[p][k][0] for p in range(PARTS)) for k in range(len(kept))]
    total = {}
    for (_, _, l), e in zip(kept, errors, strict=True):
        total[l] = total.get(l, 0) + e
    fit = lambda v: v if v < 2**63 else None
    spoiled = {l for (_, _, l), e in zip(kept, errors, strict=True) if e >= 2**63}
    return [(i, "".join(f"{at[p][k][1]:02x}" for p in range(PARTS)), fit(errors[k]), None if l in spoiled else fit(total[l]), sha) for k, (i, _, l) in enumerate(kept)]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows], "vec_id long, embedding array<float>, label int, error int, code string, often_label double")


def test_against_whole_numbers(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.2, 32).astype(np.float32).tolist(), int(rng.integers(4)) if i % 5 else None) for i in range(150)]
    rows += [(200, rows[7][1], 3), (201, rows[7][1], None), (201, rows[7][1], None), (None, rows[9][1], 1), (202, [0.0] * 32, 2), (203, [-0.0] * 31 + [-1e-30], 2)]
    rows += [(300, None, 1), (301, [], 1), (302, [None] + [0.1] * 31, 1), (303, [math.nan] + [0.1] * 31, 1), (304, [math.inf] + [0.1] * 31, 1), (305, [0.1] * 31, 1), (306, [0.1] * 48, 1), (-1, [float("-inf")] * 32, 1)]
    got = sorted(map(tuple, compress(table(spark, rows)).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_components_of_any_size(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 1, 16).astype(np.float32).tolist(), i % 3) for i in range(72)]
    rows[3] = (3, [np.float32(3e30).item(), *rows[3][1][1:]], 0)
    rows[70] = (70, [np.float32(7e25).item(), *rows[70][1][1:]], 1)
    rows[71] = (71, [np.float32(1.4e26).item(), *rows[71][1][1:]], 1)  # no seeds: one entry moves far away and lies between them
    rows += [(90, [np.float32(-2e8).item()] * 16, 1), (91, [np.float32(1.5e6).item()] * 16, 2), (92, [1.0] * 16, 2)]
    got = sorted(map(tuple, compress(table(spark, rows)).collect()), key=str)
    want = sorted(brute(rows), key=str)
    assert got == want and any(r[2] is None for r in want)


def test_few_vectors_and_none(spark):
    rows = [(5, [0.5] * 16, None), (5, [0.25] * 16, 2)]
    assert sorted(map(tuple, compress(table(spark, rows)).collect()), key=str) == sorted(brute(rows), key=str)
    assert compress(table(spark, [(1, None, 1)])).collect() == []
    assert compress(table(spark, [])).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 6), st.integers(1, 9), st.integers(0, 24), st.integers(0, 2**32 - 1))
def test_nearest_settles_close_entries(d, k, bits, seed):
    rng = np.random.default_rng(seed)
    far = int(rng.integers(0, 1 << 25))
    book = far + rng.integers(-(1 << bits), (1 << bits) + 1, (k, d))
    x = far + rng.integers(-(1 << bits), (1 << bits) + 1, (20, d))
    book, x = np.clip(book, -(1 << 25), 1 << 25), np.clip(x, -(1 << 25), 1 << 25)
    best, error = nearest(x, book)
    for i, row in enumerate(x.tolist()):
        all_ = [sum((a - b) ** 2 for a, b in zip(row, c, strict=True)) for c in book.tolist()]
        assert best[i] == all_.index(min(all_)) and error[i] == min(all_)


def test_hot_label_and_ids(spark):
    rows = [(i % 7, [float(i % 3)] * 16, 1) for i in range(60)]
    got = compress(table(spark, rows)).collect()
    assert len(got) == 60 and len({r.label_error for r in got}) == 1
    assert op13_vector_codes(spark, "/root/testdata/sf0.001").count() > 400
