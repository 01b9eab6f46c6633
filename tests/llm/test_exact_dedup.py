import hashlib
import re

from tarnwood.llm.exact_dedup import OpenTable, assign, grace, squash, survivors


def brute(texts, ids):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    groups = {}
    for i, n in zip(ids, norm, strict=True):
        groups.setdefault(n, []).append(i)
    return sorted((i, min(groups[n]), len(groups[n]), i == min(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for i, n in zip(ids, norm, strict=True))


TEXTS = ["a  b", "a b", "a\n\tb", " a b", "a b ", None, "", "   ", "\n", "é x", "long " * 30000, "long\t" * 30000, "a b", "A b"]


def test_squash_is_the_pattern():
    for t in TEXTS:
        if t is not None:
            assert squash(t.encode()).decode() == re.sub(r"[\x20\x09-\x0D]+", " ", t)


def test_assign_matches_brute_force(docs):
    ids = [31 - 2 * i for i in range(len(TEXTS))]
    got = sorted(tuple(r) for r in assign(docs(*TEXTS, ids=ids).repartition(3)).collect())
    assert got == brute(TEXTS, ids)


def test_spills_and_a_third_of_all_rows_in_one_group(docs):
    texts = [f"text {i % 40} " * 20 if i % 3 else "hot" for i in range(600)]
    got = sorted(tuple(r) for r in assign(docs(*texts).repartition(5), table_bytes=2000).collect())
    assert got == brute(texts, range(600))


def test_survivors_keep_every_column(docs):
    rows = survivors(docs("x y", "x  y", "z", None, "", ids=[5, 3, 9, 8, 7]).repartition(4), table_bytes=100).collect()
    assert sorted(r.doc_id for r in rows) == [3, 7, 9]
    assert {r.digest for r in rows} == {"clash"} and {r.kept for r in rows} == {7}
    assert {r.doc_id: r.text for r in rows}[3] == "x  y"


def test_repeated_rows_leave_one(docs):
    df = docs("same", "same", "same", ids=[4, 4, None])
    assert survivors(df).count() == 1
    got = assign(df).collect()
    assert [r.keep_id for r in got] == [4, 4, 4] and sum(r.kept for r in got) == 1


def test_empty_table(docs):
    assert assign(docs()).collect() == [] and survivors(docs()).collect() == []


def test_table_tells_contents_of_one_digest_apart():
    d = bytes(32)
    table = OpenTable(2)
    for i in range(50):
        table.add(d, b"%d" % (i % 10), i)
    assert sorted((c, v, len(t)) for _, v, c, t in table.groups()) == sorted((b"%d" % i, i, 5) for i in range(10))
    got = list(grace(((d, b"%d" % (i % 10), i) for i in range(50)), budget=400))
    assert sorted(c for _, _, c, _ in got) == sorted(b"%d" % i for i in range(10))


def test_only_the_best_row_of_a_text_is_held():
    rows = [(b"%d" % (i % 3), b"c%d" % (i % 3), (i * 7 % 11, i)) for i in range(100)]
    got = {c: tags for _, _, c, tags in grace(iter(rows), 50, best=lambda t: t)}
    assert got == {b"c%d" % k: [min(t for _, c, t in rows if c == b"c%d" % k)] for k in range(3)}
