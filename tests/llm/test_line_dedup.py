import random
from collections import Counter, defaultdict

from tarnwood.llm import line_dedup
from tarnwood.llm.line_dedup import WILD, clean, digest, grow, mask, op4_template_lines, path, recurring


def brute(texts, least=3):
    """One tree over all lines, on one machine."""
    lines, leaves, template = Counter(), defaultdict(Counter), {}
    for t in texts:
        lines.update({m for x in (t or "").split("\n") if (m := mask(x))})
    for m, n in lines.items():
        leaves[path(m)][m] = n
    for held in leaves.values():
        for tokens, members, _ in grow(sorted(held.items())):
            template.update(dict.fromkeys(members, tuple(tokens)))
    docs = Counter()
    for t in texts:
        docs.update({template[m] for x in (t or "").split("\n") if (m := mask(x))})
    out = []
    for i, t in enumerate(texts):
        all_lines = (t or "").split("\n")
        keep = [x for x in all_lines if not ((m := mask(x)) and docs[template[m]] >= least)]
        out.append((i, len(all_lines), len(all_lines) - len(keep), digest("\n".join(keep))))
    return out


def run(df):
    from pyspark.sql import functions as F

    return sorted(tuple(r) for r in clean(df, recurring(df)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect())


TEXTS = [
    None, "", "\n \n", "page 1 of 9\nown line one", "page 2 of 9\nown line two is here", "page 3 of 9\npage 4 of 9", "a\na\na", "a\nb",
    *(f"a login came from user {n} today at noon\nprose {n}x of its own {i}" for i, n in enumerate(["ann", "bob", "cy", "dee"])),
    "only twice here\nx" * 1, "only twice here\ny", "word " * 50000 + "\n" + "z " * 30000,
    "total of cells x in one document\ntotal of cells y in one document\ntotal of cells z in one document",
]


def test_against_one_tree(docs):
    got = run(docs(*TEXTS).repartition(3))
    assert got == brute(TEXTS)
    dropped = {i: n for i, _, n, _ in got}
    assert dropped[3] == 1 and dropped[5] == 2 and dropped[6] == 0 and dropped[8] == 1 and dropped[15] == 0


def test_a_line_of_a_third_of_all_rows_and_several_shards(docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD", 5)
    texts = [f"hot line\nown {chr(97 + i % 26)} {i % 31} text" if i % 3 == 0 else f"cold {'abcdefghij'[i % 10]} line of words\nlast" for i in range(120)]
    assert run(docs(*texts)) == brute(texts)


def test_fields_become_wild():
    assert mask("at 10:30  id=7f  ok") == f"at {WILD} {WILD} ok"
    ((template, members, n),) = grow([("user ann logged in now", 1), ("user bob logged in now", 2)])
    assert template == ["user", WILD, "logged", "in", "now"] and len(members) == 2 and n == 3


def test_a_busy_leaf_compares_with_every_template():
    name = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    busy = [f"{WILD} {WILD} {WILD} {' '.join(name(100 * i + j) for j in range(4))}" for i in range(200)]
    users = [f"{WILD} {WILD} {WILD} login of user {name(i)}" for i in range(90, 99)]
    lines = sorted((x, 1) for x in busy + users)
    got = grow(lines)
    assert sorted(len(members) for _, members, _ in got) == [1] * 200 + [9]
    assert [f"{WILD} {WILD} {WILD} login of user {WILD}".split()] == [t for t, members, _ in got if len(members) > 1]


def test_the_index_loses_no_template():
    rng = random.Random(3)
    lines = sorted({" ".join(rng.choice(["a", "b", "c", "d", WILD]) for _ in range(9)): rng.randint(1, 3) for _ in range(600)}.items())
    found = []
    for masked, n in lines:
        tokens = masked.split(" ")
        same = [sum(a == b for a, b in zip(t[0], tokens, strict=True)) for t in found]
        if same and max(same) >= line_dedup.SIMILAR * 9:
            t = found[same.index(max(same))]
            t[:] = [[a if a == b else WILD for a, b in zip(t[0], tokens, strict=True)], [*t[1], masked], t[2] + n]
        else:
            found.append([tokens, [masked], n])
    assert grow(lines) == [tuple(t) for t in found] and len(found) > 64


def test_empty_table_and_repeated_rows(docs):
    assert run(docs()) == []
    assert [r[2] for r in run(docs("same line", "same line", "same line", ids=[1, 1, None]).na.fill(0, ["doc_id"]))] == [1, 1, 1]


def test_query_against_one_tree(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    want = [(rows[i][0], *x) for i, *x in brute([t for _, t in rows])]
    assert sorted(tuple(r) for r in op4_template_lines(spark, sf).collect()) == want
