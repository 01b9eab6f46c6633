import random

from tarnwood.llm import minhash
from tarnwood.llm.components import components
from tarnwood.llm.minhash import classes, least_matches, survivors


def brute(texts, ids, words, percent=80):
    import re

    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    boss = list(range(len(texts)))

    def top(i):
        while boss[i] != i:
            i = boss[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]):
                boss[top(i)] = top(j)
    least = {}
    for i in range(len(texts)):
        least[top(i)] = min(least.get(top(i), ids[i]), ids[i])
    return sorted((ids[i], len(sets[i]), least[top(i)], ids[i] == least[top(i)]) for i in range(len(texts)))


def corpus(n, seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(60)]
    out = []
    for i in range(n):
        kind = i % 6
        if kind == 0 or not out:
            out.append([rng.choice(vocab) for _ in range(rng.randint(1, 120))])
        elif kind == 1:
            out.append(passage + [rng.choice(vocab) for _ in range(rng.randint(5, 40))])
        else:
            base = list(rng.choice(out))
            for _ in range(rng.randint(0, 3)):
                base[rng.randrange(len(base))] = rng.choice(vocab)
            out.append(base)
    return [" ".join(x) for x in out]


def test_against_brute_force(docs):
    texts = corpus(260) + [None, "", " \n", "one two", "One TWO", "one two three four", "long words here " * 20000]
    ids = [3 * i + 1 for i in range(len(texts))][::-1]
    for words in (4, 5):
        got = sorted(tuple(r) for r in classes(docs(*texts, ids=ids).repartition(3), words=words).collect())
        assert got == brute(texts, ids, words)


def test_buckets_that_one_star_cannot_settle(docs, monkeypatch):
    """Chains in one bucket: the ends aren't similar to the leader; tiny blocks force the block comparison."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rng = random.Random(5)
    base = [f"v{rng.randrange(10**6)}" for _ in range(200)]
    texts = []
    for i in range(40):
        base = list(base)
        base[5 * i % 200] = f"x{i}"
        texts.append(" ".join(base))
    texts += [" ".join(base[:150] + [f"y{i}{k}" for k in range(30)]) for i in range(40)]
    got = sorted(tuple(r) for r in classes(docs(*texts), words=4).collect())
    assert got == brute(texts, range(len(texts)), 4)


def test_a_third_of_all_rows_alike_and_repeated_rows(docs):
    texts = [" ".join(f"a{j + (i % 3 == 0) * 100}" for j in range(30)) + (f" z{i}" if i % 2 else "") for i in range(90)]
    df = docs(*texts)
    got = classes(df.union(df), words=5).collect()
    assert len(got) == 180 and {r.component_id for r in got} == {0, 1}


def test_survivors(docs):
    a = " ".join(f"w{i}" for i in range(50))
    rows = survivors(docs(a, a + " x", "other text of its own kind", "", None, ids=[9, 4, 5, 6, 7])).collect()
    assert sorted(r.doc_id for r in rows) == [4, 5, 6, 7] and {r.digest for r in rows} == {"clash"}


def test_null_ids_and_empty_table(docs):
    a = " ".join(f"w{i}" for i in range(50))
    got = {r.doc_id: r.component_id for r in classes(docs(a, a, ids=[None, 8])).collect()}
    assert got == {None: 8, 8: 8}
    assert classes(docs()).collect() == []


def test_bounds_rise():
    b = least_matches(80)
    assert all(x < y for x, y in zip(b, b[1:], strict=False)) and 90 < b[-1] < 128


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
