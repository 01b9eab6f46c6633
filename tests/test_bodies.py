import random

from tarnwood.operators.bodies import analyse, frontier, immediate_dominators


def reach(edges, entry, without=None):
    seen, work = set(), [entry] if entry != without else []
    while work:
        v = work.pop()
        if v not in seen:
            seen.add(v)
            work += [b for a, b in edges if a == v and b != without]
    return seen


def test_dominators_by_definition():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(2, 12)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 25))]
        idom = immediate_dominators(edges, 0)
        whole = reach(edges, 0)
        assert set(idom) == whole
        dom = {v: {d for d in whole if v == d or v not in reach(edges, 0, d)} for v in whole}
        for v in whole - {0}:
            strict = dom[v] - {v}
            assert idom[v] in strict and all(d in dom[idom[v]] for d in strict)
        inside = [(a, b) for a, b in edges if a in whole]
        want = {x: {b for a, b in inside if x in dom[a] and not (x in dom[b] and x != b)} for x in whole}
        got = frontier(edges, idom)
        assert {x: got.get(x, set()) for x in whole} == want


def test_bodies_in_spark(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 1), (1, 2, 3), (1, 8, 3), (2, 5, 6)], "body long, src long, dst long")
    got = {(r.body, r.node): (r.reachable, r.idom, r.loops) for r in analyse(df).collect()}
    assert got[1, 2] == (True, 1, 1) and got[1, 3] == (True, 2, 0) and got[1, 8] == (False, None, 0) and got[2, 6] == (True, 5, 0)
