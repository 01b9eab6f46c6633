"""Batches, edits and unification against plain Python on random graphs that branch, meet and have cycles."""

import random

from tarnwood.operators import graph as g
from tarnwood.operators import incremental as inc
from tarnwood.operators import points_to as pt


def graph(r, n, m):
    return sorted({(r.randrange(n), min(n - 1, int(r.paretovariate(1)) - 1 if r.random() < 0.4 else r.randrange(n))) for _ in range(m)})


def reached(edges, a):
    out, todo = {a}, [a]
    while todo:
        x = todo.pop()
        for s, d in edges:
            if s == x and d not in out:
                out.add(d)
                todo.append(d)
    return out


def full(edges, own, nodes):
    return {n: __import__("functools").reduce(int.__or__, (own.get(x, 0) for x in reached(edges, n)), 0) for n in nodes}


def frames(spark, edges, own):
    return spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(sorted(own.items()), "node long, caps long")


def test_edits_equal_a_full_run_and_touch_less(spark):
    r = random.Random(4)
    n = 14
    edges, own = graph(r, n, 22), {i: 1 << r.randrange(12) if r.random() < 0.4 else 0 for i in range(n)}
    e, o = frames(spark, edges, own)
    planned = inc.plan(e, o)
    state, report = inc.evaluate(o, planned)
    assert {x.node: x.caps for x in inc.by_node(state, planned[0]).collect()} == full(edges, own, own)
    assert sum(k for _, k, _ in report) == planned[1].count() and [level for level, _, _ in report] == sorted({level for level, _, _ in report})
    for turn in range(3):
        edges2, own2 = list(edges), dict(own)
        for _ in range(r.randint(0, 2)):
            edges2.remove(r.choice(edges2))
        if turn:
            edges2 = sorted({*edges2, (r.randrange(n), r.randrange(n))})
        own2[r.randrange(n)] = 1 << 13 if turn != 1 else 0
        e2, o2 = frames(spark, edges2, own2)
        state2, planned2, touched = inc.rerun(o2, o, e2, e, state, planned)
        assert {x.node: x.caps for x in inc.by_node(state2, planned2[0]).collect()} == full(edges2, own2, own2)
        assert sum(k for _, k, _ in touched) <= planned2[1].count()
        edges, own, e, o, state, planned = edges2, own2, e2, o2, state2, planned2
    same, _, touched = inc.rerun(o, o, e, e, state, planned)
    assert touched == [] and sorted(map(tuple, same.collect())) == sorted(map(tuple, state.collect()))


def test_capped_components_are_noted_and_so_is_what_calls_them(spark):
    ring = [(i, (i + 1) % 6) for i in range(6)]
    edges = [*ring, (10, 0), (11, 10), (20, 21), (21, 20), (12, 20)]
    own = {i: 1 << i if i < 6 else 0 for i in (*range(6), 10, 11, 12, 20, 21)} | {21: 64}
    e, o = frames(spark, edges, own)
    whole = {x.node: (x.caps, x.notes) for x in inc.capped(e, o, 64).collect()}
    assert {k: v[0] for k, v in whole.items()} == full(edges, own, own) and all(v[1] == [] for v in whole.values())
    cut = {x.node: (x.caps, x.notes) for x in inc.capped(e, o, 2).collect()}
    for i in range(6):
        assert cut[i] == (sum(1 << (i + k) % 6 for k in range(3)), [0])
    assert cut[10] == (cut[0][0], [0]) and cut[11] == cut[10] and cut[20] == (64, []) and cut[12] == (64, [])


def test_components_and_levels_of_branching_graphs(spark):
    r = random.Random(9)
    for _ in range(2):
        edges = graph(r, 16, 26)
        nodes = {x for p in edges for x in p}
        to = {a: reached(edges, a) for a in nodes}
        want = {a: min(b for b in to[a] if a in to[b]) for a in nodes}
        e = spark.createDataFrame(edges, "src long, dst long")
        for bound in (g.DRIVER_EDGES, 0):
            assert {x.node: x.component for x in g.scc(e, bound).collect()} == want
        level = {x.component: x.level for x in g.batches(e, g.scc(e)).collect()}
        assert all(level[want[a]] > level[want[b]] for a, b in edges if want[a] != want[b])
        some = spark.createDataFrame([(a,) for a in sorted(nodes)], "start long")
        got = {(x.start, x.node) for x in g.reach(e, some).collect()}
        assert got == {(a, b) for a in nodes for b in to[a]}


def closure(equal, fields, depth):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    def union(a, b):
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)

    for a, b in equal:
        union(a, b)
    for x in (v for b, _, w in fields for v in (b, w)):
        find(x)
    for level in range(depth + 1):
        held = {}
        for b, f, v in fields:
            held.setdefault((find(b), f), set()).add(find(v))
        ties = [sorted(vs) for vs in held.values() if len(vs) > 1]
        if not ties:
            return {x: find(x) for x in up}, True
        if level == depth:
            return {x: find(x) for x in up}, False
        for low, *others in ties:
            for v in others:
                union(low, v)


def test_unification_is_congruence_closure(spark):
    r = random.Random(1)
    for depth, n in ((3, 40), (1, 25), (0, 20)):
        equal = [(r.randrange(n), r.randrange(n)) for _ in range(n // 4)]
        fields = [(r.randrange(n), r.choice("fgh"), r.randrange(n)) for _ in range(n)]
        if depth == 3:
            fields += [(100 + i, "next", 101 + i) for i in range(8)] + [(200 + i, "next", 201 + i) for i in range(8)]  # chains deeper than the bound
            equal += [(100, 200)]
            fields += [(500, pt.ELEMENT, 600 + i) for i in range(200)]  # one field of many values
        want, closed = closure(equal, fields, depth)
        out = pt.unify(spark.createDataFrame([*equal, (None, 1)], "a long, b long"), spark.createDataFrame([*fields, (None, "f", 3), (1, None, 3)], "base long, field string, value long"), depth).collect()
        assert {x.value: x.label for x in out} == want and {x.closed for x in out} == {closed}


def test_field_summaries(spark):
    labels = pt.unify(spark.createDataFrame([(1, 2), (3, 9)], "a long, b long"), spark.createDataFrame([(1, "f", 5), (2, "f", 6)], "base long, field string, value long"))
    params = spark.createDataFrame([(7, 0, 1), (7, 1, 3), (8, 0, 5)], "fid long, param long, value long")
    accesses = spark.createDataFrame([(7, 2, "f", False), (7, 2, "g", True), (7, 9, pt.ELEMENT, True), (7, 40, "none", True), (8, 6, "h", False), (8, 1, "other", False)], "fid long, base long, field string, is_write boolean")
    assert sorted(map(tuple, pt.field_summary(params, accesses, labels).collect())) == [(7, 0, ["f"], ["g"]), (7, 1, [], [pt.ELEMENT]), (8, 0, ["h"], [])]


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_a_level_costs_few_jobs(spark):
    edges = [(i, j) for i in range(1, 9) for j in (i - 1, 0) if i != j] + [(20, 21), (21, 20), (21, 8)]
    own = {i: 1 << i for i in (*range(9), 20, 21)}
    e, o = frames(spark, edges, own)
    planned, n = jobs_of(spark, "plan", lambda: inc.plan(e, o))
    assert {r.component: r.level for r in planned[1].collect()} == {**{i: i for i in range(9)}, 20: 9}
    (state, report), m = jobs_of(spark, "evaluate", lambda: inc.evaluate(o, planned))
    assert {x.node: x.caps for x in inc.by_node(state, planned[0]).collect()} == full(edges, own, own) and [r[0] for r in report] == list(range(10))
    assert n <= 80 and m <= 80, (n, m)


def test_what_lies_on_no_cycle_and_mutual_calls_are_not_coloured(spark):
    pairs = [(10 * i + a, 10 * i + b) for i in range(6) for a, b in ((1, 2), (2, 1))]
    edges = [*pairs, *((10 * i + 11, 10 * i + 2) for i in range(5)), *((100 + i, 101 + i) for i in range(5)), (105, 51), (1, 200), (7, 7)]
    e = spark.createDataFrame(edges, "src long, dst long")
    got, n = jobs_of(spark, "scc", lambda: {x.node: x.component for x in g.scc(e, 0).collect()})
    assert got == {x: x - x % 10 + 1 if x < 60 and x % 10 == 2 else x for p in edges for x in p}
    assert n <= 100, n
