"""Call resolution and widening against a walk over all pairs, with nulls, repeated sites and hot names."""

import random

from tarnwood.operators import graph as g

F_SCHEMA = "fid long, lang string, namespace string, container string, name string, arity int"
S_SCHEMA = "site long, caller long, name string, arity int, container_hint string"


def _tables():
    r = random.Random(5)
    pick = lambda *x: r.choice(x)
    functions = [(i, pick("go", "py"), pick("a", "b", None), pick("C", "D", "", None), pick("m", "n", "one", None), pick(0, 1, None)) for i in range(60)] + [(3, "go", "a", "C", "m", 1)]
    sites = [(r.randrange(250) if i % 40 else None, r.randrange(65), pick("m", "n", "one", "none", None), pick(0, 1, 7, None), pick("C", "D", "", "E", None)) for i in range(400)]
    return functions, sites


def _walk(functions, sites):
    found = {}
    for site, caller, name, arity, hint in sites:
        for _, lang, ns, *_ in (f for f in functions if f[0] == caller):
            for fid, f_lang, f_ns, box, f_name, k in functions:
                if site is None or name is None or (f_lang, f_name) != (lang, name):
                    continue
                fits, inside, near = arity is None or arity == k, box is not None and box == hint, f_ns is not None and f_ns == ns
                step = 1 if inside and fits else 2 if inside else 3 if near and fits else 4 if near else 5 if fits else 6
                found.setdefault(site, []).append((step, fid))
    out = []
    for site, *_ in sites:
        some = sorted(found.get(site, []))
        n = sum(x[0] == some[0][0] for x in some) if some else 0
        out.append((site, "NotFound" if not n else "Resolved" if n == 1 else "Ambiguous", some[0][1] if n == 1 else None, some[0][0] if n else None))
    return out


def _sorted(rows):
    return sorted(map(tuple, rows), key=repr)


def test_resolution_equals_a_walk(spark):
    functions, sites = _tables()
    got = g.resolve_calls(spark.createDataFrame(sites, S_SCHEMA), spark.createDataFrame(functions, F_SCHEMA)).collect()
    assert _sorted(got) == _sorted(_walk(functions, sites))


def test_widening_equals_a_walk(spark):
    functions, sites = _tables()
    functions += [(100 + i, "go", "a", "H", "m", 0) for i in range(30)] + [(None, "go", "a", "C", "one", 0)]
    tree = [("C", "D"), ("C", "H"), ("C", "D"), ("D", "C"), ("E", "none"), ("E", "H")]
    got = g.widen_by_hierarchy(spark.createDataFrame(sites, S_SCHEMA), spark.createDataFrame(functions, F_SCHEMA), spark.createDataFrame(tree, "super_type string, sub_type string")).collect()
    found = {}
    for site, _, name, _, hint in sites:
        for up, sub in tree:
            found.setdefault(site, set()).update(f[0] for f in functions if up == hint and f[3] == sub and name is not None and f[4] == name)
    want = [(site, fid) for site, fids in found.items() for fid in sorted(fids, key=lambda x: (x is None, x or 0))[:8]]
    assert _sorted(got) == _sorted(want)


def test_a_hot_name_is_not_paired_with_its_functions(spark):
    """2,000 sites and 2,000 functions of one name make 4 million pairs; no operator may give out as many rows."""
    functions = spark.range(2000).selectExpr("id AS fid", "'go' AS lang", "'a' AS namespace", "'C' AS container", "'m' AS name", "1 AS arity")
    sites = spark.range(2000).selectExpr("id AS site", "id AS caller", "'m' AS name", "1 AS arity", "'C' AS container_hint")
    tree = spark.createDataFrame([("C", "C")], "super_type string, sub_type string")
    for df, rows in ((g.resolve_calls(sites, functions), 2000), (g.widen_by_hierarchy(sites, functions, tree), 16000)):
        plan = df._jdf.queryExecution().executedPlan()
        assert plan.executeCollect().__len__() == rows
        nodes, most = [plan], 0
        while nodes:
            node = nodes.pop()
            if node.metrics().contains("numOutputRows"):
                most = max(most, node.metrics().apply("numOutputRows").value())
            if "AdaptiveSparkPlan" in node.getClass().getName():
                nodes.append(node.executedPlan())
            elif "QueryStage" in node.getClass().getName():
                nodes.append(node.plan())
            else:
                nodes += [node.children().apply(i) for i in range(node.children().size())]
        assert 0 < most <= 20_000


def test_alias_sets_broadcast_nothing(spark, monkeypatch):
    """Labels grow with the graph, so no join of a round may send them through the driver."""
    plans, real = [], g.cut

    def told(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(g, "cut", told)
    edges = spark.range(1, 20).selectExpr("id AS src", "id + 1 AS dst").union(spark.range(1).selectExpr("40L", "41L")).union(spark.range(1).selectExpr("7L", "7L"))
    got = {tuple(r) for r in g.alias_sets(edges).collect()}
    assert got == {(i, 1) for i in range(1, 21)} | {(40, 40), (41, 40)}
    assert not [p for p in plans if "BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p]


def test_alias_sets_shrink_from_round_to_round(spark, monkeypatch):
    """What has joined takes no part in later rounds: all rounds together keep a few times the nodes, however long the ways are, and broadcast nothing. Null ends are nodes that tie nothing."""
    rows, plans, known, real = [], [], [], {n: getattr(g, n) for n in ('cut', 'cut_and_told', 'packed', 'packed_and_told') if hasattr(g, n)}

    def kept(df, out):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        out_df = out[0] if isinstance(out, tuple) else out
        rows.append(out_df.count())
        known.append(out_df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
        assert sum(rows) <= 8 * 158  # eight times the nodes; told at once, as rounds that don't shrink are many
        return out

    for name, f in real.items():
        monkeypatch.setattr(g, name, lambda df, *what, f=f: kept(df, f(df, *what)))
    way = [(i * 7919 % 1000, (i + 1) * 7919 % 1000) for i in range(100)]
    star = [(2300, 2000 + i) for i in range(50)]
    edges = spark.createDataFrame([*way, *star, (3000, None), (None, 3001), (4000, 4000), (4001, 4002), (4002, 4001)], "src long, dst long")
    got = {r.node: r.label for r in g.alias_sets(edges).collect()}
    least = min(min(p) for p in way)
    assert got == {**{x: least for p in way for x in p}, **{x: 2000 for p in star for x in p}, None: None, 3000: 3000, 3001: 3001, 4000: 4000, 4001: 4001, 4002: 4001}
    assert not [p for p in plans if "Broadcast" in p]
    assert max(known) <= 64, known  # guesses of sizes are not multiplied from round to round
    words = spark.createDataFrame([("b", "c"), ("c", "a"), ("e", "d")], "src string, dst string")
    assert {tuple(r) for r in g.alias_sets(words).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")}
    assert g.alias_sets(words.limit(0)).count() == 0


def test_rounds_over_a_graph_broadcast_nothing_and_find_its_edges_once(spark, monkeypatch):
    """What a round changed grows with the graph, so no join of a round may send it through the driver; edges are not derived anew in each round."""
    plans, real = [], g.cut

    def told(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(g, "cut", told)
    edges = spark.range(6).selectExpr("id AS src", "id + 1 AS dst").union(spark.range(1).selectExpr("6L", "2L"))
    own = spark.range(7).selectExpr("id AS node", "shiftleft(1L, CAST(id AS INT)) AS caps")
    starts = spark.createDataFrame([(0,), (5,)], "start long")
    caps = {r.node: r.caps for r in g.propagate_caps(edges, own).where("converged").collect()}
    assert caps == {0: 127, 1: 126, **dict.fromkeys(range(2, 7), 124)}
    assert {(r.start, r.node, r.depth) for r in g.reach(edges, starts).collect()} == {(0, i, i) for i in range(7)} | {(5, 5, 0), (5, 6, 1), (5, 2, 2), (5, 3, 3), (5, 4, 4)}
    assert {(r.node, r.depth) for r in g.distances(edges, starts).collect()} == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 0), (6, 1)}
    assert not [p for p in plans if "BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p]
    assert sum(p.count("Range (0, 6") > 0 for p in plans) == 3
