"""Structural patterns against a walk of each tree."""

import random
import re

from tarnwood.operators import patterns as pa
from tarnwood.plans.patterns_q import ON_PAGES, PATTERN, page_nodes

NODE = "file long, pre long, post long, parent long, kind string, text string"


def tree(r, file, n):
    parents = [None] + [r.randrange(max(1, i - 4), i + 1) if r.random() < 0.8 else r.randint(1, i) for i in range(1, n)]
    # document order: number the nodes by a walk
    kids = {}
    for i, p in enumerate(parents, 1):
        kids.setdefault(p, []).append(i)
    rows, place = [], {}

    def walk(i, up):
        place[i] = pre = len(rows) + 1
        rows.append([file, pre, pre, up, r.choice("abcd"), r.choice(["x", "y", "xy", None])])
        for k in kids.get(i, []):
            walk(k, pre)
        rows[pre - 1][2] = len(rows)

    walk(1, None)
    return [tuple(x) for x in rows]


def brute(nodes, patterns):
    out = set()
    for p, _, kind, text, rel, okind, otext, same, nrel, nkind, ntext in patterns:
        def fits(n, k, t):
            return n[4] is not None and n[4] == k and (t is None or n[5] is not None and re.search(t, n[5]) is not None)

        def stands(n, relation, k, t, equal):
            for o in nodes:
                if o[0] != n[0] or not fits(o, k, t) or equal and (o[5] or "") != (n[5] or ""):
                    continue
                if {"child": o[3] == n[1], "parent": n[3] == o[1], "descendant": n[1] < o[1] <= n[2], "ancestor": o[1] < n[1] <= o[2], "sibling": n[3] is not None and o[3] == n[3] and o[1] > n[1]}[relation]:
                    return True
            return False

        for n in nodes:
            if fits(n, kind, text) and (rel is None or stands(n, rel, okind, otext, same)) and not (nrel and stands(n, nrel, nkind, ntext, False)):
                out.add((p, n[0], n[1]))
    return out


def test_ten_patterns_on_random_trees(spark):
    r = random.Random(6)
    nodes = [n for f in range(8) for n in tree(r, f, r.choice([1, 6, 30]))]
    patterns = []
    for i in range(10):
        rel = pa.RELATIONS[i % 5]
        patterns.append((f"p{i}", "LOW", r.choice("abcd"), r.choice([None, "x"]), rel, r.choice("abcd"), r.choice([None, "^y"]), i >= 5, *((r.choice(pa.RELATIONS), r.choice("abcd"), r.choice([None, "x"])) if i % 2 else (None, None, None))))
    patterns += [(f"n{rel}", "LOW", "a", None, None, None, None, False, rel, "b", None) for rel in pa.RELATIONS] + [("none", "LOW", None, None, None, None, None, False, None, None, None)]
    got = pa.matches(spark.createDataFrame(nodes + nodes[:5], NODE), spark.createDataFrame(patterns, PATTERN))
    assert {tuple(x) for x in got.collect()} == brute(nodes, patterns)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert pa.matches(spark.createDataFrame([], NODE), spark.createDataFrame(patterns, PATTERN)).count() == 0


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    nodes = page_nodes(pages)
    rows = [tuple(x) for x in nodes.select("file", "pre", "post", "parent", "kind", "text").collect()]
    by = {(n[0], n[1]): n for n in rows}
    assert len(rows) > 1000 and all(n[3] is None or by[n[0], n[3]][1] < n[1] <= n[2] <= by[n[0], n[3]][2] for n in rows)
    some = {n[0] for n in rows[:400]}
    few = [n for n in rows if n[0] in some]
    got = pa.matches(spark.createDataFrame(few, NODE), spark.createDataFrame(ON_PAGES, PATTERN))
    assert {tuple(x) for x in got.collect()} == brute(few, ON_PAGES)


def test_nodes_are_made_once(spark):
    """However many relations the patterns ask for."""
    passed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            passed.add(len(b))
            yield b

    schema = "file long, pre long, post long, parent long, kind string, text string"
    rows = [(1, 1, 4, None, "body", ""), (1, 2, 4, 1, "ul", ""), (1, 3, 3, 2, "p", ""), (1, 4, 4, 2, "p", "")]
    nodes = spark.createDataFrame(rows, schema).mapInPandas(counted, schema)
    got = pa.findings(nodes, spark.createDataFrame(ON_PAGES, PATTERN), "severity").collect()
    assert sorted((r.pattern, r.pre) for r in got) == [("empty_list", 2), ("paragraph_runs", 3)]
    assert passed.value == len(rows)
