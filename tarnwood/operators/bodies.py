"""Control-flow algorithms on function bodies: one pandas group for each body, which is small; bodies are spread over tasks."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame


def reverse_postorder(succ: dict, entry) -> list:
    seen, out, stack = {entry}, [], [(entry, iter(succ[entry]))]
    while stack:
        v, it = stack[-1]
        for w in it:
            if w not in seen:
                seen.add(w)
                stack.append((w, iter(succ[w])))
                break
        else:
            out.append(v)
            stack.pop()
    return out[::-1]


def immediate_dominators(edges: list[tuple], entry) -> dict:
    """node -> immediate dominator, for nodes that the entry reaches; by iteration over reverse postorder."""
    succ, pred = defaultdict(list), defaultdict(list)
    for a, b in edges:
        succ[a].append(b)
        pred[b].append(a)
    order = reverse_postorder(succ, entry)
    at = {v: i for i, v in enumerate(order)}
    idom = {entry: entry}
    moved = True
    while moved:
        moved = False
        for v in order[1:]:
            new = None
            for p in pred[v]:
                if p in idom:
                    if new is None:
                        new = p
                    else:
                        a, b = new, p
                        while a != b:
                            while at[a] > at[b]:
                                a = idom[a]
                            while at[b] > at[a]:
                                b = idom[b]
                        new = a
            if idom.get(v) != new:
                idom[v] = new
                moved = True
    return idom


def frontier(edges: list[tuple], idom: dict) -> dict[object, set]:
    """node -> its dominance frontier, where definitions meet others."""
    pred, out = defaultdict(list), defaultdict(set)
    for a, b in edges:
        if a in idom and b in idom:
            pred[b].append(a)
    for b, ps in pred.items():
        for p in ps:
            while p != idom[b] or b == idom[b]:  # the entry has no strict dominator to stop at
                out[p].add(b)
                if p == idom[p]:
                    break
                p = idom[p]
    return out


def loops(edges: list[tuple], idom: dict) -> dict:
    """loop head -> its natural body, from back edges to a dominator."""
    pred = defaultdict(list)
    for a, b in edges:
        pred[b].append(a)

    def dominates(d, v):
        while v != d and v != idom[v]:
            v = idom[v]
        return v == d

    out: dict = {}
    for a, b in edges:
        if a in idom and b in idom and dominates(b, a):
            body, work = out.setdefault(b, {b}), [a]
            while work:
                v = work.pop()
                if v not in body and v in idom:
                    body.add(v)
                    work += pred[v]
    return out


def analyse(edges: DataFrame) -> DataFrame:
    """edges (body, src, dst), the least node of a body its entry -> body, node, reachable, idom, frontier size, loop depth."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = list(zip(pdf.src.tolist(), pdf.dst.tolist(), strict=True))
        nodes = sorted({x for p in pairs for x in p})
        idom = immediate_dominators(pairs, nodes[0])
        df, nest = frontier(pairs, idom), defaultdict(int)
        for body in loops(pairs, idom).values():
            for v in body:
                nest[v] += 1
        rows = [(int(pdf.body.iloc[0]), v, v in idom, idom.get(v), len(df.get(v, ())), nest[v]) for v in nodes]
        return pd.DataFrame(rows, columns=["body", "node", "reachable", "idom", "frontier", "loops"]).astype({"idom": "Int64"})

    return edges.groupBy("body").applyInPandas(one, "body long, node long, reachable boolean, idom long, frontier long, loops long")
