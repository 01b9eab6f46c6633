"""Queries on function bodies: sources written from parts, lowered, put in static single assignment form and optimised."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ssa
from .registry import query

#: Sources by template: a branch that a constant decides, a loop, dead code and copies, a meeting of equal constants.
TEMPLATES = (
    "def f(a):\n    x = {s}\n    y = x * 2 + 1\n    if y > {t}:\n        z = y - 1\n    else:\n        z = y + 1\n    w = z\n    return w\n",
    "def f(a):\n    i = 0\n    n = {s}\n    while i < a:\n        n = n + i\n        i = i + 1\n    return n\n",
    "def f(a):\n    x = {s}\n    d = x + 7\n    y = x\n    return y\n    z = 1\n",
    "def f(a):\n    if a:\n        x = {s}\n    else:\n        x = {s}\n    return x + {t}\n",
)
_T = "p_partkey * 7 % 83"


def files(h):
    k, out = F.col("p_partkey") % 4, None
    for i, t in enumerate(TEMPLATES):
        text = F.replace(F.replace(F.lit(t), F.lit("{s}"), F.col("p_size").cast("string")), F.lit("{t}"), (F.col("p_partkey") * 7 % 83).cast("string"))
        out = F.when(k == i, text) if out is None else out.when(k == i, text)
    return h.base("part").select(F.format_string("f%d.py", "p_partkey").alias("path"), out.alias("content"))


def _by_template(column: str, *values: object) -> str:
    return f"CASE p_partkey % 4 {' '.join(f'WHEN {i} THEN {v}' for i, v in enumerate(values))} END AS {column}"


def _sql(*columns: str) -> str:
    return f"SELECT 'f' || p_partkey || '.py' AS path, 'f' AS function, {', '.join(columns)} FROM part"


def _cfg(b):
    return [(len(b.blocks), len(b.edges()))]


@query("g01_control_flow", _sql(_by_template("blocks", 4, 4, 1, 4), _by_template("edges", 4, 4, 0, 4)))
def _(h):
    return ssa.per_function(files(h), "blocks int, edges int", _cfg)


@query("g02_basic_blocks", """SELECT 'f' || p_partkey || '.py' AS path, 'f' AS function, unnest(CASE p_partkey % 4 WHEN 0 THEN [0, 1, 2, 3] WHEN 1 THEN [0, 1, 2, 3] WHEN 2 THEN [0] ELSE [0, 1, 2, 3] END)::INT AS block,
 unnest(CASE p_partkey % 4 WHEN 0 THEN [6, 2, 2, 2] WHEN 1 THEN [2, 2, 4, 1] WHEN 2 THEN [5] ELSE [1, 1, 1, 2] END)::INT AS instructions FROM part""")
def _(h):
    return ssa.per_function(files(h), "block int, instructions int", lambda b: [(k, len(some)) for k, some in enumerate(b.blocks)])


@query("g04_post_dominators", _sql(_by_template("entry_to", 3, 1, -1, 3)))
def _(h):
    return ssa.per_function(files(h), "entry_to int", lambda b: [(ssa.post_dominators(b)[0],)])


@query("g05_frontiers", _sql(_by_template("meetings", 1, 1, 0, 1)))
def _(h):
    return ssa.per_function(files(h), "meetings int", lambda b: [(len(set().union(*ssa.frontier(b.edges(), ssa.immediate_dominators(b.edges(), 0)).values())),)])


@query("g06_phi_insertion", _sql(_by_template("phis", "'z'", "'i,n'", "''", "'x'")))
def _(h):
    return ssa.per_function(files(h), "phis string", lambda b: [(",".join(sorted(v for vs in ssa.place_phis(b).values() for v in vs)),)])


@query("g07_renaming", _sql(_by_template("versions", 3, 3, 0, 3), "0 AS repeated"))
def _(h):
    def rows(b):
        names = [i.target for some in ssa.to_ssa(b).blocks for i in some if i.target]
        met = {v for vs in ssa.place_phis(b).values() for v in vs}
        return [(max((sum(n.rsplit(".", 1)[0] == v for n in names) for v in met), default=0), len(names) - len(set(names)))]

    return ssa.per_function(files(h), "versions int, repeated int", rows)


@query("g08_ssa", _sql(_by_template("instructions", 13, 11, 5, 6)))
def _(h):
    return ssa.per_function(files(h), "instructions int", lambda b: [(sum(map(len, ssa.to_ssa(b).blocks)),)])


@query("g09_invariants", _sql("'' AS violations"))
def _(h):
    def rows(b):
        s = ssa.to_ssa(b)
        return [("; ".join(ssa.violations(s) + ssa.violations(ssa.optimise(s))),)]

    return ssa.per_function(files(h), "violations string", rows)


def returned(b: ssa.Body):
    """The constant that a function ends in, if it does."""
    ends = [i.args[0] for some in b.blocks for i in some if i.op == "return"]
    return str(ends[0].value) if len(ends) == 1 and isinstance(ends[0], ssa.Lit) else None


_Z = f"CASE WHEN p_size * 2 + 1 > {_T} THEN p_size * 2 ELSE p_size * 2 + 2 END"


@query("g10_constants", _sql(_by_template("value", f"CAST({_Z} AS VARCHAR)", "NULL", "CAST(p_size AS VARCHAR)", f"CAST(p_size + {_T} AS VARCHAR)")))
def _(h):
    def rows(b):
        s = ssa.to_ssa(b)
        return [(returned(ssa.apply_constants(s, ssa.constants(s)[0])),)]

    return ssa.per_function(files(h), "value string", rows)


@query("g11_branch_folding", _sql(_by_template("blocks", 3, 4, 1, 4), _by_template("branches", 0, 1, 0, 1)))
def _(h):
    def rows(b):
        s = ssa.to_ssa(b)
        s = ssa.fold_branches(s, ssa.constants(s)[1])
        return [(len(s.blocks), sum(i.op == "branch" for some in s.blocks for i in some))]

    return ssa.per_function(files(h), "blocks int, branches int", rows)


@query("g12_applied_constants", _sql(_by_template("literals", 16, 3, 6, 5)))
def _(h):
    def rows(b):
        s = ssa.to_ssa(b)
        s = ssa.apply_constants(s, ssa.constants(s)[0])
        return [(sum(isinstance(a, ssa.Lit) for some in s.blocks for i in some if i.op != "phi" for a in i.args),)]

    return ssa.per_function(files(h), "literals int", rows)


@query("g13_copies", _sql(_by_template("named", 6, 7, 0, 3)))
def _(h):
    def rows(b):
        s = ssa.propagate_copies(ssa.to_ssa(b))
        return [(sum(isinstance(a, str) for some in s.blocks for i in some if i.op != "copy" and i.op != "phi" for a in i.args),)]

    return ssa.per_function(files(h), "named int", rows)


@query("g14_dead_writes", _sql(_by_template("removed", 0, 0, 2, 0)))
def _(h):
    def rows(b):
        s = ssa.to_ssa(b)
        return [(sum(map(len, s.blocks)) - sum(map(len, ssa.remove_dead(s).blocks)),)]

    return ssa.per_function(files(h), "removed int", rows)


@query("g21_types", _sql(_by_template("kind", "'int'", "'int'", "'int'", "'int'")))
def _(h):
    def rows(b):
        s = ssa.to_ssa(b)
        (end,) = [i.args[0] for some in s.blocks for i in some if i.op == "return"]
        return [(ssa.types(s).get(end),)]

    return ssa.per_function(files(h), "kind string", rows)


@query("g24_optimise", _sql(_by_template("instructions", 1, 7, 1, 2), _by_template("value", f"CAST({_Z} AS VARCHAR)", "NULL", "CAST(p_size AS VARCHAR)", f"CAST(p_size + {_T} AS VARCHAR)")))
def _(h):
    def rows(b):
        s = ssa.optimise(ssa.to_ssa(b))
        return [(sum(map(len, s.blocks)), returned(s))]

    return ssa.per_function(files(h), "instructions int, value string", rows)


@query("g25_forward_fixpoint", _sql(_by_template("written", "'x,y,z'", "'i,n'", "''", "'x'")))
def _(h):
    """Variables that are surely written before a function's last block."""

    def rows(b):
        names = [{i.target for i in some if i.target and i.target[0] != "%"} for some in b.blocks]
        before, _ = ssa.fixpoint({k: b.pred()[k] for k in b.succ}, {0: frozenset()}, lambda k, s: s | names[k], frozenset.intersection, frozenset().union(*names))
        return [(",".join(sorted(before[len(b.blocks) - 1])),)]

    return ssa.per_function(files(h), "written string", rows)
