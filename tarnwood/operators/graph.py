"""Cross-function work: call resolution, reach, strongly connected components, batches, summary fixpoints."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import apart, cut, cut_and_told, packed, packed_and_told

#: Bounds that change results (fixed values).
FIXPOINT_ROUNDS, SURFACE_DEPTH, HIERARCHY_FANOUT = 64, 8, 8
#: Edges up to which components are found on the driver; beyond them on the executors.
DRIVER_EDGES = 2_000_000


def _by_step(functions: DataFrame) -> DataFrame:
    """lang, name, kind, box, near, arity -> n, fid: how many functions a lookup of this kind finds, and the least; one row a key."""
    f = functions.select("fid", "lang", "name", F.col("container").alias("c"), F.col("namespace").alias("ns"), F.col("arity").alias("k"))
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), *[(F.col(v) if v in uses else F.lit(None).cast(t)).alias(n) for n, v, t in (("box", "c", "string"), ("near", "ns", "string"), ("arity", "k", "int"))]) for kind, uses in _KINDS])
    f = f.select("fid", "lang", "name", F.explode(kinds).alias("q")).select("fid", "lang", "name", "q.*")
    for kind, uses in _KINDS:
        for n, v in (("box", "c"), ("near", "ns"), ("arity", "k")):
            if v in uses:  # a null finds nothing
                f = f.where((F.col("kind") != kind) | F.col(n).isNotNull())
    return f.groupBy("lang", "name", "kind", *_FREE).agg(F.count("*").alias("n"), F.min("fid").alias("fid"))


#: What a lookup compares beside language and name; a step is tried with the call's arity, or without where that is unknown.
_KINDS = ((1, ("c", "k")), (2, ("c",)), (3, ("ns", "k")), (4, ("ns",)), (5, ("k",)), (6, ()))
_FREE = ("box", "near", "arity")


def resolve_calls(sites: DataFrame, functions: DataFrame) -> DataFrame:
    """site, status (Resolved, Ambiguous, NotFound), callee, step.

    Candidates share language and name. They are tried in steps: container and arity; container; namespace and arity;
    namespace; arity; name alone. A site is resolved if the first step with a candidate has just one; ambiguity is a result and
    makes no edge. An unknown arity fits any.

    Candidates are never paired with sites: they are counted by key of each step, and each distinct way of calling looks its keys up once. The first
    step that finds any has just the candidates of its key, as the steps before it found none.
    """
    own = functions.select(F.col("fid").alias("caller"), F.col("lang").alias("lang"), F.col("namespace").alias("own_ns"))
    how = ["lang", "name", "own_ns", "s_arity", "hint"]
    known = sites.select("site", "caller", "name", F.col("arity").alias("s_arity"), F.col("container_hint").alias("hint")).where("site IS NOT NULL AND name IS NOT NULL").join(own.where("lang IS NOT NULL"), "caller").drop("caller")
    ways = known.select(*how).distinct()
    asks, arity = [], F.col("s_arity")
    for step, kind_known, kind_any in ((1, 1, 2), (2, 2, None), (3, 3, 4), (4, 4, None), (5, 5, 6), (6, 6, None)):
        kind = F.when(arity.isNotNull(), kind_known).otherwise(F.lit(kind_any).cast("int"))
        box, near = (F.col("hint") if step < 3 else F.lit(None).cast("string")), (F.col("own_ns") if step in (3, 4) else F.lit(None).cast("string"))
        asks.append(F.struct(F.lit(step).alias("step"), kind.alias("kind"), box.alias("box"), near.alias("near"), F.when(kind.isin(1, 3, 5), arity).cast("int").alias("arity")))
    asked = ways.select(*how, F.explode(F.array(*asks)).alias("q")).select(*how, "q.*").where("kind IS NOT NULL AND (step > 2 OR box IS NOT NULL) AND (step NOT IN (3, 4) OR near IS NOT NULL)")
    found = _by_step(functions)
    keys = ["lang", "name", "kind", "_box", "_near", "_arity"]  # which of these are null is told by the kind
    plain = lambda df: df.withColumns({"_box": F.coalesce("box", F.lit("")), "_near": F.coalesce("near", F.lit("")), "_arity": F.coalesce("arity", F.lit(0))}).drop(*_FREE)
    first = plain(asked).join(plain(found), keys).groupBy(*how).agg(F.min(F.struct("step", "n", "fid")).alias("b"))
    mark = [F.coalesce("own_ns", F.lit("")), F.col("own_ns").isNull(), F.coalesce("s_arity", F.lit(0)), F.col("s_arity").isNull(), F.coalesce("hint", F.lit("")), F.col("hint").isNull()]
    marks = [f"_{i}" for i in range(len(mark))]
    first = first.select("lang", "name", *[m.alias(n) for m, n in zip(mark, marks, strict=True)], "b")
    best = known.select("site", "lang", "name", *[m.alias(n) for m, n in zip(mark, marks, strict=True)]).join(first, ["lang", "name", *marks]).select("site", "b.*")
    # a site that stands in several rows has the candidates of all of them
    best = best.groupBy("site").agg(F.min("step").alias("step"), F.min_by("fid", "step").alias("fid"), *[F.sum(F.when(F.col("step") == i, F.col("n"))).alias(f"k{i}") for i, _ in _KINDS])
    best = best.select("site", F.struct("step", F.coalesce(*[f"k{i}" for i, _ in _KINDS]).alias("k"), "fid").alias("b"))
    j = sites.select("site").join(best, "site", "left")
    status = F.when(F.col("b").isNull(), "NotFound").when(F.col("b.k") == 1, "Resolved").otherwise("Ambiguous")
    return j.select("site", status.alias("status"), F.when(F.col("b.k") == 1, F.col("b.fid")).alias("callee"), F.col("b.step").alias("step"))


def widen_by_hierarchy(sites: DataFrame, functions: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """site, callee: methods of the receiver's subtypes, HIERARCHY_FANOUT of each site at most, by function id.

    The first of a site are among the first of each type's methods of that name, so these are settled before sites see them.
    """
    subs = hierarchy.select(F.col("super_type").alias("container_hint"), F.col("sub_type").alias("container")).distinct()
    order = F.struct(F.col("fid").isNull().alias("last"), "fid").alias("f")
    least = lambda df, *by: df.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("f"))).where(F.col("k") <= HIERARCHY_FANOUT).drop("k")
    methods = least(functions.where("container IS NOT NULL AND name IS NOT NULL").select("container", "name", order).distinct(), "container", "name")
    asked = sites.where("container_hint IS NOT NULL AND name IS NOT NULL").select("site", "container_hint", "name")
    of = asked.select("container_hint", "name").distinct().join(subs, "container_hint").join(methods, ["container", "name"]).select("container_hint", "name", "f").distinct()
    of = least(of, "container_hint", "name").groupBy("container_hint", "name").agg(F.collect_list("f").alias("fs"))
    # a site that stands in several rows has the methods of all of them
    got = asked.join(of, ["container_hint", "name"]).groupBy("site").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("fs")))).alias("fs"))
    return got.select("site", F.explode(F.slice("fs", 1, HIERARCHY_FANOUT)).alias("f")).select("site", F.col("f.fid").alias("callee"))


def reach(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """start, node, depth: what each start reaches, itself at 0; semi-naive, one join for each level of new pairs."""
    seen = cut(starts.select(F.col("start"), F.col("start").alias("node"), F.lit(0).alias("depth")).distinct())
    new, level = seen, 0
    e = apart(cut(edges.select(F.col("src").alias("node"), "dst").distinct()))
    while depth is None or level < depth:
        level += 1
        step = new.join(e, "node").select("start", F.col("dst").alias("node")).distinct()
        new = cut(step.join(apart(seen.select("start", "node")), ["start", "node"], "left_anti").withColumn("depth", F.lit(level)))
        if new.isEmpty():
            break
        seen = cut(seen.unionByName(new))
    return seen


def distances(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """node, depth: the shortest way from any start."""
    first = cut(starts.select(F.col("start").alias("node"), F.lit(0).alias("depth")).distinct())
    seen, new, level = first, first, 0
    e = apart(cut(edges.select(F.col("src").alias("node"), "dst").distinct()))
    while depth is None or level < depth:
        level += 1
        new = cut(new.join(e, "node").select(F.col("dst").alias("node")).distinct().join(apart(seen.select("node")), "node", "left_anti").withColumn("depth", F.lit(level)))
        if new.isEmpty():
            break
        seen = cut(seen.unionByName(new))
    return seen


def tarjan(edges: list[tuple], nodes: list) -> dict:
    """node -> least node of its strongly connected component; without recursion."""
    out = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    index, low, on, stack, comp = {}, {}, set(), [], {}
    for root in nodes:
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    some = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        some.append(w)
                        if w == v:
                            break
                    least = min(some)
                    comp.update(dict.fromkeys(some, least))
    return comp


def _core(e: DataFrame) -> DataFrame:
    """The edges (src, dst) between nodes that are both called and calling, until no more fall away: no others can lie on a cycle."""
    n = e.count()
    while n:
        called, calling = e.select(F.col("dst").alias("src")).distinct(), e.select(F.col("src").alias("dst")).distinct()
        e = packed(e.join(apart(called), "src", "left_semi").join(apart(calling), "dst", "left_semi").select("src", "dst"))
        was, n = n, e.count()
        if n == was:
            break
    return e


def scc(edges: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """node, component (its least node). Up to driver_edges on the driver. Beyond, nodes that call each other are made one and what lies before or behind all
    cycles is taken off; the rest is coloured: every node takes the largest node that reaches it, and what reaches back within a colour is that node's component."""
    e = packed(edges.select("src", "dst").distinct())
    kind = e.schema["src"].dataType.simpleString()
    if e.count() <= driver_edges:
        pairs = [tuple(r) for r in e.collect()]
        got = tarjan(pairs, sorted({x for p in pairs for x in p}))
        return e.sparkSession.createDataFrame(list(got.items()), f"node {kind}, component {kind}")
    mutual = e.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    one = alias_sets(cut(mutual.where("n = 2").select(F.col("a").alias("src"), F.col("b").alias("dst"))))  # node, label
    inner = e.join(apart(one.select(F.col("node").alias("src"), F.col("label").alias("a"))), "src", "left").join(apart(one.select(F.col("node").alias("dst"), F.col("label").alias("b"))), "dst", "left")
    left = _core(packed(inner.select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst")).where("src <> dst").distinct()))
    found = None
    while not left.isEmpty():
        colour = cut(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct().withColumn("c", F.col("node")))
        inner, moved = left, 1
        while moved:  # the largest ancestor
            up = inner.join(apart(colour.withColumnRenamed("node", "src")), "src").select(F.col("dst").alias("node"), "c")
            then = colour.select("node", "c", F.col("c").alias("own")).unionByName(up.withColumn("own", F.lit(None).cast(kind))).groupBy("node").agg(F.max("c").alias("c"), F.max("own").alias("own"))
            colour, told = cut_and_told(then, F.count_if(F.col("c") > F.col("own")).alias("moved"))
            colour, moved = colour.select("node", "c"), told["moved"]
        # within a colour, back from its root
        same = packed(inner.join(apart(colour.select(F.col("node").alias("src"), F.col("c").alias("cs"))), "src").join(apart(colour.select(F.col("node").alias("dst"), F.col("c").alias("cd"))), "dst").where("cs = cd").select("src", "dst"))
        member = cut(colour.where("node = c").select("node", "c"))
        new = member
        while not new.isEmpty():
            new = cut(same.join(apart(new.select(F.col("node").alias("dst"), "c")), "dst").select(F.col("src").alias("node"), "c").distinct().join(apart(member.select("node")), "node", "left_anti"))
            member = cut(member.unionByName(new))
        found = member if found is None else cut(found.unionByName(member))
        gone = apart(member.select("node"))
        left = _core(packed(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")))
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().join(apart(one), "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    if found is None:
        return cut(nodes.select("node", F.col("label").alias("component")))
    least = found.groupBy("c").agg(F.min("node").alias("component"))
    found = found.join(least, "c").select(F.col("node").alias("label"), "component")
    return cut(nodes.join(apart(found), "label", "left").select("node", F.coalesce("component", "label").alias("component")))


def between_components(edges: DataFrame, components: DataFrame) -> DataFrame:
    """a, b: the distinct calls from component to component."""
    c = components.select("node", "component")
    e = edges.select("src", "dst").join(apart(c.select(F.col("node").alias("src"), F.col("component").alias("a"))), "src").join(apart(c.select(F.col("node").alias("dst"), F.col("component").alias("b"))), "dst")
    return packed(e.where("a <> b").select("a", "b").distinct())


def batches(edges: DataFrame, components: DataFrame) -> DataFrame:
    """component, level: callees first; a component stands one above the highest it calls."""
    return levels(between_components(edges, components), components)


def levels(between: DataFrame, components: DataFrame) -> DataFrame:
    """component, level, of the calls (a, b). Each round takes off the calls to components that call nothing any more, so what is left shrinks; a component's level is how many rounds it calls in."""
    parts, e = [components.select("component", F.lit(0).alias("level"))], between
    while not e.isEmpty():
        parts.append(e.select(F.col("a").alias("component"), F.lit(len(parts)).alias("level")))
        e = packed(e.join(apart(e.select(F.col("a").alias("b")).distinct()), "b", "left_semi").select("a", "b"))
    return cut(reduce(DataFrame.unionByName, parts).groupBy("component").agg(F.max("level").alias("level")))


def propagate_caps(edges: DataFrame, own: DataFrame, rounds: int = FIXPOINT_ROUNDS) -> DataFrame:
    """own (node, caps) -> node, caps, converged: a caller has the capabilities of all it calls.

    Semi-naive: only callers of what changed are looked at again; the cap on rounds is told in a column.
    """
    state = cut(own.groupBy("node").agg(F.bit_or("caps").alias("caps")))
    changed, n = state.where("caps <> 0"), 0
    e = cut(edges.select("src", F.col("dst").alias("node")).distinct())
    while n < rounds:
        n += 1
        more = e.join(apart(changed), "node").groupBy(F.col("src").alias("node")).agg(F.bit_or("caps").alias("more"))
        then = cut(state.join(more, "node", "full_outer").select("node", F.coalesce("caps", F.lit(0)).alias("was"), F.coalesce("caps", F.lit(0)).bitwiseOR(F.coalesce("more", F.lit(0))).alias("caps")))
        state = then.select("node", "caps")
        changed = then.where("caps <> was").select("node", "caps")
        if changed.isEmpty():
            return state.withColumn("converged", F.lit(True))
    return state.withColumn("converged", F.lit(False))


def merge_summaries(parts: DataFrame) -> DataFrame:
    """Partial summaries of one function as one: capability bits OR-ed, parameters united. Partial and final aggregates are native."""
    return parts.groupBy("fid").agg(F.bit_or("source_caps").alias("source_caps"), F.bit_or("sink_caps").alias("sink_caps"), F.array_sort(F.collect_set("param")).alias("params"))


def merge_merged(summaries: DataFrame) -> DataFrame:
    """Summaries merged already, of several scans or workers: the same merge again, as it is associative and idempotent."""
    parts = summaries.select("fid", "source_caps", "sink_caps", F.explode_outer("params").alias("param"))
    return merge_summaries(parts)


def alias_sets(edges: DataFrame) -> DataFrame:
    """edges (src, dst) as equalities -> node, label: the least member of its set.

    In each round a node joins the first of its neighbours and itself, in an order drawn anew, and what has joined is one node of the next round; a third of the nodes that still have
    edges is expected to go, whatever the graph, so rounds are few and shrink. Then nodes are followed from the last round to the first, and the least of each set is found.
    """
    e, joined, left = packed(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()), [], 1
    while left:
        order = lambda c, n=len(joined): F.when(F.col(c).isNotNull(), F.xxhash64(c, F.lit(n)))
        near = e.union(e.select("b", "a")).groupBy("a").agg(F.min_by("b", order("b")).alias("b"))
        joined.append(packed(near.select(F.col("a").alias("node"), F.when(order("b") < order("a"), F.col("b")).otherwise(F.col("a")).alias("label"))))
        of = lambda end, name: apart(joined[-1].select(F.col("node").alias(end), F.col("label").alias(name)))
        then = e.join(of("a", "x"), "a").join(of("b", "y"), "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        e, told = packed_and_told(then, F.count(F.lit(1)).alias("left"))
        left = told["left"]
    label = joined.pop()
    for step in reversed(joined):
        label = step.join(apart(label.select(F.col("node").alias("label"), F.col("label").alias("last"))), "label", "left").select("node", F.coalesce("last", "label").alias("label"))
    label = packed(label)
    least = label.groupBy("label").agg(F.min("node").alias("least"))
    return packed(label.join(apart(least), "label", "left").select("node", F.coalesce("least", "label").alias("label")))
