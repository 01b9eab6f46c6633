"""Summaries over the call graph in batches, and again after an edit.

A component's capabilities are its own and those of the components that it calls. Components are taken by level, callees first, so each is final when its level is done and is never looked at
again. After an edit only dirty components are evaluated: those with changed functions, changed calls or changed members, and the callers of components whose result changed. An
evaluation reads a component's own functions and its callees' results, so capabilities that went away go away above, too. The result equals that of a full run.

Within a component a function sees its callees' capabilities round by round; a component that needs more rounds than the cap keeps what it has and is noted, and so is all above it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import apart, cut, cut_and_told, packed
from .graph import between_components, levels, scc

_NONE = "component long, caps long"


def plan(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node, component), (component, level), calls between components (a, b). Nodes without calls are components of level 0."""
    e = packed(edges.select("src", "dst").distinct())
    member = cut(nodes.select("node").distinct().join(apart(scc(e)), "node", "full").select("node", F.coalesce("component", "node").alias("component")))
    between = between_components(e, member)
    return member, levels(between, member), between


def evaluate(own: DataFrame, planned: tuple[DataFrame, DataFrame, DataFrame], before: DataFrame | None = None, dirty: DataFrame | None = None) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """((component, caps), [(level, evaluated, changed)]).

    own (node, caps); before (component, caps) with dirty (component) for a run after an edit; without them every component is evaluated. Levels without dirty components cost nothing.
    """
    member, level, between = planned
    base = member.join(apart(own.groupBy("node").agg(F.bit_or("caps").alias("caps"))), "node", "left").groupBy("component").agg(F.coalesce(F.bit_or("caps"), F.lit(0)).alias("own")).join(apart(level), "component")
    kept = before if before is not None else own.sparkSession.createDataFrame([], _NONE)
    base = base.join(apart(kept.select("component", F.col("caps").alias("was"))), "component", "left")
    due = F.lit(True) if dirty is None else F.col("_due").isNotNull()
    base = base if dirty is None else base.join(apart(dirty.select("component").distinct().withColumn("_due", F.lit(True))), "component", "left")
    base, told = cut_and_told(base.select("component", "own", "level", "was", due.alias("due")), F.max("level").alias("deepest"), F.collect_set(F.when(F.col("due"), F.col("level"))).alias("asked"))
    asked = set(told["asked"])  # as many as the graph is deep
    calls = packed(between.join(apart(level.select(F.col("component").alias("a"), "level")), "a")) if told["deepest"] else None
    done, report, moved = None, [], False
    for low in range((-1 if told["deepest"] is None else told["deepest"]) + 1):
        if low not in asked and not moved:
            continue
        got = base.where(F.col("level") == low)
        if low:
            # each call is looked at on its caller's level alone: what the callee has by now, and whether that is new
            lower = calls.where(F.col("level") == low).select("a", "b")
            if dirty is not None and not moved:
                lower = lower.join(apart(got.where("due").select(F.col("component").alias("a"))), "a", "left_semi")
            if dirty is not None:
                lower = lower.join(apart(kept.select(F.col("component").alias("b"), F.col("caps").alias("old"))), "b", "left")
            now = F.lit(None).cast("long")
            if done is not None:
                lower, now = lower.join(apart(done.select(F.col("component").alias("b"), F.col("caps").alias("new"), F.coalesce(F.col("was") != F.col("caps"), F.lit(True)).alias("moved"))), "b", "left"), F.col("new")
            caps = F.coalesce(now, F.col("old")) if dirty is not None else now
            new = F.coalesce("moved", F.lit(False)) if done is not None else F.lit(False)
            more = lower.groupBy(F.col("a").alias("component")).agg(F.bit_or(caps).alias("more"), F.bool_or(new).alias("moved"))
            got = got.join(apart(more), "component", "left").where(F.col("due") | F.coalesce("moved", F.lit(False)))
            got = got.select("component", F.col("own").bitwiseOR(F.coalesce("more", F.lit(0))).alias("caps"), "was")
        else:
            got = got.where("due").select("component", F.col("own").alias("caps"), "was")
        got, told = cut_and_told(got, F.count(F.lit(1)).alias("n"), F.count_if(F.col("was").isNull() | (F.col("was") != F.col("caps"))).alias("k"))
        if not told["n"]:
            continue
        report.append((low, told["n"], told["k"]))
        done = got if done is None else done.unionByName(got)
        moved = moved or dirty is not None and told["k"] > 0
    state = kept.join(apart(level), "component", "left_semi").select("component", "caps") if dirty is not None else None
    if done is None:
        return (kept.select("component", "caps") if state is None else state), report
    done = done.select("component", "caps")
    return cut(done if state is None else state.join(apart(done.select("component")), "component", "left_anti").unionByName(done)), report


def dirty_components(own: DataFrame, own_before: DataFrame, edges: DataFrame, edges_before: DataFrame, member: DataFrame, member_before: DataFrame) -> DataFrame:
    """component: those with functions whose own capabilities, calls or company changed."""
    k = own.groupBy("node").agg(F.bit_or("caps").alias("caps"))
    was = own_before.groupBy("node").agg(F.bit_or("caps").alias("was"))
    keys = k.join(was, "node", "full").where(~F.col("caps").eqNullSafe(F.col("was"))).select("node")
    e, f = edges.select("src", "dst").distinct(), edges_before.select("src", "dst").distinct()
    calls = e.join(f, ["src", "dst"], "left_anti").select(F.col("src").alias("node")).unionByName(f.join(e, ["src", "dst"], "left_anti").select(F.col("src").alias("node")))
    moved = member.join(member_before.withColumnRenamed("component", "was"), "node", "full").where(~F.col("component").eqNullSafe(F.col("was")))
    gone = moved.where("was IS NOT NULL").select(F.col("was").alias("component"))  # what a component lost
    of = member.join(keys.unionByName(calls).unionByName(moved.select("node")).distinct(), "node", "left_semi").select("component")
    return of.unionByName(gone.join(member.select("component").distinct(), "component", "left_semi")).distinct()


def rerun(own: DataFrame, own_before: DataFrame, edges: DataFrame, edges_before: DataFrame, state_before: DataFrame, planned_before: tuple) -> tuple[DataFrame, tuple, list[tuple[int, int, int]]]:
    """The state after an edit, its plan, and what each level touched."""
    planned = plan(edges, own)
    dirty = cut(dirty_components(own, own_before, edges, edges_before, planned[0], planned_before[0]))
    state, report = evaluate(own, planned, state_before, dirty)
    return state, planned, report


def by_node(state: DataFrame, member: DataFrame) -> DataFrame:
    return member.join(state, "component").select("node", "caps")


def capped(edges: DataFrame, own: DataFrame, rounds: int) -> DataFrame:
    """node, caps, notes: components by level, `rounds` rounds within each; notes are the components, in order, whose rounds didn't suffice, in a component or in what it calls.

    A component's functions begin with their own capabilities and those of called components; a round passes them one call on.
    """
    member, level, between = plan(edges, own)
    e = edges.select("src", "dst").distinct().join(member.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(member.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst")
    inner, outer = cut(e.where("a = b AND src <> dst").select("src", "dst")), cut(e.where("a <> b").select("src", "dst"))
    base = cut(member.join(own.groupBy("node").agg(F.bit_or("caps").alias("caps")), "node", "left").join(level, "component").select("node", "component", "level", F.coalesce("caps", F.lit(0)).alias("caps")))
    done = None
    for low in range((level.agg(F.max("level")).first()[0] or 0) + 1):
        now = base.where(F.col("level") == low)
        notes = now.select("node", F.array().cast("array<long>").alias("notes"))
        if done is not None:
            below = outer.join(done.select(F.col("node").alias("dst"), F.col("caps").alias("c"), F.col("notes").alias("n")), "dst")
            got = below.groupBy(F.col("src").alias("node")).agg(F.bit_or("c").alias("c"), F.array_distinct(F.flatten(F.collect_set("n"))).alias("n"))
            notes = now.join(got, "node", "left").select("node", F.coalesce("n", F.array().cast("array<long>")).alias("notes"))
            now = now.join(got, "node", "left").select("node", "component", "level", F.col("caps").bitwiseOR(F.coalesce("c", F.lit(0))).alias("caps"))
        state, moving = cut(now), True
        for k in range(rounds + 1):  # the last one only asks whether anything would move
            more = inner.join(state.select(F.col("node").alias("dst"), F.col("caps").alias("c")), "dst").groupBy(F.col("src").alias("node")).agg(F.bit_or("c").alias("c"))
            then = cut(state.join(more, "node", "left").withColumn("next", F.col("caps").bitwiseOR(F.coalesce("c", F.lit(0)))))
            moving = then.where("next <> caps").select("component").distinct()
            if k == rounds or moving.isEmpty():
                break
            state = then.select("node", "component", "level", F.col("next").alias("caps"))
        own_note = moving.select("component", F.array(F.col("component")).alias("mine"))
        company = notes.join(now.select("node", "component"), "node").groupBy("component").agg(F.array_distinct(F.flatten(F.collect_set("notes"))).alias("notes"))
        told = company.join(own_note, "component", "left").select("component", F.array_sort(F.array_union("notes", F.coalesce("mine", F.array().cast("array<long>")))).alias("notes"))
        out = state.join(told, "component").select("node", "caps", "notes")
        done = cut(out if done is None else done.unionByName(out))
    return done
