"""Snapshots: all tables or none, one of two writers, upkeep."""

import random
import threading

import pytest

from tarnwood.sinks.snapshots import Conflict, Snapshots

SUMMARY, ISSUE = "path string, name string, v int", "path string, line int"


def tables(spark, rows):
    return {"summaries": spark.createDataFrame([(p, n, v) for p, n, v in rows], SUMMARY), "issues": spark.createDataFrame([(p, v) for p, _, v in rows], ISSUE)}


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def held(store, version=None):
    s = sorted(tuple(r) for r in store.read("summaries", version).collect())
    assert sorted((p, v) for p, _, v in s) == sorted(tuple(r) for r in store.read("issues", version).collect())
    return s


def test_a_writer_that_ends_between_stages_changes_nothing(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}")
    store.replace(paths(spark, "a", "b"), tables(spark, [("a", "f", 1), ("b", "g", 2), ("c", "not replaced", 3), (None, "x", 4)]))
    before = held(store)
    assert before == [("a", "f", 1), ("b", "g", 2)]
    store.stage(paths(spark, "a"), tables(spark, [("a", "f", 9)]))  # killed before the commit
    half = store.stage(paths(spark, "b"), {"summaries": tables(spark, [("b", "g", 9)])["summaries"]})  # killed between tables
    assert held(store) == before and store.version() == 1
    (tmp_path / "manifests" / ".draft-x").write_text("{")  # killed while writing the manifest
    assert held(store) == before
    assert half["id"] in store.vacuum(older_than_s=0) and held(store) == before


def test_of_two_writers_on_one_path_one_wins(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}")
    base = store.replace(paths(spark, "a", "b", "c"), tables(spark, [("a", "f", 1), ("b", "g", 2), ("c", "h", 3)]))
    staged = [store.stage(paths(spark, "a", x), tables(spark, [("a", "f", k), (x, "n", k)])) for k, x in ((10, "b"), (20, "c"))]
    out, start = [], threading.Barrier(2)

    def write(part):
        start.wait()
        try:
            out.append(store.commit(part, base))
        except Conflict:
            out.append("conflict")

    threads = [threading.Thread(target=write, args=(p,)) for p in staged]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(map(str, out)) == ["2", "conflict"]
    assert held(store) in ([("a", "f", 10), ("b", "n", 10), ("c", "h", 3)], [("a", "f", 20), ("b", "g", 2), ("c", "n", 20)])
    assert held(store, 1) == [("a", "f", 1), ("b", "g", 2), ("c", "h", 3)]  # a reader of the old version


def test_writers_on_other_paths_or_tables_both_succeed(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}")
    base = store.replace(paths(spark, "a", "b"), tables(spark, [("a", "f", 1), ("b", "g", 2)]))
    one, two = (store.stage(paths(spark, p), tables(spark, [(p, "n", 5)])) for p in "ab")
    three = store.stage(paths(spark, "a"), {"auth": spark.createDataFrame([("a", True)], "path string, ok boolean")})
    assert [store.commit(p, base) for p in (one, two, three)] == [2, 3, 4]
    assert held(store) == [("a", "n", 5), ("b", "n", 5)] and [tuple(r) for r in store.read("auth").collect()] == [("a", True)]
    store.replace_whole({"map": spark.createDataFrame([("{}",)], "doc string")})
    store.replace_whole({"map": spark.createDataFrame([("{1}",)], "doc string")})
    assert [r.doc for r in store.read("map").collect()] == ["{1}"]
    with pytest.raises(Conflict):
        store.commit(store.stage(paths(spark), {"map": spark.createDataFrame([("{2}",)], "doc string")}, whole=True), 5)


def test_random_edits_equal_a_plain_table(spark, tmp_path):
    r, store, want = random.Random(2), Snapshots(spark, f"file://{tmp_path}"), {}
    for step in range(6):
        some = r.sample("abcde", 2)
        rows = [(p, f"f{i}", step) for p in some for i in range(r.randint(0, 2))]
        store.replace(paths(spark, *some), tables(spark, rows))
        want |= {p: [x for x in rows if x[0] == p] for p in some}
        assert held(store) == sorted(x for xs in want.values() for x in xs)
    store.remove(paths(spark, "a"))
    want["a"] = []
    whole = sorted(x for xs in want.values() for x in xs)
    assert held(store) == whole
    version = store.compact()
    assert held(store) == whole and len(store.parts()) == 1
    store.vacuum(keep=1, older_than_s=0)
    assert held(store) == whole and store.version() == version
    store.replace_whole({"scans": spark.createDataFrame([(1,)], "scan int")})
    store.clear(["summaries", "issues"])
    assert held(store) == [] and store.read("scans").count() == 1
