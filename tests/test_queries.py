"""Every query with an oracle against DuckDB, and its operators' properties, on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as entry_module
from tarnwood.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(ORACLE[name])
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_entry(spark):
    assert entry_module.entry(spark).count() == 100
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_low_budget_is_the_greedy_scan(spark):
    from tarnwood.operators import findings as op
    from tarnwood.plans.findings_q import ranked
    from tarnwood.plans.hub import Hub

    f = ranked(Hub(spark, SF)).withColumn("path", __import__("pyspark.sql.functions", fromlist=["x"]).substring("path", 1, 8))
    rows = [r for r in f.orderBy(*op.by_rank(f)).collect() if r.severity == "LOW"]
    for budget in ((1, 10, 20), (2, 3, 15), (3, 1, 6)):
        files, rules, want = {}, {}, []
        for r in rows:
            rule = r.id.split(" (")[0]
            if len(want) < budget[2] and files.get(r.path, 0) < budget[0] and rules.get(rule, 0) < budget[1]:
                files[r.path], rules[rule] = files.get(r.path, 0) + 1, rules.get(rule, 0) + 1
                want.append(r.pos)
        assert sorted(r.pos for r in op.low_budget(f, *budget).collect()) == sorted(want)


def test_components_by_colouring(spark):
    from tarnwood.operators.graph import scc
    from tarnwood.plans.hub import Hub

    e = Hub(spark, SF).edges.where("src <= 120")
    assert sorted(map(tuple, scc(e, driver_edges=0).collect())) == sorted(map(tuple, scc(e).collect()))


def test_lattice_laws(spark):
    from pyspark.sql import functions as F

    from tarnwood.functions import lattice as la

    ends = [None, -3, 0, 4]
    some = [(a, b) for a in ends for b in ends if a is None or b is None or a <= b or (a, b) == (4, -3)]  # one of them is bottom
    df = spark.createDataFrame([(*x, *y, *z) for x in some for y in some for z in some], "a long, b long, c long, d long, e long, f long")
    x, y, z = (la.interval(F.col(p), F.col(q)) for p, q in ("ab", "cd", "ef"))
    df = df.select(x.alias("x"), y.alias("y"), z.alias("z"))
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    laws = {
        "commutes": la.join(x, y).eqNullSafe(la.join(y, x)), "bottom is below": ~la.is_bottom(x) | la.leq(x, y), "bottom stays": ~la.is_bottom(x) | (la.is_bottom(la.add(x, y)) & la.is_bottom(la.modulo(y, x)) & la.is_bottom(la.bit_and(x, y))), "associates": la.join(la.join(x, y), z).eqNullSafe(la.join(x, la.join(y, z))), "idempotent": la.join(x, x).eqNullSafe(x),
        "upper": la.leq(x, la.join(x, y)), "consistent": ~la.leq(x, y) | la.join(x, y).eqNullSafe(y), "lower": la.is_bottom(la.meet(x, y)) | la.leq(la.meet(x, y), x), "widens": la.leq(x, la.widen(x, la.join(x, y))),
    }
    bad = df.agg(*[F.count_if(~v).alias(k) for k, v in laws.items()]).first().asDict()
    assert not any(bad.values()), bad


def test_facts_are_lattices(spark):
    from pyspark.sql import functions as F

    from tarnwood.functions import facts as fa

    text = [None, "ab", "abc", "b"]
    some = [(p, s, d) for p in text[:3] for s in (None, "c", "bc") for d in (None, ["x"], ["x", "y"])]
    rows = [(*a, i % 9 == 0, *b, False) for i, a in enumerate(some) for b in some]
    df = spark.createDataFrame(rows, "p string, s string, d array<string>, z boolean, q string, t string, e array<string>, y boolean")
    fact = lambda p, s, d, bot: F.when(F.col(bot), fa.string_bottom()).otherwise(fa.string_fact(F.col(p), F.col(s), F.col(d)))
    df = df.select(fact(*"psdz").alias("a"), fact(*"qtey").alias("b"))
    a, b = F.col("a"), F.col("b")
    laws = {
        "commutes": fa.string_join(a, b).eqNullSafe(fa.string_join(b, a)), "upper": fa.string_leq(a, fa.string_join(a, b)), "lower": fa.string_leq(fa.string_meet(a, b), a), "widens": fa.string_leq(a, fa.string_widen(a, fa.string_join(a, b))),
        "bottom": ~a.bottom | (fa.string_leq(a, b) & fa.string_concat(a, b).bottom),
    }
    bad = df.agg(*[F.count_if(~v).alias(k) for k, v in laws.items()]).first().asDict()
    assert not any(bad.values()), bad


def test_triage_files(spark, tmp_path):
    from tarnwood import sinks

    d = spark.createDataFrame([("b", "fixed", None), ("a", "open", "n"), ("a", "open", "n")], "portable string, state string, note string")
    sinks.write_triage(d, str(tmp_path / "t"))
    assert sorted(map(tuple, sinks.read_triage(spark, str(tmp_path / "t")).collect()), key=str) == [("a", "open", "n"), ("b", "fixed", None)]


def test_places_in_a_total_order(spark):
    from pyspark.sql import functions as F

    from tarnwood.operators.numbering import numbered

    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("x")).repartition(7)
    got = {r.x: r.place for r in numbered(df, [F.desc("x")]).collect()}
    assert got == {x: i for i, x in enumerate(sorted(got, reverse=True))} and len(got) == 1000
    assert numbered(df.limit(0), [F.col("x")]).count() == 0


def test_a_broken_module_is_told(tmp_path, monkeypatch):
    import sys

    (tmp_path / "broken_one.py").write_text("import no_such_module")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.raises(ModuleNotFoundError):
        entry_module._optional("broken_one", "tarnwood.llm")
    assert entry_module._optional("tarnwood.no_such_folder.registry", "tarnwood.no_such_folder") is None
    assert "broken_one" not in sys.modules
