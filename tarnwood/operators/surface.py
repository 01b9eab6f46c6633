"""Attack surface: entry risk, exposure of findings, chains of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.findings import BIT, lowest_bit, one_of


def dangerous_points(bits: Column) -> Column:
    """Points of the worst capability (fixed values)."""
    has = lambda *names: bits.bitwiseAND(sum(BIT[n] for n in names)) != 0
    return (
        F.when(has("CODE_EXEC"), 40.0).when(has("DESERIALIZE"), 35.0).when(has("SSTI"), 30.0).when(has("XXE", "LDAP_INJECTION", "XPATH_INJECTION"), 22.0)
        .when(has("PROTOTYPE_POLLUTION", "HEADER_INJECTION"), 18.0).when(has("FMT_STRING"), 15.0).when(has("OPEN_REDIRECT"), 10.0).otherwise(8.0)
    )


#: Points of store kinds.
STORE_POINTS = {"Sql": 12.0, "Document": 10.0, "KeyValue": 8.0, "Filesystem": 8.0, "Cache": 4.0}


def entry_risk(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """idx, score, tier: what a route reaches, what it writes, and whether anyone may call it."""
    kind = F.col("node_kind")
    danger = F.when(kind == "DangerousLocal", dangerous_points(F.col("cap_bits")))
    store = one_of(F.col("store_kind"), STORE_POINTS, 4.0)
    writes, reads = (kind == "DataStore") & (F.col("edge_kind") == "WritesTo"), (kind == "DataStore") & (F.col("edge_kind") != "WritesTo")
    a = edges.groupBy(F.col("entry").alias("idx")).agg(F.max(danger).alias("worst"), F.count(danger).alias("n"), F.max(F.when(writes, store)).alias("w"), F.max(F.when(reads, store)).alias("r"), F.count_if(kind == "ExternalService").alias("x"))
    zero = F.lit(0.0)
    score = F.coalesce("worst", zero) + F.when(F.col("n") > 1, F.least((F.col("n") - 1) * 2.0, F.lit(10.0))).otherwise(0.0) + F.coalesce(F.col("w") + 5.0, F.col("r"), zero)
    score = score + F.when(F.col("x") > 0, 8.0).otherwise(0.0) + F.when(F.col("method").isin("POST", "PUT", "PATCH", "DELETE"), 3.0).otherwise(0.0)
    score = F.when(F.col("auth_required"), score).otherwise(score * 1.5 + 5.0)
    return entries.join(a, "idx", "left").select("idx", score.alias("score")).withColumn("tier", risk_tier(F.col("score")))


def risk_tier(score: Column) -> Column:
    return F.when(score >= 60, "Critical").when(score >= 35, "High").when(score >= 12, "Medium").otherwise("Low")


def exposure(f: DataFrame, entries: DataFrame, reached: DataFrame) -> DataFrame:
    """f (pos, path) with the most exposed route that its file serves or is reached from: unauthenticated before gated, direct before transitive.

    reached (file, entry_file): few rows for each file, taken to one before the join with findings.
    """
    direct = entries.select("file", "idx", "route", "auth_required", F.lit(False).alias("transitive"))
    far = entries.join(reached.select(F.col("entry_file").alias("file"), F.col("file").alias("to")), "file").select(F.col("to").alias("file"), "idx", "route", "auth_required", F.lit(True).alias("transitive"))
    best = direct.unionByName(far).groupBy("file").agg(F.min(F.struct("auth_required", "transitive", "idx", "route")).alias("e"))
    return f.join(best.withColumnRenamed("file", "path"), "path", "left").select(*[c for c in f.columns], F.col("e.route").alias("route"), F.col("e.auth_required").alias("gated"), F.col("e.transitive").alias("far"))


#: Pairs before single capabilities.
PAIRS = (("OPEN_REDIRECT", "UNAUTHORIZED_ID", "SessionHijack"), ("HEADER_INJECTION", "CODE_EXEC", "BrowserToLocalRce"), ("FILE_IO", "DATA_EXFIL", "InfoDisclosure"))
SINGLES = (("CODE_EXEC", "Rce"), ("DESERIALIZE", "Rce"), ("SSRF", "InternalNetworkAccess"))


def impact(source: Column, adjacent: Column) -> Column:
    """The pair's impact in either order, else the source's own, else the other's."""
    out = None
    for a, b, name in PAIRS:
        hit = ((source == BIT[a]) & (adjacent == BIT[b])) | ((source == BIT[b]) & (adjacent == BIT[a]))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    single = lambda c: one_of(c, {BIT[k]: v for k, v in SINGLES})
    return F.coalesce(out, single(source), single(adjacent))


def chain_score(weights: Column, factors: Column, implied: Column) -> Column:
    """(sum of member weights and the implied one) times the product of feasibility factors."""
    add = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return (add + implied) * F.aggregate(factors, F.lit(1.0), lambda a, x: a * x)


def chains(f: DataFrame, depth: int = 4) -> DataFrame:
    """Findings of one function as chains of at most `depth` members, first by place: path, function_name, members, cap, score."""
    w = Window.partitionBy("path", "function_name").orderBy("line", "col", "pos")
    m = f.withColumn("k", F.row_number().over(w)).where(F.col("k") <= depth)
    weight = one_of(F.col("severity"), {"HIGH": 5.0, "MEDIUM": 3.0, "LOW": 1.0}, 0.0)
    factor = F.when(F.col("verdict") == "Confirmed", 1.0).when(F.col("confidence") == "High", 0.8).otherwise(0.5)
    g = m.groupBy("path", "function_name").agg(F.array_sort(F.collect_list(F.struct("k", "pos", weight.alias("w"), factor.alias("f"), "sink_caps"))).alias("m"))
    pick = lambda name: F.transform("m", lambda x: x[name])
    first, last = F.col("m")[0].sink_caps, F.element_at("m", -1).sink_caps
    score = chain_score(pick("w"), pick("f"), F.lit(1.0))
    return g.select("path", "function_name", pick("pos").alias("members"), impact(lowest_bit(first), lowest_bit(last)).alias("impact"), score.alias("score"))
