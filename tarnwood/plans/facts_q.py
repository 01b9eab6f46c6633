"""Queries on facts about strings, paths and values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import conditions as co
from ..functions import facts as fa
from ..functions import lattice as la
from ..functions.findings import one_of
from .lattice_q import PREFIX
from .registry import query

#: Pairs of facts, some bottom, as both engines derive them from parts.
STRINGS = """SELECT k, abot, bbot, CASE WHEN NOT abot THEN ap END AS ap, CASE WHEN NOT abot THEN s1 END AS s1, CASE WHEN NOT abot THEN ad END AS ad, CASE WHEN NOT bbot THEN bp END AS bp, CASE WHEN NOT bbot THEN s2 END AS s2, CASE WHEN NOT bbot THEN bd END AS bd
FROM (SELECT p_partkey AS k, p_partkey % 13 = 0 AS abot, p_partkey % 17 = 0 AS bbot, CASE WHEN p_partkey % 5 > 0 THEN 'it' || substring(p_type, 1, CAST(p_partkey % 4 AS INT)) END AS ap, CASE WHEN p_partkey % 7 > 0 THEN 'it' || substring(p_type, 1, CAST(p_partkey % 3 AS INT)) END AS bp,
 CASE WHEN p_partkey % 3 > 0 THEN substring(p_brand, CAST(p_partkey % 4 AS INT) + 1, 20) || 'x' END AS s1, CASE WHEN p_partkey % 8 > 0 THEN substring(p_brand, CAST(p_partkey % 5 AS INT) + 1, 20) || 'x' END AS s2,
 CASE WHEN p_partkey % 4 > 0 THEN split(CASE p_partkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'a,b' ELSE 'b,c' END, ',') END AS ad, CASE WHEN p_partkey % 6 > 0 THEN split(CASE p_partkey % 5 WHEN 0 THEN 'a,b,c' WHEN 1 THEN 'b' WHEN 2 THEN 'd' ELSE 'a,b' END, ',') END AS bd FROM {part}) r"""
DUCK = f"({STRINGS.format(part='part')})"


def pairs(h):
    df = h.spark.sql(STRINGS, part=h.base("part"))
    fact = lambda bot, p, s, d: F.when(F.col(bot), fa.string_bottom()).otherwise(fa.string_fact(F.col(p), F.col(s), F.col(d)))
    return df.select("k", fact("abot", "ap", "s1", "ad").alias("a"), fact("bbot", "bp", "s2", "bd").alias("b"))


def _shown(df):
    return df.select("k", "v.prefix", "v.suffix", F.array_join("v.domain", ",").alias("domain"), "v.bottom")


def _sql(prefix: str, suffix: str, domain: str, bottom: str) -> str:
    return f"SELECT k, {prefix} AS prefix, {suffix} AS suffix, array_to_string({domain}, ',') AS domain, {bottom} AS bottom FROM {DUCK}"


def _other(x: str, y: str, value: str) -> str:
    return f"CASE WHEN abot THEN {y} WHEN bbot THEN {x} ELSE {value} END"


def _either(x: str, y: str, value: str) -> str:
    return _other(x, y, f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {value} END")


_UNITED = "list_sort(list_distinct(ad || bd))"


@query("x12_string_join", _sql(_either("ap", "bp", f"nullif(left(ap, {PREFIX.format('ap', 'bp')}), '')"), _either("s1", "s2", f"nullif(right(s1, {PREFIX.format('reverse(s1)', 'reverse(s2)')}), '')"), _either("ad", "bd", _UNITED), "abot AND bbot"))
def _(h):
    return _shown(pairs(h).select("k", fa.string_join(F.col("a"), F.col("b")).alias("v")))


_CLASH = "(abot OR bbot OR coalesce(NOT starts_with(ap, bp) AND NOT starts_with(bp, ap), false) OR coalesce(NOT ends_with(s1, s2) AND NOT ends_with(s2, s1), false) OR (ad IS NOT NULL AND bd IS NOT NULL AND coalesce(len(list_intersect(ad, bd)) = 0, false)))"


def _met(x: str, y: str, test: str) -> str:
    return f"CASE WHEN {_CLASH} THEN NULL WHEN {x} IS NULL THEN {y} WHEN {y} IS NULL THEN {x} WHEN {test} THEN {x} ELSE {y} END"


@query("x12_string_meet", _sql(_met("ap", "bp", "starts_with(ap, bp)"), _met("s1", "s2", "ends_with(s1, s2)"), f"CASE WHEN {_CLASH} THEN NULL WHEN ad IS NULL THEN bd WHEN bd IS NULL THEN ad ELSE list_sort(list_intersect(ad, bd)) END", _CLASH))
def _(h):
    return _shown(pairs(h).select("k", fa.string_meet(F.col("a"), F.col("b")).alias("v")))


def _kept(x: str, y: str) -> str:
    return _other(x, y, f"CASE WHEN {x} IS NOT DISTINCT FROM {y} THEN {x} END")


@query("x13_string_widen", _sql(_kept("ap", "bp"), _kept("s1", "s2"), _kept("ad", "bd"), "abot AND bbot"))
def _(h):
    return _shown(pairs(h).select("k", fa.string_widen(F.col("a"), F.col("b")).alias("v")))


@query("x14_string_leq", f"SELECT k, abot OR (NOT bbot AND (bp IS NULL OR coalesce(starts_with(ap, bp), false)) AND (s2 IS NULL OR coalesce(ends_with(s1, s2), false)) AND (bd IS NULL OR coalesce(list_has_all(bd, ad), false))) AS leq FROM {DUCK}")
def _(h):
    return pairs(h).select("k", fa.string_leq(F.col("a"), F.col("b")).alias("leq"))


@query("x15_string_concat", _sql("CASE WHEN NOT abot AND NOT bbot THEN ap END", "CASE WHEN NOT abot AND NOT bbot THEN s2 END", "NULL::VARCHAR[]", "abot OR bbot"))
def _(h):
    return _shown(pairs(h).select("k", fa.string_concat(F.col("a"), F.col("b")).alias("v")))


@query("x16_url_with_base", f"SELECT k, CASE WHEN NOT bbot THEN 'https://h' || k % 9 || '/' END AS prefix, s2 AS suffix, bbot AS bottom FROM {DUCK}")
def _(h):
    base = F.concat(F.lit("https://h"), F.col("k") % 9, F.when(F.col("k") % 2 == 0, "/").otherwise(""))
    return pairs(h).select("k", fa.url_with_base(base, F.col("b")).alias("v")).select("k", "v.prefix", "v.suffix", "v.bottom")


PATHS = """SELECT k, abot, bbot, CASE WHEN NOT abot THEN ad END AS ad, CASE WHEN NOT abot THEN aa END AS aa, CASE WHEN NOT abot THEN al END AS al, CASE WHEN NOT bbot THEN bd END AS bd, CASE WHEN NOT bbot THEN ba END AS ba, CASE WHEN NOT bbot THEN bl END AS bl
FROM (SELECT p_partkey AS k, p_partkey % 13 = 0 AS abot, p_partkey % 17 = 0 AS bbot, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS ad, CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS bd, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS aa, CASE WHEN p_partkey % 7 < 4 THEN false ELSE true END AS ba,
 CASE WHEN p_partkey % 3 > 0 THEN '/srv/' || substring(p_type, 1, CAST(p_partkey % 4 AS INT)) END AS al, CASE WHEN p_partkey % 4 > 0 THEN '/srv/' || substring(p_type, 1, CAST(p_partkey % 6 AS INT)) END AS bl FROM {part}) r"""
PATH_DUCK = f"({PATHS.format(part='part')})"


def path_pairs(h):
    df = h.spark.sql(PATHS, part=h.base("part"))
    fact = lambda bot, d, a, l: F.when(F.col(bot), fa.path_bottom()).otherwise(fa.path_fact(F.col(d), F.col(a), F.lit(True), F.col(l)))  # noqa: E731, E741
    return df.select("k", fact("abot", "ad", "aa", "al").alias("a"), fact("bbot", "bd", "ba", "bl").alias("b"))


def _tri(x: str, y: str) -> str:
    return _other(x, y, f"CASE WHEN {x} IS NOT DISTINCT FROM {y} THEN {x} END")


def _path_rows(name: str, lock: str, none: str, f, tri=_tri):
    safe = "NOT bottom AND coalesce(NOT dotdot, false) AND (coalesce(NOT absolute, false) OR prefix_lock IS NOT NULL)"

    @query(name, f"SELECT *, {safe} AS safe FROM (SELECT k, {tri('ad', 'bd')} AS dotdot, {tri('aa', 'ba')} AS absolute, {lock} AS prefix_lock, {none} AS bottom FROM {PATH_DUCK})")
    def _(h):
        v = path_pairs(h).select("k", f(F.col("a"), F.col("b")).alias("v"))
        return v.select("k", "v.dotdot", "v.absolute", "v.prefix_lock", "v.bottom", fa.traversal_safe(F.col("v")).alias("safe"))


_NO_PATH = "(abot OR bbot OR coalesce(ad <> bd, false) OR coalesce(aa <> ba, false) OR coalesce(NOT starts_with(al, bl) AND NOT starts_with(bl, al), false))"
_path_rows("x19_path_join", _either("al", "bl", f"nullif(left(al, {PREFIX.format('al', 'bl')}), '')"), "abot AND bbot", fa.path_join)
_path_rows("x19_path_widen", _tri("al", "bl"), "abot AND bbot", fa.path_widen)
_path_rows("x19_path_meet", f"CASE WHEN {_NO_PATH} THEN NULL WHEN al IS NULL THEN bl WHEN bl IS NULL THEN al WHEN starts_with(al, bl) THEN al ELSE bl END", _NO_PATH, fa.path_meet, lambda x, y: f"CASE WHEN NOT {_NO_PATH} THEN coalesce({x}, {y}) END")


@query("x22_composite_join", f"""SELECT p.k, CASE WHEN p.abot THEN p.ap WHEN p.bbot THEN p.bp END IS NULL AS unused, {_either('p.ap', 'p.bp', f"nullif(left(p.ap, {PREFIX.format('p.ap', 'p.bp')}), '')").replace('WHEN abot', 'WHEN p.abot').replace('WHEN bbot', 'WHEN p.bbot')} AS prefix,
 CASE WHEN p.k % 7 > 0 AND p.k % 5 > 0 THEN least(p.k % 50, p.k % 31) END AS lo, (p.k & 240) & (p.k * 3 & 240) AS zeros FROM {DUCK} p""".replace("CASE WHEN p.abot THEN p.ap WHEN p.bbot THEN p.bp END IS NULL AS unused, ", ""))
def _(h):
    """A value's facts side by side, joined one by one."""
    k = F.col("k")
    bits = lambda x: F.struct(x.bitwiseAND(240).alias("zeros"), x.bitwiseAND(15).alias("ones"))
    v = pairs(h).select("k", "a", "b", la.interval(F.when(k % 7 > 0, k % 50), F.lit(None)).alias("i"), la.interval(F.when(k % 5 > 0, k % 31), F.lit(None)).alias("j"))
    out = la.join(F.col("i"), F.col("j"))
    return v.select("k", fa.string_join(F.col("a"), F.col("b")).prefix.alias("prefix"), out.lo.alias("lo"), la.bits_join(bits(k), bits(k * 3)).zeros.alias("zeros"))


_N = 10  # kinds of types in a set


@query("x31_type_sets", f"SELECT p_partkey AS k, (p_partkey * 37 % 1024) & (p_partkey * 11 % 1024) AS met, (p_partkey * 37 % 1024) | (p_partkey * 11 % 1024) AS joined, 1023 - p_partkey * 37 % 1024 AS others, (p_partkey * 37 % 1024) & (p_partkey * 11 % 1024) = 0 AS clash FROM part")
def _(h):
    a, b = F.col("p_partkey") * 37 % 1024, F.col("p_partkey") * 11 % 1024
    return h.base("part").select(F.col("p_partkey").alias("k"), la.types_meet(a, b).alias("met"), la.types_join(a, b).alias("joined"), la.types_others(a, _N).alias("others"), (la.types_meet(a, b) == 0).alias("clash"))


#: Conditions on a name and a number with their parts, and with those of the contrary.
_ATOMS = [("{} == 3", "Comparison", "==", "3", "!="), ("{} !== 3", "Comparison", "!==", "3", "==="), ("if {} < 10:", "Comparison", "<", "10", ">="), ("{} >= limit", "Comparison", ">=", "limit", "<"), ("{} is None", "NullCheck", "is", "none", "is not"), ("{} != null", "NullCheck", "!=", "null", "=="), ("{}", "BoolTest", None, None, None), ("isinstance({}, int)", "TypeCheck", None, None, None)]


@query("x26_condition_lowering", f"SELECT doc_id, CASE doc_id % {len(_ATOMS)} " + " ".join(f"WHEN {i} THEN '{a[1]}'" for i, a in enumerate(_ATOMS)) + f" END AS kind, CASE WHEN doc_id % {len(_ATOMS)} < 6 THEN 'arg' || doc_id END AS lhs, CASE doc_id % {len(_ATOMS)} " + " ".join(f"WHEN {i} THEN '{a[2]}'" for i, a in enumerate(_ATOMS) if a[2]) + f" END AS op, CASE doc_id % {len(_ATOMS)} " + " ".join(f"WHEN {i} THEN '{a[3]}'" for i, a in enumerate(_ATOMS) if a[3]) + " END AS rhs FROM documents")
def _(h):
    return _atoms(h).select("doc_id", co.lowered(F.col("condition")).alias("c")).select("doc_id", "c.kind", "c.lhs", "c.op", "c.rhs")


def _atoms(h):
    v = h.spark.createDataFrame([(i, *a[0].split("{}")) for i, a in enumerate(_ATOMS)], "k long, before string, after string")
    return h.base("documents").select("doc_id", (F.col("doc_id") % len(_ATOMS)).alias("k")).join(F.broadcast(v), "k").select("doc_id", F.concat("before", F.lit("arg"), "doc_id", "after").alias("condition"))


@query("x27_condition_negate", f"SELECT doc_id, CASE doc_id % {len(_ATOMS)} " + " ".join(f"WHEN {i} THEN '{a[4]}'" for i, a in enumerate(_ATOMS) if a[4]) + f" END AS op, doc_id % {len(_ATOMS)} = 7 AS contrary FROM documents")
def _(h):
    c = _atoms(h).select("doc_id", co.negated(co.lowered(F.col("condition"))).alias("c"))
    return c.select("doc_id", "c.op", (~F.col("c.positive")).alias("contrary"))


_BIG = "(SELECT p_size AS s, list_sort(list(DISTINCT p_partkey % 23)) AS a, list_sort(list(DISTINCT p_partkey % 41)) AS b FROM part GROUP BY 1)"


@query("e07_location_union", f"SELECT s, CASE WHEN len(list_distinct(a || b)) <= 16 THEN list_sort(list_distinct(a || b)) END AS locations FROM {_BIG}")
def _(h):
    g = h.base("part").groupBy(F.col("p_size").alias("s")).agg(F.collect_set(F.col("p_partkey") % 23).alias("a"), F.collect_set(F.col("p_partkey") % 41).alias("b"))
    return g.select("s", la.domain_join(F.col("a"), F.col("b"), 16).alias("locations"))


@query("e08_origin_union", "SELECT k, list_slice(m, 1, 32) AS origins, len(m) > 32 AS capped FROM (SELECT p_size AS k, list_sort(list(DISTINCT p_partkey % 61)) AS m FROM part GROUP BY 1)")
def _(h):
    """Origins of two states of a value, the ones of each bounded already."""
    o = F.col("p_partkey") % 61
    g = h.base("part").groupBy(F.col("p_size").alias("k")).agg(F.collect_set(F.when(o < 30, o)).alias("a"), F.collect_set(F.when(o >= 30, o)).alias("b"))
    return g.select("k", la.bounded_union(F.col("a"), F.col("b"), 32).alias("u")).select("k", F.col("u.members").alias("origins"), (F.col("u.dropped") > 0).alias("capped"))


_TAINT = "SELECT l_orderkey AS unit, l_linenumber AS value, l_suppkey % 2 AS path, CAST(POWER(2, l_partkey % 21) AS BIGINT) AS caps, l_partkey % 3 = 0 AS validated FROM {lineitem}"


@query("g30_taint_join", f"SELECT unit, value, bit_or(caps) AS caps, bool_and(validated) AS validated FROM ({_TAINT.format(lineitem='lineitem')}) GROUP BY 1, 2")
def _(h):
    return la.taint_join(h.spark.sql(_TAINT, lineitem=h.base("lineitem")), ["unit", "value"])


@query("g31_value_merge", f"SELECT value, bit_or(caps) AS caps, bool_and(validated) AS validated FROM ({_TAINT.format(lineitem='lineitem')}) GROUP BY 1")
def _(h):
    return la.taint_join(h.spark.sql(_TAINT, lineitem=h.base("lineitem")), ["value"])


@query("g32_field_merge", "SELECT l_suppkey % 50 AS location, l_returnflag AS field, bit_or(CAST(POWER(2, l_partkey % 21) AS BIGINT)) AS caps, bool_and(l_partkey % 3 = 0) AS validated FROM lineitem GROUP BY 1, 2")
def _(h):
    cells = h.base("lineitem").select((F.col("l_suppkey") % 50).alias("location"), F.col("l_returnflag").alias("field"), F.expr("CAST(POWER(2, l_partkey % 21) AS BIGINT)").alias("caps"), (F.col("l_partkey") % 3 == 0).alias("validated"))
    return la.taint_join(cells, ["location", "field"])


#: Integers around the edges of 64 bits.
_BINARY = "SELECT p_partkey AS k, p_partkey % 5 AS o, CASE WHEN p_partkey % 11 = 0 THEN 9223372036854775807 ELSE p_partkey % 97 END AS x, CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE p_size END AS y FROM {part}"


@query("x32_binop_fold", f"SELECT k, (CASE o WHEN 0 THEN CASE WHEN x = 9223372036854775807 AND y > 0 THEN NULL ELSE x::HUGEINT + y END WHEN 1 THEN x::HUGEINT - y WHEN 2 THEN CASE WHEN x = 9223372036854775807 AND y > 1 THEN NULL ELSE x::HUGEINT * y END WHEN 3 THEN CASE WHEN y <> 0 THEN x // y END ELSE CASE WHEN y <> 0 THEN x % y END END)::BIGINT AS value FROM ({_BINARY.format(part='part')})")
def _(h):
    df = h.spark.sql(_BINARY, part=h.base("part"))
    op = one_of(F.col("o"), {0: "+", 1: "-", 2: "*", 3: "//", 4: "%"})
    return df.select("k", la.fold(op, F.col("x").cast("long"), F.col("y").cast("long")).alias("value"))
