"""Queries on abstract values: the lattice operations over pairs of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lattice as la
from .registry import query

#: Pairs of intervals with open ends and bottoms, as both engines derive them from parts.
PAIRS = """SELECT p_partkey AS k, CASE WHEN p_partkey % 17 = 0 THEN 5 WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey % 50 - 20 END AS alo, CASE WHEN p_partkey % 17 = 0 THEN 1 WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 6 = 1 THEN p_partkey % 50 - 20 ELSE p_partkey % 50 - 20 + p_size END AS ahi,
 CASE WHEN p_partkey % 19 = 0 THEN 3 WHEN p_partkey % 11 = 0 THEN NULL ELSE p_partkey % 31 - 15 END AS blo, CASE WHEN p_partkey % 19 = 0 THEN -2 WHEN p_partkey % 13 = 0 THEN NULL ELSE p_partkey % 31 - 15 + p_size % 9 END AS bhi,
 p_partkey * 37 % 1024 AS az, p_partkey * 11 % 1024 AS bz, p_name AS a_name, p_type AS b_name FROM {part}"""
DUCK = f"(SELECT *, coalesce(alo > ahi, false) AS abot, coalesce(blo > bhi, false) AS bbot, coalesce(alo = ahi, false) AS aone, coalesce(blo = bhi, false) AS bone, coalesce(alo >= 0, false) AS anat, coalesce(blo >= 0, false) AS bnat FROM ({PAIRS.format(part='part')}))"


def pairs(h):
    df = h.spark.sql(PAIRS, part=h.base("part"))
    return df.withColumn("a", la.interval(F.col("alo"), F.col("ahi"))).withColumn("b", la.interval(F.col("blo"), F.col("bhi")))


def _strict(lo, hi):
    """Bounds of an operation that is bottom if an operand is."""
    return f"CASE WHEN abot OR bbot THEN 1 ELSE ({lo}) END", f"CASE WHEN abot OR bbot THEN 0 ELSE ({hi}) END"


def _other(lo, hi):
    return f"CASE WHEN abot THEN blo WHEN bbot THEN alo ELSE ({lo}) END", f"CASE WHEN abot THEN bhi WHEN bbot THEN ahi ELSE ({hi}) END"


def _interval(name, bounds, f):
    lo, hi = bounds

    @query(name, f"SELECT k, ({lo})::BIGINT AS lo, ({hi})::BIGINT AS hi FROM {DUCK}")
    def _(h):
        return pairs(h).select("k", f(F.col("a"), F.col("b")).alias("v")).select("k", "v.lo", "v.hi")


def _known(*xs):
    return " AND ".join(f"{x} IS NOT NULL" for x in xs)


#: Known intervals up to the ends of 64 bits, and divisors of both signs. Spark reads no literal of the least long.
_MIN = "(-9223372036854775807 - 1)"
EDGES = f"""SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN {_MIN} WHEN 1 THEN 9007199254740993 + p_size WHEN 2 THEN -9223372036854775807 + p_size WHEN 3 THEN 9223372036854775807 - p_size WHEN 4 THEN -p_size ELSE {_MIN} END AS alo,
 CASE p_partkey % 6 WHEN 0 THEN {_MIN} WHEN 1 THEN 9007199254740993 + p_size * 3 WHEN 2 THEN 9223372036854775807 WHEN 3 THEN 9223372036854775807 WHEN 4 THEN p_size ELSE p_size END AS ahi,
 CASE p_partkey % 5 WHEN 0 THEN -1 WHEN 1 THEN 1 WHEN 2 THEN {_MIN} WHEN 3 THEN 3 ELSE -p_size - 2 END AS blo, CASE p_partkey % 5 WHEN 0 THEN -1 WHEN 1 THEN 9223372036854775807 WHEN 2 THEN -7 WHEN 3 THEN p_size + 3 ELSE -2 END AS bhi FROM {{part}}"""


def _edge(name, lo, hi, f):
    """Operands and results as HUGEINT, cut to 64 bits."""
    cut = lambda x: f"CASE WHEN {x} BETWEEN -9223372036854775808 AND 9223372036854775807 THEN CAST({x} AS BIGINT) END"
    wide = ", ".join(f"CAST({c} AS HUGEINT) AS {c}" for c in ("alo", "ahi", "blo", "bhi"))

    @query(name, f"SELECT k, {cut('lo')} AS lo, {cut('hi')} AS hi FROM (SELECT k, {lo} AS lo, {hi} AS hi FROM (SELECT k, {wide} FROM ({EDGES.format(part='part')})))")
    def _(h):
        df = h.spark.sql(EDGES, part=h.base("part")).select("k", *[F.col(c).cast("long").alias(c) for c in ("alo", "ahi", "blo", "bhi")])
        return df.select("k", f(la.interval(F.col("alo"), F.col("ahi")), la.interval(F.col("blo"), F.col("bhi"))).alias("v")).select("k", "v.lo", "v.hi")


_Q = "[alo // blo, alo // bhi, ahi // blo, ahi // bhi]"
_edge("x08_interval_div_64", f"list_min({_Q})", f"list_max({_Q})", la.div)
_edge("x09_interval_modulo_64", "CASE WHEN alo >= 0 THEN 0 ELSE 1 - greatest(abs(blo), abs(bhi)) END", "greatest(abs(blo), abs(bhi)) - 1", la.modulo)
_edge("x07_interval_mul_64", "list_min([alo * blo, alo * bhi, ahi * blo, ahi * bhi])", "list_max([alo * blo, alo * bhi, ahi * blo, ahi * bhi])", la.mul)


@query("x32_binop_fold_64", f"""SELECT k, CASE WHEN v BETWEEN -9223372036854775808 AND 9223372036854775807 THEN CAST(v AS BIGINT) END AS value FROM
  (SELECT k, CASE k % 7 WHEN 0 THEN x + y WHEN 1 THEN x - y WHEN 2 THEN x * y WHEN 3 THEN x % y ELSE x // y END AS v FROM (SELECT k, CAST(alo AS HUGEINT) AS x, CAST(blo AS HUGEINT) AS y FROM ({EDGES.format(part='part')})))""")
def _(h):
    df = h.spark.sql(EDGES, part=h.base("part"))
    op = F.element_at(F.array(*map(F.lit, ("+", "-", "*", "%", "//", "//", "//"))), (F.col("k") % 7 + 1).cast("int"))
    return df.select("k", la.fold(op, F.col("alo").cast("long"), F.col("blo").cast("long")).alias("value"))


FOUR = "[alo * blo, alo * bhi, ahi * blo, ahi * bhi]"
QUOT = "[alo / blo, alo / bhi, ahi / blo, ahi / bhi]"
_interval("x01_interval_join", _other(f"CASE WHEN {_known('alo', 'blo')} THEN least(alo, blo) END", f"CASE WHEN {_known('ahi', 'bhi')} THEN greatest(ahi, bhi) END"), la.join)
_MET = "coalesce(greatest(alo, blo) > least(ahi, bhi), false)"
_interval("x02_interval_meet", _strict(f"CASE WHEN {_MET} THEN 1 ELSE greatest(alo, blo) END", f"CASE WHEN {_MET} THEN 0 ELSE least(ahi, bhi) END"), la.meet)
_interval("x03_interval_widen", _other("CASE WHEN alo IS NOT DISTINCT FROM blo THEN alo END", "CASE WHEN ahi IS NOT DISTINCT FROM bhi THEN ahi END"), la.widen)
_interval("x05_interval_add", _strict("alo + blo", "ahi + bhi"), la.add)
_interval("x06_interval_sub", _strict("alo - bhi", "ahi - blo"), la.sub)
_interval("x07_interval_mul", _strict(f"CASE WHEN {_known('alo', 'ahi', 'blo', 'bhi')} THEN list_min({FOUR}) END", f"CASE WHEN {_known('alo', 'ahi', 'blo', 'bhi')} THEN list_max({FOUR}) END"), la.mul)
_D = f"CASE WHEN {_known('alo', 'ahi', 'blo', 'bhi')} AND (blo > 0 OR bhi < 0) THEN"
_interval("x08_interval_div", _strict(f"{_D} list_min(list_transform({QUOT}, lambda x: trunc(x))) END", f"{_D} list_max(list_transform({QUOT}, lambda x: trunc(x))) END"), la.div)
_M = f"CASE WHEN {_known('blo', 'bhi')} AND NOT (blo <= 0 AND bhi >= 0) THEN"
_interval("x09_interval_modulo", _strict(f"{_M} CASE WHEN anat THEN 0 ELSE 1 - greatest(abs(blo), abs(bhi)) END END", f"{_M} greatest(abs(blo), abs(bhi)) - 1 END"), la.modulo)


@query("x04_interval_leq", f"SELECT k, abot OR (NOT bbot AND (blo IS NULL OR coalesce(alo >= blo, false)) AND (bhi IS NULL OR coalesce(ahi <= bhi, false))) AS leq, abot OR bbot OR {_MET} AS disjoint FROM {DUCK}")
def _(h):
    return pairs(h).select("k", la.leq(F.col("a"), F.col("b")).alias("leq"), la.is_bottom(la.meet(F.col("a"), F.col("b"))).alias("disjoint"))


_ONES = "CASE WHEN greatest(ahi, bhi) <= 0 THEN 0 ELSE list_min(list_filter([1, 3, 7, 15, 31, 63, 127, 255], lambda x: x >= greatest(ahi, bhi))) END"
_BITS = {
    "both": ("CASE WHEN aone AND bone THEN alo & blo WHEN aone AND alo = 0 OR bone AND blo = 0 THEN 0 WHEN bone AND bnat OR aone AND anat OR anat AND bnat THEN 0 END",
             "CASE WHEN aone AND bone THEN alo & blo WHEN aone AND alo = 0 OR bone AND blo = 0 THEN 0 WHEN bone AND bnat THEN bhi WHEN aone AND anat THEN ahi WHEN anat AND bnat THEN least(ahi, bhi) END"),
    "any_of": ("CASE WHEN aone AND bone THEN alo | blo WHEN bone AND blo = 0 THEN alo WHEN aone AND alo = 0 THEN blo WHEN anat AND bnat AND ahi IS NOT NULL AND bhi IS NOT NULL THEN greatest(alo, blo) END",
               f"CASE WHEN aone AND bone THEN alo | blo WHEN bone AND blo = 0 THEN ahi WHEN aone AND alo = 0 THEN bhi WHEN anat AND bnat AND ahi IS NOT NULL AND bhi IS NOT NULL THEN {_ONES} END"),
    "one_of": ("CASE WHEN aone AND bone THEN xor(alo, blo) WHEN bone AND blo = 0 THEN alo WHEN aone AND alo = 0 THEN blo WHEN anat AND bnat AND ahi IS NOT NULL AND bhi IS NOT NULL THEN 0 END",
               f"CASE WHEN aone AND bone THEN xor(alo, blo) WHEN bone AND blo = 0 THEN ahi WHEN aone AND alo = 0 THEN bhi WHEN anat AND bnat AND ahi IS NOT NULL AND bhi IS NOT NULL THEN {_ONES} END"),
    "up": ("CASE WHEN anat AND bnat AND ahi IS NOT NULL AND bhi IS NOT NULL THEN alo * pow(2, blo) END", "CASE WHEN anat AND bnat AND ahi IS NOT NULL AND bhi IS NOT NULL THEN ahi * pow(2, bhi) END"),
    "down": ("CASE WHEN anat AND bnat AND ahi IS NOT NULL AND bhi IS NOT NULL THEN floor(alo / pow(2, bhi)) END", "CASE WHEN anat AND bnat AND ahi IS NOT NULL AND bhi IS NOT NULL THEN floor(ahi / pow(2, blo)) END"),
}
_BIT_COLUMNS = ", ".join(f"({x})::BIGINT AS {name}_{end}" for name, (lo, hi) in _BITS.items() for end, x in zip(("lo", "hi"), _strict(lo, hi), strict=True))


@query("x10_bit_operations", f"SELECT k, {_BIT_COLUMNS} FROM {DUCK}")
def _(h):
    a, b = F.col("a"), F.col("b")
    done = pairs(h).select("k", la.bit_and(a, b).alias("both"), la.bit_or(a, b).alias("any_of"), la.bit_xor(a, b).alias("one_of"), la.shift_left(a, b).alias("up"), la.shift_right(a, b).alias("down"))
    return done.select("k", *[F.col(f"{name}.{end}").alias(f"{name}_{end}") for name in _BITS for end in ("lo", "hi")])


@query("x11_bit_facts", f"SELECT k, (az & 240) & (bz & 240) AS join_zeros, (az & 15) & (bz & 15) AS join_ones, (az & 240) | (bz & 240) AS and_zeros, (az & 15) | (bz & 15) AS or_ones FROM {DUCK}")
def _(h):
    fact = lambda c: F.struct(F.col(c).bitwiseAND(240).alias("zeros"), F.col(c).bitwiseAND(15).alias("ones"))
    p = pairs(h).withColumn("x", fact("az")).withColumn("y", fact("bz"))
    x, y = F.col("x"), F.col("y")
    return p.select("k", la.bits_join(x, y).alias("j"), la.bits_and(x, y).alias("n"), la.bits_or(x, y).alias("o")).select("k", F.col("j.zeros").alias("join_zeros"), F.col("j.ones").alias("join_ones"), F.col("n.zeros").alias("and_zeros"), F.col("o.ones").alias("or_ones"))


PREFIX = "(SELECT max(n) FROM range(0, least(length({0}), length({1})) + 1) t(n) WHERE left({0}, n) = left({1}, n))"
NAMES = "(SELECT DISTINCT 'item ' || p_type AS a, 'item ' || p_brand || p_type AS b FROM part)"


def names(h):
    return h.base("part").select(F.concat(F.lit("item "), "p_type").alias("a"), F.concat(F.lit("item "), "p_brand", "p_type").alias("b")).distinct()


@query("x17_common_prefix", f"SELECT a, b, left(a, {PREFIX.format('a', 'b')}) AS prefix FROM {NAMES}")
def _(h):
    return names(h).select("a", "b", la.common_prefix(F.col("a"), F.col("b")).alias("prefix"))


@query("x18_common_suffix", f"SELECT a, b, right(a, {PREFIX.format('reverse(a)', 'reverse(b)')}) AS suffix FROM {NAMES}")
def _(h):
    return names(h).select("a", "b", la.common_suffix(F.col("a"), F.col("b")).alias("suffix"))


SETS = "(SELECT p_size AS s, list_sort(list(DISTINCT p_partkey % 23)) AS a, list_sort(list(DISTINCT p_partkey % 41)) AS b FROM part GROUP BY 1)"


def sets(h):
    return h.base("part").groupBy(F.col("p_size").alias("s")).agg(F.array_sort(F.collect_set(F.col("p_partkey") % 23)).alias("a"), F.array_sort(F.collect_set(F.col("p_partkey") % 41)).alias("b"))


@query("e06_bounded_union", f"SELECT s, list_slice(list_sort(list_distinct(a || b)), 1, 32) AS members, greatest(len(list_distinct(a || b)) - 32, 0)::INT AS dropped FROM {SETS}")
def _(h):
    return sets(h).select("s", la.bounded_union(F.col("a"), F.col("b")).alias("u")).select("s", "u.members", "u.dropped")


@query("e09_validated_intersection", f"SELECT s, list_sort(list_intersect(a, b)) AS both FROM {SETS}")
def _(h):
    return sets(h).select("s", F.array_sort(F.array_intersect("a", "b")).alias("both"))


@query("x24_taint_transform", f"SELECT k, CASE k % 3 WHEN 0 THEN az WHEN 1 THEN az & ~bz ELSE az | bz END AS caps FROM {DUCK}")
def _(h):
    tag = F.when(F.col("k") % 3 == 0, "Identity").when(F.col("k") % 3 == 1, "StripBits").otherwise("AddBits")
    return pairs(h).select("k", la.transform_caps(tag, F.col("bz"), F.col("az")).alias("caps"))


TEXTS = "(SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN CAST(p_size AS STRING) WHEN 1 THEN '\"' || p_brand || '\"' WHEN 2 THEN 'true' WHEN 3 THEN 'nil' WHEN 4 THEN '-' || CAST(p_size AS STRING) ELSE p_type END AS t FROM {part})"


@query("x25_const_parse", f"SELECT t, CASE WHEN regexp_matches(t, '^-?[0-9]+$') THEN 'Int' WHEN t = 'true' THEN 'Bool' WHEN t = 'nil' THEN 'Null' WHEN t LIKE '\"%' THEN 'Str' ELSE 'Top' END AS kind, CASE WHEN regexp_matches(t, '^-?[0-9]+$') OR t = 'true' THEN t WHEN t LIKE '\"%' THEN t[2:-2] END AS value FROM {TEXTS.format(part='part')}")
def _(h):
    return h.spark.sql("SELECT t FROM " + TEXTS, part=h.base("part")).select("t", la.constant(F.col("t")).alias("c")).select("t", "c.kind", "c.value")


@query("x20_path_safe", f"SELECT k, coalesce(NOT (k % 3 = 0), false) AND (coalesce(alo >= 0, false) OR coalesce(bhi > 0, false)) AS safe, CASE WHEN (alo < 0) IS NOT DISTINCT FROM (blo < 0) THEN alo < 0 END AS joined FROM {DUCK}")
def _(h):
    absolute = F.col("alo") < 0
    return pairs(h).select("k", la.path_safe(F.col("k") % 3 == 0, absolute, F.col("bhi") > 0).alias("safe"), la.tri_join(absolute, F.col("blo") < 0).alias("joined"))


@query("a42_predicate_join", "SELECT p_size AS s, bit_and(p_partkey | 7) AS must, bit_or(p_partkey & 7) AS may FROM part GROUP BY 1")
def _(h):
    return h.base("part").groupBy(F.col("p_size").alias("s")).agg(F.bit_and(F.col("p_partkey").bitwiseOR(7)).alias("must"), F.bit_or(F.col("p_partkey").bitwiseAND(7)).alias("may"))


@query("a35_sink_site_union", "SELECT p_brand AS file, p_size AS line, CAST(POWER(2, p_size % 21) AS BIGINT) AS cap, bool_or(p_partkey % 2 = 0) AS from_chain FROM part GROUP BY 1, 2, 3")
def _(h):
    cap = F.expr("CAST(POWER(2, p_size % 21) AS BIGINT)")
    return h.base("part").groupBy(F.col("p_brand").alias("file"), F.col("p_size").alias("line"), cap.alias("cap")).agg(F.bool_or(F.col("p_partkey") % 2 == 0).alias("from_chain"))


@query("a36_return_paths", "SELECT p_brand AS fn, CASE WHEN count(DISTINCT p_size % 12) > 8 THEN 1 ELSE count(DISTINCT p_size % 12) END AS paths, bit_and(p_partkey) AS known FROM part GROUP BY 1")
def _(h):
    n = F.count_distinct(F.col("p_size") % 12)
    return h.base("part").groupBy(F.col("p_brand").alias("fn")).agg(F.when(n > 8, 1).otherwise(n).cast("long").alias("paths"), F.bit_and("p_partkey").alias("known"))


@query("a49_precision_recall", """SELECT d.lang, count(*) FILTER (p AND toxic = 1)::BIGINT AS tp, count(*) FILTER (p AND toxic = 0)::BIGINT AS fp, count(*) FILTER (NOT p AND toxic = 1)::BIGINT AS fn,
 count(*) FILTER (p AND toxic = 1)::DOUBLE / nullif(count(*) FILTER (p), 0) AS precision, count(*) FILTER (p AND toxic = 1)::DOUBLE / nullif(count(*) FILTER (toxic = 1), 0) AS recall
 FROM (SELECT doc_id, lang, regexp_matches(lower(text), 'idiot|moron|scum|stupid') AS p FROM documents) d JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1""")
def _(h):
    d = h.base("documents").select("doc_id", "lang", F.lower("text").rlike("idiot|moron|scum|stupid").alias("p")).join(h.base("labels").select("doc_id", "toxic"), "doc_id")
    hit, bad = F.col("p"), F.col("toxic") == 1
    g = d.groupBy("lang").agg(F.count_if(hit & bad).alias("tp"), F.count_if(hit & ~bad).alias("fp"), F.count_if(~hit & bad).alias("fn"))
    return g.select("*", (F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).alias("precision"), (F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))).alias("recall"))
