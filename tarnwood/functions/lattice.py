"""Abstract values as columns: intervals, known bits, strings, tri-states, sets. NULL is the top of each lattice; bottom is named by each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _both(a: Column, b: Column, value: Column) -> Column:
    """value where both are known; least and greatest skip nulls, which would be wrong here."""
    return F.when(a.isNotNull() & b.isNotNull(), value)


def interval(lo: Column, hi: Column) -> Column:
    """[lo, hi]; a null bound is open, lo above hi is bottom, the value of what is never reached."""
    return F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))


def bottom() -> Column:
    return interval(F.lit(1), F.lit(0))


def is_bottom(a: Column) -> Column:
    return F.coalesce(a.lo > a.hi, F.lit(False))


def _strict(a: Column, b: Column, value: Column) -> Column:
    """Bottom if either is."""
    return F.when(is_bottom(a) | is_bottom(b), bottom()).otherwise(value)


def _other(a: Column, b: Column, value: Column) -> Column:
    """The other one if one is bottom."""
    return F.when(is_bottom(a), b).when(is_bottom(b), a).otherwise(value)


def join(a: Column, b: Column) -> Column:
    return _other(a, b, interval(_both(a.lo, b.lo, F.least(a.lo, b.lo)), _both(a.hi, b.hi, F.greatest(a.hi, b.hi))))


def meet(a: Column, b: Column) -> Column:
    both = interval(F.greatest(a.lo, b.lo), F.least(a.hi, b.hi))
    return _strict(a, b, F.when(is_bottom(both), bottom()).otherwise(both))


def widen(old: Column, new: Column) -> Column:
    """A bound that moved is given up."""
    return _other(old, new, interval(F.when(old.lo.eqNullSafe(new.lo), old.lo), F.when(old.hi.eqNullSafe(new.hi), old.hi)))


def leq(a: Column, b: Column) -> Column:
    inside = (b.lo.isNull() | F.coalesce(a.lo >= b.lo, F.lit(False))) & (b.hi.isNull() | F.coalesce(a.hi <= b.hi, F.lit(False)))
    return is_bottom(a) | (~is_bottom(b) & inside)


def add(a: Column, b: Column) -> Column:
    return _strict(a, b, interval(F.try_add(a.lo, b.lo), F.try_add(a.hi, b.hi)))


def sub(a: Column, b: Column) -> Column:
    return _strict(a, b, interval(F.try_subtract(a.lo, b.hi), F.try_subtract(a.hi, b.lo)))


def _known(*xs: Column) -> Column:
    out = F.lit(True)
    for x in xs:
        out = out & x.isNotNull()
    return out


def mul(a: Column, b: Column) -> Column:
    """Bounds of the four products, in decimals; one that leaves the range is open, an unknown one opens both."""
    p = [_wide(x) * _wide(y) for x in (a.lo, a.hi) for y in (b.lo, b.hi)]
    known = _known(a.lo, a.hi, b.lo, b.hi)
    return _strict(a, b, interval(F.when(known, _in_range(F.least(*p))), F.when(known, _in_range(F.greatest(*p)))))


def _wide(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def _in_range(x: Column) -> Column:
    """A decimal as a long; null beyond 64 bits."""
    return F.when(x.between(F.lit(-(2**63)).cast("decimal(38,0)"), F.lit(2**63 - 1).cast("decimal(38,0)")), x.cast("long"))


def _quotient(x: Column, y: Column) -> Column:
    """x / y cut towards zero as a decimal, exact for all longs; null for y = 0. The remainder goes first: a division of decimals rounds."""
    x, y = _wide(x), F.nullif(_wide(y), F.lit(0).cast("decimal(19,0)"))
    return ((x - x % y) / y).cast("decimal(20,0)")


def _no_zero(b: Column) -> Column:
    return F.coalesce((b.lo > 0) | (b.hi < 0), F.lit(False))


def div(a: Column, b: Column) -> Column:
    """Whole quotients, cut towards zero; a divisor that may be zero leaves no bounds, a quotient beyond 64 bits opens its end."""
    q = [_quotient(x, y) for x in (a.lo, a.hi) for y in (b.lo, b.hi)]
    known = _known(a.lo, a.hi, b.lo, b.hi) & _no_zero(b)
    return _strict(a, b, interval(F.when(known, _in_range(F.least(*q))), F.when(known, _in_range(F.greatest(*q)))))


def modulo(a: Column, m: Column) -> Column:
    """Remainders stay below the modulus of the largest size, and are not negative if the dividend isn't; a modulus that may be zero or is open leaves no bounds."""
    # |x| - 1 for x > 0 is x - 1, for x < 0 it is -(x + 1): no size leaves 64 bits
    size = lambda x: F.when(x > 0, x - 1).otherwise(-(x + 1))
    known = _known(m.lo, m.hi) & _no_zero(m)
    top = F.when(known, F.greatest(size(m.lo), size(m.hi)))
    low = F.when(F.coalesce(a.lo >= 0, F.lit(False)), 0).otherwise(-top)
    return _strict(a, m, interval(F.when(known, low), top))


def _single(a: Column, value: int | None = None) -> Column:
    one = F.coalesce(a.lo == a.hi, F.lit(False))
    return one if value is None else one & (a.lo == value)


def _natural(a: Column) -> Column:
    return F.coalesce(a.lo >= 0, F.lit(False))


def _ones_over(n: Column) -> Column:
    """The least 2^k - 1 that is n or more."""
    bits = F.length(F.bin(n))
    return F.when(n <= 0, F.lit(0).cast("long")).when(bits >= 63, F.lit(2**63 - 1)).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)


def bit_and(a: Column, b: Column) -> Column:
    """Exact for known numbers; a known mask that isn't negative bounds any number, two natural numbers bound each other."""
    mask = lambda m, rest: F.when(_single(m) & _natural(m), interval(F.lit(0), m.hi)).otherwise(rest)
    both = F.when(_natural(a) & _natural(b), interval(F.lit(0), F.least(a.hi, b.hi))).otherwise(interval(F.lit(None), F.lit(None)))
    exact = a.lo.bitwiseAND(b.lo)
    zero = F.when(_single(a, 0) | _single(b, 0), interval(F.lit(0), F.lit(0))).otherwise(mask(b, mask(a, both)))
    return _strict(a, b, F.when(_single(a) & _single(b), interval(exact, exact)).otherwise(zero))


def _or_like(a: Column, b: Column, exact: Column, low: Column) -> Column:
    bounded = _natural(a) & _natural(b) & a.hi.isNotNull() & b.hi.isNotNull()
    some = F.when(bounded, interval(low, _ones_over(F.greatest(a.hi, b.hi)))).otherwise(interval(F.lit(None), F.lit(None)))
    return _strict(a, b, F.when(_single(a) & _single(b), interval(exact, exact)).when(_single(b, 0), a).when(_single(a, 0), b).otherwise(some))


def bit_or(a: Column, b: Column) -> Column:
    return _or_like(a, b, a.lo.bitwiseOR(b.lo), F.greatest(a.lo, b.lo))


def bit_xor(a: Column, b: Column) -> Column:
    return _or_like(a, b, a.lo.bitwiseXOR(b.lo), F.lit(0))


def _shifts(a: Column, s: Column) -> Column:
    return _known(a.lo, a.hi, s.lo, s.hi) & _natural(a) & F.coalesce((s.lo >= 0) & (s.hi <= 63), F.lit(False))


def shift_left(a: Column, s: Column) -> Column:
    """Of natural numbers; no bounds where a bit may be lost."""
    by = lambda x, n: F.when(n <= 62, F.try_multiply(x, F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))))
    lo, hi = by(a.lo, s.lo), by(a.hi, s.hi)
    ok = _shifts(a, s) & lo.isNotNull() & hi.isNotNull()
    return _strict(a, s, interval(F.when(ok, lo), F.when(ok, hi)))


def shift_right(a: Column, s: Column) -> Column:
    by = lambda x, n: F.call_function("shiftright", x, n.cast("int"))
    ok = _shifts(a, s)
    return _strict(a, s, interval(F.when(ok, by(a.lo, s.hi)), F.when(ok, by(a.hi, s.lo))))


def bits_join(a: Column, b: Column) -> Column:
    """Known zeros and ones that both sides agree on."""
    return F.struct(a.zeros.bitwiseAND(b.zeros).alias("zeros"), a.ones.bitwiseAND(b.ones).alias("ones"))


def bits_and(a: Column, b: Column) -> Column:
    return F.struct(a.zeros.bitwiseOR(b.zeros).alias("zeros"), a.ones.bitwiseAND(b.ones).alias("ones"))


def bits_or(a: Column, b: Column) -> Column:
    return F.struct(a.zeros.bitwiseAND(b.zeros).alias("zeros"), a.ones.bitwiseOR(b.ones).alias("ones"))


def common_prefix(a: Column, b: Column) -> Column:
    """The longest common prefix, in built-in functions."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda k: F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k))
    return F.substring(a, F.lit(1), F.array_max(same))


def common_suffix(a: Column, b: Column) -> Column:
    return F.reverse(common_prefix(F.reverse(a), F.reverse(b)))


def domain_join(a: Column, b: Column, most: int = 16) -> Column:
    """Finite value sets united; more than `most` values are none known."""
    u = F.array_sort(F.array_union(a, b))
    return F.when(F.size(u) <= most, u)


def bounded_union(a: Column, b: Column, most: int = 32) -> Column:
    """Sorted union cut to `most` members, with the number cut off."""
    u = F.array_sort(F.array_union(a, b))
    return F.struct(F.slice(u, 1, most).alias("members"), F.greatest(F.size(u) - most, F.lit(0)).alias("dropped"))


def transform_caps(tag: Column, bits: Column, caps: Column) -> Column:
    """Identity, StripBits or AddBits."""
    return F.when(tag == "StripBits", caps.bitwiseAND(F.bitwise_not(bits))).when(tag == "AddBits", caps.bitwiseOR(bits)).otherwise(caps)


def constant(text: Column) -> Column:
    """Source text of a literal as kind and value: Int, Bool, Null, Str or Top."""
    t = F.trim(text)
    quoted = t.rlike("^\"[^\"]*\"$|^'[^']*'$")
    kind = F.when(t.rlike("^-?[0-9]{1,18}$"), "Int").when(F.lower(t).isin("true", "false"), "Bool").when(F.lower(t).isin("null", "nil", "none"), "Null").when(quoted, "Str").otherwise("Top")
    return F.struct(kind.alias("kind"), F.when(kind == "Str", F.substring(t, F.lit(2), F.length(t) - 2)).when(kind.isin("Int", "Bool"), F.lower(t)).alias("value"))


def path_safe(dotdot: Column, absolute: Column, locked: Column) -> Column:
    """Tri-states: free of '..', and not absolute unless under a locked prefix."""
    return F.coalesce(~dotdot, F.lit(False)) & (F.coalesce(~absolute, F.lit(False)) | F.coalesce(locked, F.lit(False)))


def tri_join(a: Column, b: Column) -> Column:
    return F.when(a.eqNullSafe(b), a)


def types_meet(a: Column, b: Column) -> Column:
    """Sets of types as bits: those of both; 0 is bottom."""
    return a.bitwiseAND(b)


def types_join(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def types_others(a: Column, kinds: int) -> Column:
    """All of the `kinds` types but these."""
    return F.lit((1 << kinds) - 1).cast("long").bitwiseXOR(a)


def taint_join(states: DataFrame, keys: list[str]) -> DataFrame:
    """States (keys, caps, validated) of the paths that meet: capabilities of any, validated on all; partial and final aggregates."""
    return states.groupBy(*keys).agg(F.bit_or("caps").alias("caps"), F.bool_and("validated").alias("validated"))


def fold(op: Column, x: Column, y: Column) -> Column:
    """x op y of known integers; NULL where it overflows or divides by zero, so that it stays symbolic."""
    return (
        F.when(op == "+", F.try_add(x, y)).when(op == "-", F.try_subtract(x, y)).when(op == "*", F.try_multiply(x, y))
        .when((op == "//") & (y != 0), _in_range(_quotient(x, y)))
        .when((op == "%") & (y != 0), (_wide(x) % F.nullif(_wide(y), F.lit(0).cast("decimal(19,0)"))).cast("long"))
    )


def value_fact(span: Column, is_null: Column, types: Column) -> Column:
    """What is known of a value: its range, whether it is null, and its possible types as bits, 0 for none."""
    return F.struct(span.alias("range"), is_null.cast("boolean").alias("is_null"), types.cast("long").alias("types"))


def _value_bottom() -> Column:
    return value_fact(bottom(), F.lit(None), F.lit(0))


def value_meet(a: Column, b: Column) -> Column:
    """Both at once; bottom where range, nullness or types contradict each other."""
    span, types = meet(a["range"], b["range"]), types_meet(a.types, b.types)
    none = is_bottom(span) | F.coalesce(a.is_null != b.is_null, F.lit(False)) | (types == 0)
    return F.when(none, _value_bottom()).otherwise(value_fact(span, F.coalesce(a.is_null, b.is_null), types))


def _of_either(a: Column, b: Column, value: Column) -> Column:
    return F.when(a.types == 0, b).when(b.types == 0, a).otherwise(value)


def value_join(a: Column, b: Column) -> Column:
    return _of_either(a, b, value_fact(join(a["range"], b["range"]), tri_join(a.is_null, b.is_null), types_join(a.types, b.types)))


def value_widen(old: Column, new: Column) -> Column:
    return _of_either(old, new, value_fact(widen(old["range"], new["range"]), tri_join(old.is_null, new.is_null), types_join(old.types, new.types)))
