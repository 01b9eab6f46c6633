"""Facts about strings and paths as columns; NULL is what is not known, bottom what is never reached.

A string fact is (prefix, suffix, domain, bottom), a path fact (dotdot, absolute, normalized, prefix_lock, bottom) with yes, no or NULL for its three tests.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lattice import common_prefix, common_suffix, tri_join

#: Bounds of what a fact holds.
PREFIX_CHARS, SUFFIX_CHARS, VALUES, LOCK_CHARS = 256, 128, 16, 256

_STRING = "struct<prefix:string,suffix:string,domain:array<string>,bottom:boolean>"
_PATH = "struct<dotdot:boolean,absolute:boolean,normalized:boolean,prefix_lock:string,bottom:boolean>"


def string_fact(prefix: Column, suffix: Column, domain: Column) -> Column:
    return F.struct(prefix.cast("string").alias("prefix"), suffix.cast("string").alias("suffix"), domain.cast("array<string>").alias("domain"), F.lit(False).alias("bottom")).cast(_STRING)


def string_bottom() -> Column:
    return F.struct(F.lit(None).alias("prefix"), F.lit(None).alias("suffix"), F.lit(None).alias("domain"), F.lit(True).alias("bottom")).cast(_STRING)


def string_exact(text: Column) -> Column:
    return string_fact(F.substring(text, 1, PREFIX_CHARS), F.reverse(F.substring(F.reverse(text), 1, SUFFIX_CHARS)), F.array(text))


def _other(a: Column, b: Column, value: Column) -> Column:
    return F.when(a.bottom, b).when(b.bottom, a).otherwise(value)


def _both(a: Column, b: Column, value: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), value)


def string_join(a: Column, b: Column) -> Column:
    """What both have in common; values united up to VALUES."""
    prefix = _both(a.prefix, b.prefix, F.nullif(common_prefix(a.prefix, b.prefix), F.lit("")))
    suffix = _both(a.suffix, b.suffix, F.nullif(common_suffix(a.suffix, b.suffix), F.lit("")))
    every = F.array_sort(F.array_union(a.domain, b.domain))
    return _other(a, b, string_fact(prefix, suffix, _both(a.domain, b.domain, F.when(F.size(every) <= VALUES, every))))


def _longer(a: Column, b: Column, under) -> tuple[Column, Column]:
    """The one that says more, and whether the two contradict each other."""
    fits = under(a, b) | under(b, a)
    return F.when(a.isNull(), b).when(b.isNull(), a).when(under(a, b), a).when(under(b, a), b), a.isNotNull() & b.isNotNull() & ~fits


def string_meet(a: Column, b: Column) -> Column:
    """Both at once; bottom where they contradict each other."""
    prefix, p = _longer(a.prefix, b.prefix, lambda x, y: x.startswith(y))
    suffix, s = _longer(a.suffix, b.suffix, lambda x, y: x.endswith(y))
    shared = F.array_intersect(a.domain, b.domain)
    domain = F.when(a.domain.isNull(), b.domain).when(b.domain.isNull(), a.domain).otherwise(shared)
    none = a.bottom | b.bottom | F.coalesce(p, F.lit(False)) | F.coalesce(s, F.lit(False)) | F.coalesce(_both(a.domain, b.domain, F.size(shared) == 0), F.lit(False))
    return F.when(none, string_bottom()).otherwise(string_fact(prefix, suffix, domain))


def string_widen(old: Column, new: Column) -> Column:
    """What changed is given up."""
    keep = lambda x, y: F.when(x.eqNullSafe(y), x)
    return _other(old, new, string_fact(keep(old.prefix, new.prefix), keep(old.suffix, new.suffix), keep(old.domain, new.domain)))


def string_leq(a: Column, b: Column) -> Column:
    holds = lambda x, y, test: y.isNull() | F.coalesce(x.isNotNull() & test, F.lit(False))
    inside = holds(a.prefix, b.prefix, a.prefix.startswith(b.prefix)) & holds(a.suffix, b.suffix, a.suffix.endswith(b.suffix)) & holds(a.domain, b.domain, F.size(F.array_except(a.domain, b.domain)) == 0)
    return a.bottom | (~b.bottom & inside)


def string_concat(a: Column, b: Column) -> Column:
    """The left one's prefix and the right one's suffix."""
    return F.when(a.bottom | b.bottom, string_bottom()).otherwise(string_fact(a.prefix, b.suffix, F.lit(None)))


def url_with_base(base: Column, path: Column) -> Column:
    """A path under a base: the prefix is locked to scheme and host."""
    return string_concat(string_exact(F.when(base.endswith("/"), base).otherwise(F.concat(base, F.lit("/")))), path)


def path_fact(dotdot: Column, absolute: Column, normalized: Column, lock: Column) -> Column:
    return F.struct(dotdot.alias("dotdot"), absolute.alias("absolute"), normalized.alias("normalized"), lock.alias("prefix_lock"), F.lit(False).alias("bottom")).cast(_PATH)


def path_bottom() -> Column:
    return F.struct(*[F.lit(None).alias(c) for c in ("dotdot", "absolute", "normalized", "prefix_lock")], F.lit(True).alias("bottom")).cast(_PATH)


TESTS = ("dotdot", "absolute", "normalized")


def path_join(a: Column, b: Column) -> Column:
    lock = _both(a.prefix_lock, b.prefix_lock, F.substring(F.nullif(common_prefix(a.prefix_lock, b.prefix_lock), F.lit("")), 1, LOCK_CHARS))
    return _other(a, b, path_fact(*[tri_join(a[t], b[t]) for t in TESTS], lock))


def path_meet(a: Column, b: Column) -> Column:
    lock, clash = _longer(a.prefix_lock, b.prefix_lock, lambda x, y: x.startswith(y))
    none = a.bottom | b.bottom | F.coalesce(clash, F.lit(False))
    for t in TESTS:
        none = none | F.coalesce(a[t] != b[t], F.lit(False))
    return F.when(none, path_bottom()).otherwise(path_fact(*[F.coalesce(a[t], b[t]) for t in TESTS], lock))


def path_widen(old: Column, new: Column) -> Column:
    return _other(old, new, path_fact(*[tri_join(old[t], new[t]) for t in TESTS], F.when(old.prefix_lock.eqNullSafe(new.prefix_lock), old.prefix_lock)))


def traversal_safe(a: Column) -> Column:
    """Surely free of '..', and surely relative or under a locked prefix."""
    return ~a.bottom & F.coalesce(~a.dotdot, F.lit(False)) & (F.coalesce(~a.absolute, F.lit(False)) | a.prefix_lock.isNotNull())
