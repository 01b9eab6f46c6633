"""Text classifiers and redaction, as ordered CASE expressions and patterns of the common regex subset."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Secret patterns, in the order they are applied.
SECRETS = (
    r"AKIA[0-9A-Z]{16}",
    r"gh[pousr]_[A-Za-z0-9]{36,}",
    r"xox[baprs]-[A-Za-z0-9-]{10,}",
    r"sk-[A-Za-z0-9]{20,}",
    r"(?i)bearer +[A-Za-z0-9._~+/-]+=*",
    r"eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+[.][A-Za-z0-9_-]+",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"(?i)(?:password|passwd|secret|api[_-]?key|token) *[:=] *[\"'][^\"']{4,}[\"']",
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+",
)
MARK = "<REDACTED>"


def redact(text: Column) -> Column:
    for p in SECRETS:
        text = F.regexp_replace(text, p, MARK)
    return text


def contains_secret(text: Column) -> Column:
    out = F.lit(False)
    for p in SECRETS:
        out = out | text.rlike(p)
    return out


def _any(text: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"))


def leaf(callee: Column) -> Column:
    return F.substring_index(F.substring_index(callee, "::", -1), ".", -1)


def last_two(callee: Column) -> Column:
    return F.when(F.instr(callee, "::") > 0, F.substring_index(callee, "::", -2)).otherwise(F.substring_index(callee, ".", -2))


def shell_safe(text: Column) -> Column:
    """Free of shell metacharacters, quotes and white space."""
    return ~text.rlike("[;|&`$><()\\n\\r\\\\\"' \\t]")


def path_rejection(text: Column) -> Column:
    """The axes a condition tests a path on."""
    t = F.lower(text)
    return F.array_compact(F.array(F.when(t.contains(".."), "DotDot"), F.when(t.rlike(r"is_?abs|starts_?with\([\"']/"), "Absolute")))


def sql_auth(sql: Column, acl: tuple = ("acl", "permissions", "memberships")) -> Column:
    """How a query text restricts rows to a user."""
    t = F.lower(F.regexp_replace(sql, r"\s+", " "))
    joined = t.rlike(" join (" + "|".join(acl) + r")\b")
    bound = t.rlike(r"\b(user|owner|account)_id ?= ?([?]|\$[0-9]+|:[a-z_]+)")
    return F.when(~t.startswith("select "), "None").when(joined, "AclJoin").when(bound & ~t.contains(" join "), "UserBound").otherwise("None")


def normalise_snippet(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"\s+", " ")


def label(callee: Column, rules: list[tuple[str, str]]) -> Column:
    """The first label whose matcher is the callee or a suffix of it at a '.' or ':' border; '=x' wants x itself, 'x_' is a prefix of the last part."""
    out = None
    for matcher, name in rules:
        if matcher.startswith("="):
            hit = callee == matcher[1:]
        elif matcher.endswith("_"):
            hit = leaf(callee).startswith(matcher)
        else:
            hit = (callee == matcher) | callee.endswith("." + matcher) | callee.endswith(":" + matcher)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out
