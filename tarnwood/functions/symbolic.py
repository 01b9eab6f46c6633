"""Symbolic values as columns, (literal, text): folded while every operand is a known literal, else told as a call of what they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(value: Column) -> Column:
    return F.struct(value.cast("string").alias("literal"), value.cast("string").alias("text"))


def symbol(name: Column) -> Column:
    return F.struct(F.lit(None).cast("string").alias("literal"), name.cast("string").alias("text"))


def _call(name: str, *of: Column) -> Column:
    return F.concat(F.lit(name + "("), F.concat_ws(", ", *of), F.lit(")"))


def _folded(value: Column, otherwise: Column, *operands: Column) -> Column:
    every = F.lit(True)
    for x in operands:
        every = every & x.literal.isNotNull()
    return F.when(every, known(value)).otherwise(symbol(otherwise))


def concat(a: Column, b: Column) -> Column:
    return _folded(F.concat(a.literal, b.literal), _call("concat", a.text, b.text), a, b)


def trim(a: Column) -> Column:
    return _folded(F.regexp_replace(a.literal, r"^\s+|\s+$", ""), _call("trim", a.text), a)


def lower(a: Column) -> Column:
    return _folded(F.lower(a.literal), _call("lower", a.text), a)


def upper(a: Column) -> Column:
    return _folded(F.upper(a.literal), _call("upper", a.text), a)


def replace(a: Column, what: Column, by: Column) -> Column:
    """All places of a literal; an empty one is left symbolic."""
    return F.when(F.coalesce(F.length(what.literal) == 0, F.lit(False)), symbol(_call("replace", a.text, what.text, by.text))).otherwise(_folded(F.replace(a.literal, what.literal, by.literal), _call("replace", a.text, what.text, by.text), a, what, by))


def substring(a: Column, start: Column, length: Column) -> Column:
    """From a place counted from 0; what is beyond the end is empty."""
    return _folded(F.substring(a.literal, start + 1, length), _call("substring", a.text, start.cast("string"), length.cast("string")), a)


def length(a: Column) -> Column:
    return _folded(F.length(a.literal).cast("string"), _call("length", a.text), a)


#: How each kind of text is escaped, mark by mark, in order.
HTML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
SQL = (("'", "''"),)


def _each(text: Column, pairs) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def encoded(kind: Column, text: Column) -> Column:
    """For people to read in a witness: html, url, shell, sql or base64."""
    shell = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'"))
    url = F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    return F.when(kind == "html", _each(text, HTML)).when(kind == "url", url).when(kind == "shell", shell).when(kind == "sql", _each(text, SQL)).when(kind == "base64", F.base64(F.encode(text, "UTF-8")))


def decoded(kind: Column, text: Column) -> Column:
    """url (a plus is a space) or base64 (with or without padding); null for what doesn't decode, and for html, sql and shell, whose escapes a witness never takes back."""
    bare = F.regexp_replace(text, "=+$", "")
    full = F.rpad(bare, (F.length(bare) + F.pmod(-F.length(bare), F.lit(4))).cast("int"), F.lit("="))
    return F.when(kind == "url", F.try_url_decode(text)).when(kind == "base64", F.try_validate_utf8(F.try_to_binary(full, F.lit("base64")).cast("string")))
