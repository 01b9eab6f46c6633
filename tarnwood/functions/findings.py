"""Column functions on findings: ordinals, identities, families, predicates on paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values. High is the smallest severity, Low the smallest confidence.
SEVERITIES = ("HIGH", "MEDIUM", "LOW")
CONFIDENCES = ("Low", "Medium", "High")

#: Capability bits in order.
CAPABILITIES = (
    "ENV_VAR", "HTML_ESCAPE", "SHELL_ESCAPE", "URL_ENCODE", "JSON_PARSE", "FILE_IO", "FMT_STRING", "SQL_QUERY", "DESERIALIZE", "SSRF", "CODE_EXEC",
    "CRYPTO", "UNAUTHORIZED_ID", "DATA_EXFIL", "LDAP_INJECTION", "XPATH_INJECTION", "HEADER_INJECTION", "OPEN_REDIRECT", "SSTI", "XXE", "PROTOTYPE_POLLUTION",
)
BIT = {name: 1 << i for i, name in enumerate(CAPABILITIES)}

#: Rule, capability, severity, OWASP code of the capability rules, in order.
CAPABILITY_RULES = (
    ("taint-path-traversal", "FILE_IO", "HIGH", "A01"),
    ("taint-format-string", "FMT_STRING", "HIGH", "A03"),
    ("taint-sql-injection", "SQL_QUERY", "HIGH", "A03"),
    ("taint-deserialization", "DESERIALIZE", "HIGH", "A08"),
    ("taint-ssrf", "SSRF", "HIGH", "A10"),
    ("taint-code-execution", "CODE_EXEC", "HIGH", "A03"),
    ("taint-crypto-misuse", "CRYPTO", "MEDIUM", "A02"),
    ("rs.auth.missing_ownership_check.taint", "UNAUTHORIZED_ID", "HIGH", "A01"),
    ("taint-data-exfiltration", "DATA_EXFIL", "HIGH", "A04"),
    ("taint-ldap-injection", "LDAP_INJECTION", "HIGH", "A03"),
    ("taint-xpath-injection", "XPATH_INJECTION", "HIGH", "A03"),
    ("taint-header-injection", "HEADER_INJECTION", "HIGH", "A03"),
    ("taint-open-redirect", "OPEN_REDIRECT", "MEDIUM", "A01"),
    ("taint-template-injection", "SSTI", "HIGH", "A03"),
    ("taint-xxe", "XXE", "HIGH", "A05"),
    ("taint-prototype-pollution", "PROTOTYPE_POLLUTION", "HIGH", "A05"),
)
#: OWASP code of rule families.
FAMILY_OWASP = {
    "auth": "A01", "csrf": "A01", "mass_assign": "A01", "path": "A01", "redirect": "A01", "crypto": "A02", "secrets": "A02", "sqli": "A03", "xss": "A03", "cmdi": "A03", "code_exec": "A03", "template": "A03", "nosql": "A03",
    "ldap": "A03", "xpath": "A03", "header": "A03", "reflection": "A03", "taint": "A03", "memory": "A04", "state": "A04", "config": "A05", "transport": "A05", "prototype": "A05", "xxe": "A05", "deser": "A08", "log": "A09", "ssrf": "A10",
}
#: Language of file extensions.
LANGUAGES = {"rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "java": "java", "go": "go", "php": "php", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "rb": "ruby"}


def one_of(value: Column, table: dict, otherwise=None) -> Column:
    """A CASE over a small fixed table."""
    out = None
    for k, v in table.items():
        out = F.when(value == k, F.lit(v)) if out is None else out.when(value == k, F.lit(v))
    return out.otherwise(F.lit(otherwise))


def severity_rank(severity: Column) -> Column:
    return one_of(severity, {s: i for i, s in enumerate(SEVERITIES)})


def confidence_rank(confidence: Column) -> Column:
    return one_of(confidence, {c: i for i, c in enumerate(CONFIDENCES)})


def canonical_rule(rule: Column) -> Column:
    """Without the source position at the end."""
    return F.trim(F.substring_index(rule, " (", 1))


def family(rule: Column) -> Column:
    """The second dotted token, else the first dashed one."""
    return F.when(F.instr(rule, ".") > 0, F.split(rule, "[.]")[1]).otherwise(F.substring_index(rule, "-", 1))


def owasp(rule: Column) -> Column:
    """A capability rule's code, if the id is the rule's or goes on with a space, bracket or dot; else the family's."""
    exact = None
    for name, _, _, code in CAPABILITY_RULES:
        hit = (rule == name) | F.substring(rule, 1, len(name) + 1).isin(name + " ", name + "(", name + ".")
        exact = F.when(hit, code) if exact is None else exact.when(hit, code)
    return F.coalesce(exact, one_of(family(rule), FAMILY_OWASP))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language(path: Column) -> Column:
    return one_of(extension(path), LANGUAGES)


#: Interpreters, and what the first lines of a file without extension begin with, in order.
INTERPRETERS = {"python": "python", "node": "javascript", "nodejs": "javascript", "deno": "javascript", "bun": "javascript", "ts": "typescript", "tsx": "typescript", "ruby": "ruby", "php": "php"}
OPENINGS = (
    (r"<\?php", "php"), (r"package main", "go"), (r"package .*;\s*$", "java"), (r"import java\.|public class ", "java"), (r"from __future__|from typing |def .*:", "python"),
    (r"fn main|use std::", "rust"), (r"func .*\(", "go"), (r"require |require_relative ", "ruby"), (r"function |const |import \{|export ", "javascript"),
)
HEAD_CHARS, HEAD_LINES = 200, 20


def interpreter(head: Column) -> Column:
    """The language of a #! line: the first word's last part, or with env the first word that is no option."""
    words = F.split(F.trim(F.regexp_extract(head, r"^#!([^\n]*)", 1)), r"\s+")
    first = F.substring_index(words[0], "/", -1)
    other = F.element_at(F.filter(F.slice(words, 2, 100), lambda w: ~w.startswith("-")), 1)
    return one_of(F.regexp_extract(F.when(first == "env", other).otherwise(first), "^([A-Za-z]*)", 1), INTERPRETERS)


def opening(head: Column) -> Column:
    """The language of the first line among the first that begins as one does."""
    lines = F.slice(F.split(F.regexp_replace(F.substring(head, 1, HEAD_CHARS), r"^#![^\n]*\n?", ""), "\n"), 1, HEAD_LINES)

    def of(line: Column) -> Column:
        out = None
        for pattern, lang in OPENINGS:
            hit = line.rlike(r"^\s*(" + pattern + ")")
            out = F.when(hit, lang) if out is None else out.when(hit, lang)
        return out

    return F.try_element_at(F.array_compact(F.transform(lines, of)), F.lit(1))


def language_of(path: Column, head: Column) -> Column:
    """By extension, else by interpreter, else by content."""
    return F.coalesce(language(path), interpreter(head), opening(head))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 over parts joined by NUL: stays when a finding moves."""
    return F.sha2(F.concat_ws("\u0000", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def cap_labels(bits: Column) -> Column:
    names = F.array(*[F.struct(F.lit(b).cast("long").alias("bit"), F.lit(n).alias("name")) for n, b in BIT.items()])
    return F.transform(F.filter(names, lambda x: bits.bitwiseAND(x["bit"]) != 0), lambda x: x["name"])


def lowest_bit(bits: Column) -> Column:
    return bits.bitwiseAND(-bits)


def parent_dir(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def ancestors(path: Column) -> Column:
    """All directories above a path, the root as ''."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def nonprod(path: Column) -> Column:
    """Tests, benches, examples and the like, by any directory above."""
    return path.rlike("(^|/)(tests|test|__tests__|benches|benchmarks|examples|build|scripts|docs|js_tests|fixtures|vendor)/") | path.rlike(r"(^|/)build\.rs$|\.min\.js$")


def downgrade(severity: Column) -> Column:
    return F.when(severity == "HIGH", "MEDIUM").otherwise("LOW")


def sanitizer_status(sanitizers: Column, suppressed: Column) -> Column:
    return F.when(sanitizers == 0, "none").when(suppressed, "applied").otherwise("bypassed")
