"""Names of functions, files, packages and states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .findings import BIT, extension, one_of

#: Names that people read.
DISPLAY = {"rs": "Rust", "c": "C", "cpp": "C++", "java": "Java", "go": "Go", "php": "PHP", "py": "Python", "ts": "TypeScript", "js": "JavaScript", "rb": "Ruby"}
SEVERITIES = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}
TERMINAL = ("false_positive", "accepted_risk", "suppressed", "fixed")
#: Other names of capabilities.
ALIASES = {"data_exfiltration": "data_exfil", "ldapi": "ldap_injection", "xpathi": "xpath_injection", "crlf": "header_injection", "response_splitting": "header_injection", "redirect": "open_redirect", "template_injection": "ssti", "proto_pollution": "prototype_pollution"}
#: Calls that wait for several others, by language.
COMBINATORS = {
    "javascript": {"Promise.resolve": "Resolve", "Promise.all": "All", "Promise.allSettled": "AllSettled", "Promise.race": "Race"},
    "python": {"asyncio.gather": "All", "asyncio.wait": "All"},
    "rust": {"tokio::join": "All", "tokio::try_join": "All", "futures::join": "All", "futures::try_join": "All"},
}
SAME_LANGUAGE = {"js": "javascript", "typescript": "javascript", "ts": "javascript", "tsx": "javascript", "py": "python", "rs": "rust"}


def point(text: Column, offset: Column) -> tuple[Column, Column]:
    """Line from 1 and byte column from 0 of a byte offset."""
    before = F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), offset.cast("int")), "ISO-8859-1")
    lines = F.split(before, "\n")
    return F.size(lines), F.length(F.element_at(lines, -1))


def display_language(path: Column) -> Column:
    return one_of(extension(path), DISPLAY)


def severity_order(severity: Column) -> Column:
    return one_of(F.upper(F.trim(severity)), SEVERITIES)


def parse_capability(name: Column) -> Column:
    """The bit of a capability by any of its names, all bits for 'all'."""
    low = F.lower(name)
    low = F.coalesce(one_of(low, ALIASES), low)
    bits = {n.lower(): b for n, b in BIT.items()}
    return F.when(low == "all", F.lit(sum(bits.values())).cast("long")).otherwise(one_of(low, bits).cast("long"))


def sarif_base(rule: Column) -> Column:
    return F.when(rule.startswith("taint-data-exfiltration"), "taint-data-exfiltration").when(rule.startswith("taint-"), "taint-unsanitised-flow").otherwise(rule)


def with_package(package: Column, namespace: Column) -> Column:
    return F.concat_ws("::", F.nullif(package, F.lit("")), namespace)


def without_package(namespace: Column) -> Column:
    """What stands after the first '::'."""
    return F.when(F.instr(namespace, "::") > 0, F.regexp_replace(namespace, "^.*?::", "")).otherwise(namespace)


def container_hint(callee: Column) -> Column:
    """The part before the last: of '::', else of '.'."""
    of = lambda mark: F.substring_index(F.substring_index(callee, mark, -2), mark, 1)
    return F.when(F.instr(callee, "::") > 0, of("::")).when(F.instr(callee, ".") > 0, of(".")).otherwise("")


def bare_method(callee: Column) -> Column:
    return F.substring_index(callee, ".", -1)


def shorten(callee: Column) -> Column:
    """Up to the bracket that closes the first one, with '…' for what follows."""
    text = F.trim(callee)
    chars = F.split(text, "")
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        depth = s.depth + F.when(c == "(", 1).when((c == ")") & (s.depth > 0), -1).otherwise(0)
        closed = (s.end == 0) & (c == ")") & (s.depth == 1)
        return F.struct((s.at + 1).alias("at"), depth.alias("depth"), F.when(closed, s.at + 1).otherwise(s.end).alias("end"))

    end = F.aggregate(chars, zero, step).end
    return F.when((end > 0) & (end < F.length(text)), F.concat(F.substring(text, F.lit(1), end), F.lit("…"))).otherwise(text)


#: What test files are called.
_TEST_NAMES = (
    r"\.(test|spec)\.(js|ts|jsx|tsx|mjs|cjs)$", r"_tests?\.py$", r"(Tests?|IT)\.java$", r"Test\.php$", r"_(spec|test)\.rb$", r"_test\.go$", r"_tests?\.rs$", r"_test\.(c|cc|cpp|cxx|h|hpp)$", r"(^|/)test_[^/]*\.(py|c|cc|cpp|cxx)$", r"(^|/)conftest\.py$", r"(^|/)__tests__(/|$)",
)


def is_test(path: Column) -> Column:
    return path.rlike("|".join(_TEST_NAMES))


def is_vendored(path: Column) -> Column:
    """Built assets, and front-end files under a vendor directory."""
    low = F.lower(path)
    return low.rlike(r"\.(min\.js|min\.css|bundle\.js|bundled\.js|umd\.js|iife\.js)$|(^|/)bower_components(/|$)") | (low.rlike("(^|/)vendors?/") & low.rlike(r"\.(js|mjs|cjs|jsx|ts|tsx|css|scss|less)$"))


def is_terminal(state: Column) -> Column:
    return F.coalesce(state.isin(*TERMINAL), F.lit(False))


def combinator(lang: Column, callee: Column) -> Column:
    of = F.coalesce(one_of(F.lower(lang), SAME_LANGUAGE), F.lower(lang))
    out = None
    for name, calls in COMBINATORS.items():
        hit = one_of(callee, calls)
        out = F.when(of == name, hit) if out is None else out.when(of == name, hit)
    return out
