"""Structural patterns: on trees of order lines, with an oracle, and on the parsed pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F

from ..operators import patterns as pa
from .registry import query

PATTERN = "pattern string, severity string, kind string, text string, relation string, other_kind string, other_text string, same_text boolean, not_relation string, not_kind string, not_text string"
#: pattern, severity, kind, text, relation, other kind, other text, same text, and what suppresses it.
ON_LINES = [
    ("in_air", "HIGH", "RAIL", None, "ancestor", "AIR", None, False, None, None, None),
    ("over_truck", "LOW", "MAIL", None, "descendant", "TRUCK", None, False, None, None, None),
    ("of_ship", "LOW", "FOB", None, "parent", "SHIP", None, False, None, None, None),
    ("has_fob", "MEDIUM", "SHIP", "COD", "child", "FOB", None, False, None, None, None),
    ("then_mail", "LOW", "MAIL", None, "sibling", "MAIL", None, False, None, None, None),
    ("same_below", "HIGH", "AIR", None, "descendant", "RAIL", None, True, None, None, None),
    ("same_above", "HIGH", "TRUCK", "^TAKE", "ancestor", "TRUCK", None, True, "child", "AIR", None),
    ("unless_over", "LOW", "REG AIR", None, None, None, None, False, "descendant", "REG AIR", "NONE$"),
    ("unless_under", "MEDIUM", "REG AIR", "NONE|COD", "ancestor", "MAIL", "N", False, "ancestor", "SHIP", None),
    ("unless_next", "LOW", "SHIP", None, None, None, None, False, "sibling", "RAIL", None),
]
_TREE = "SELECT l_orderkey AS file, {place} AS pre, {last} AS post, CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 2 WHEN 5 THEN 2 ELSE 5 END AS parent, CASE l_suppkey % 7 WHEN 0 THEN 'RAIL' WHEN 1 THEN 'AIR' WHEN 2 THEN 'MAIL' WHEN 3 THEN 'FOB' WHEN 4 THEN 'SHIP' WHEN 5 THEN 'TRUCK' ELSE 'REG AIR' END AS kind, CASE l_partkey % 4 WHEN 0 THEN 'DELIVER IN PERSON' WHEN 1 THEN 'COLLECT COD' WHEN 2 THEN 'NONE' ELSE 'TAKE BACK RETURN' END AS text FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, max(l_partkey) AS l_partkey FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber) l".format(
    place="CASE l_linenumber WHEN 3 THEN 5 WHEN 4 THEN 3 WHEN 5 THEN 4 ELSE l_linenumber END", last="CASE l_linenumber WHEN 1 THEN 7 WHEN 2 THEN 4 WHEN 3 THEN 7 WHEN 4 THEN 3 WHEN 5 THEN 4 ELSE l_linenumber END"
)


def _quoted(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, bool) else f"'{v}'"


_P = "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_quoted, p)) + ")" for p in ON_LINES) + ") v(pattern, severity, kind, wanted, relation, other_kind, other_text, same_text, not_relation, not_kind, not_text))"


def _holds(relation: str, kind: str, text: str, same: str) -> str:
    return f"""EXISTS (SELECT 1 FROM t o WHERE o.file = n.file AND o.kind = {kind} AND ({text} IS NULL OR regexp_matches(o.text, {text})) AND ({same} OR o.text = n.text) AND CASE {relation}
    WHEN 'child' THEN o.parent = n.pre WHEN 'parent' THEN n.parent = o.pre WHEN 'descendant' THEN o.pre > n.pre AND o.pre <= n.post WHEN 'ancestor' THEN o.pre < n.pre AND o.post >= n.pre ELSE o.parent = n.parent AND o.pre > n.pre END)"""


_FOUND = f"""t AS ({_TREE.format(lineitem="lineitem")}), found AS (SELECT DISTINCT p.pattern, p.severity, n.file, n.pre, n.text FROM t n JOIN {_P} p ON p.kind = n.kind
  WHERE (p.wanted IS NULL OR regexp_matches(n.text, p.wanted)) AND (p.relation IS NULL OR {_holds("p.relation", "p.other_kind", "p.other_text", "NOT p.same_text")}) AND (p.not_relation IS NULL OR NOT {_holds("p.not_relation", "p.not_kind", "p.not_text", "true")}))"""


def _on_lines(h):
    nodes = h.spark.sql(_TREE, lineitem=h.base("lineitem"))
    return nodes, h.spark.createDataFrame(ON_LINES, PATTERN)


@query("d01_structural_patterns", f"WITH {_FOUND} SELECT pattern, severity, file, pre, text FROM found")
def _(h):
    return pa.findings(*_on_lines(h), "severity").select("pattern", "severity", "file", "pre", "text")


@query("u15_pattern_records", f"WITH {_FOUND} SELECT p.pattern, p.severity, p.not_relation IS NOT NULL AS suppressible, count(f.file) AS found, count(DISTINCT f.file) AS files FROM {_P} p LEFT JOIN found f ON f.pattern = p.pattern GROUP BY ALL")
def _(h):
    nodes, patterns = _on_lines(h)
    counts = pa.matches(nodes, patterns).groupBy("pattern").agg(F.count(F.lit(1)).alias("found"), F.count_distinct("file").alias("files"))
    out = patterns.join(counts, "pattern", "left")
    return out.select("pattern", "severity", F.col("not_relation").isNotNull().alias("suppressible"), F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("files", F.lit(0)).alias("files"))


#: Elements that hold nothing (fixed values).
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Tree(HTMLParser):
    """Elements of a page in document order: [kind, attributes, pre, post, parent]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.open = [], []

    def handle_starttag(self, tag, attrs):
        pre = len(self.rows) + 1
        self.rows.append([tag, " ".join(f"{k}={v or ''}" for k, v in attrs), pre, pre, self.open[-1] if self.open else None])
        if tag not in VOID:
            self.open.append(pre)

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.rows[self.open[i] - 1][0] == tag), None)
        if at is not None:
            del self.open[at:]

    def result(self):
        for row in reversed(self.rows):
            if row[4]:
                up = self.rows[row[4] - 1]
                up[3] = max(up[3], row[3])
        return self.rows


def _elements(batches):
    for pdf in batches:
        out = []
        for page, html in zip(pdf["page_id"], pdf["html"], strict=True):
            tree = _Tree()
            tree.feed(html or "")
            out += [(page, pre, post, parent, kind, text) for kind, text, pre, post, parent in tree.result()]
        yield pd.DataFrame(out, columns=["file", "pre", "post", "parent", "kind", "text"]).astype({"pre": "int64", "post": "int64", "parent": "Int64"})


def page_nodes(pages):
    """The elements of whole pages as rows; null pages have none."""
    return pages.select("page_id", "html").mapInPandas(_elements, "file long, pre long, post long, parent long, kind string, text string")


ON_PAGES = [
    ("link_in_list", "LOW", "a", "href=http:", "ancestor", "li", None, False, None, None, None),
    ("script_in_body", "MEDIUM", "script", None, "ancestor", "body", None, False, None, None, None),
    ("unlabelled_form", "HIGH", "form", None, None, None, None, False, "descendant", "input", "type=hidden"),
    ("empty_list", "LOW", "ul", None, None, None, None, False, "child", "li", None),
    ("paragraph_runs", "LOW", "p", None, "sibling", "p", None, False, "ancestor", "footer", None),
    ("block_in_block", "LOW", "div", None, "parent", "div", None, True, None, None, None),
]


@query("d01_page_patterns")
def _(h):
    """No SQL: the pages are parsed; held against a recursive walk in the tests."""
    return pa.findings(page_nodes(h.base("pages")), h.spark.createDataFrame(ON_PAGES, PATTERN), "severity")
