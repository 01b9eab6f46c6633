"""Queries that read source text: the Python front end over snippets, directives in lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frontend.python_flows import facts, findings
from .registry import query

def program():
    """A small program for each document, by rule of its id; flows within a file and over files."""
    k = F.col("doc_id") % 4
    body = F.when(k == 0, "os.system(x)").when(k == 1, F.concat(F.lit("entry_"), F.col("doc_id") - 1, F.lit("(x)"))).when(k == 2, "return int(x)").otherwise("eval(request.args.get('q'))")
    head, main = F.lit("import os\n\ndef entry_"), F.lit("\n\ndef main_")
    return F.concat(head, F.col("doc_id"), F.lit("(x):\n    "), body, main, F.col("doc_id"), F.lit("():\n    entry_"), F.col("doc_id"), F.lit("(input())\n"))


def programs(h):
    return h.base("documents").select(F.concat(F.lit("pkg/m"), F.col("doc_id"), F.lit(".py")).alias("path"), F.encode(program(), "UTF-8").alias("content"))


@query("s03_python_facts", "SELECT 'pkg/m' || doc_id || '.py' AS path, 2::BIGINT AS functions FROM documents")
def _(h):
    return facts(programs(h)).where("kind = 'function' AND function <> '<module>'").groupBy("path").agg(F.count("*").alias("functions"))


@query("g28_taint_findings", """
SELECT 'pkg/m' || doc_id || '.py' AS path, 7 AS line, 'main_' || doc_id AS function, 1024::BIGINT AS cap, 7 AS source_line, (1 + doc_id % 4)::INT AS hops FROM documents d WHERE doc_id % 4 = 0 OR doc_id % 4 = 1 AND EXISTS (SELECT 1 FROM documents b WHERE b.doc_id = d.doc_id - 1)
UNION ALL SELECT 'pkg/m' || doc_id || '.py', 4, 'entry_' || doc_id, 1024, 4, 0 FROM documents WHERE doc_id % 4 = 3""")
def _(h):
    return findings(programs(h))


@query("f11_inline_directives", "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n)::INT AS k, line LIKE '%.' AS ends FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) WHERE line LIKE 'The %'")
def _(h):
    from ..functions.suppress import directives

    return directives(h.base("documents"), "doc_id", "text", "^The ").select("doc_id", "k", F.col("line").endswith(".").alias("ends"))
