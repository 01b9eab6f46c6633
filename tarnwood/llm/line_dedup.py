"""Line deduplication by a log-template tree.

A line's tokens that hold a digit are variable fields, <*>. A fixed-depth path leads to a leaf of the tree: the number of
tokens, then 3 leading tokens and one more for every 8 tokens of length. In a leaf a line joins the template it shares most
tokens with, at least SIMILAR of them, and positions that differ become <*> too; otherwise it starts a template. A template
found in LEAST_DOCS documents or more recurs, and its lines are dropped from all documents.

Tasks first fold equal masked lines, so a line that a third of all documents hold leaves each task once; leaves are dealt
out by their path. Lines of a leaf come in sorted order, so templates don't depend on partitioning. A line is held against every template
of its leaf that it can join, whatever their number: a template that shares m of n tokens shares one of any n - m + 1, so the places where the line's
tokens are in fewest templates lead to all of them. Hashes of dropped lines are broadcast up to SHARD of them, beyond it they are joined with the texts' lines: one pass either way.

Defined cases. Null text: empty. A text without line ends is one line; blank lines are never templates and stay. A
line repeated in one document counts once for it. Repeated rows count as documents of their own; null ids too, and are returned as null. Very long texts: all their lines.
Ties between templates: the oldest. Empty tables: no rows. Columns of other names, clashing ones included, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_and_text, in_chunks, rows_to_batch, small_batches, stash

LEAST_DOCS, SIMILAR, LEADING, DEEPER = 3, 0.7, 3, 8
#: Hashes in a broadcast at most (8 bytes each, 16 for counting); masked lines that a task folds at once, in characters.
SHARD, FOLD = 1_000_000, 8_000_000
_FIELD = re.compile(r"\S*[0-9]\S*")
_DIGIT = re.compile(r"[0-9]").search
WILD = "<*>"
_NONE: frozenset[int] = frozenset()


def mask(line: str) -> str:
    """Tokens parted by one space, variable fields as <*>."""
    return " ".join((_FIELD.sub(WILD, line) if _DIGIT(line) else line).split())


def path(masked: str) -> int:
    """The leaf of a masked line, as a hash of its path."""
    n = masked.count(" ") + 1
    lead = masked.split(" ", k := LEADING + n // DEEPER)[:k]
    return xxhash.xxh64_intdigest(f"{n} {' '.join(lead)}") - 2**63


def line_hash(masked: str) -> int:
    return xxhash.xxh64_intdigest(masked) - 2**63


def grow(lines: list[tuple[str, int]]) -> list[tuple[list[str], list[str], int]]:
    """(masked line, documents) of one leaf, sorted -> (template, its masked lines, documents at most)."""
    found: list[list] = []
    by_token: dict[tuple[int, str], set[int]] = {}  # templates with a token at a place
    for masked, n in lines:
        tokens = masked.split(" ")
        best, most = None, SIMILAR * len(tokens)
        few = sorted((by_token.get(x, _NONE) for x in enumerate(tokens)), key=len)[: len(tokens) - ceil(most) + 1]
        for i in sorted(set().union(*few)):
            same = sum(map(str.__eq__, found[i][0], tokens))
            if same >= most and (best is None or same > most):
                best, at, most = found[i], i, same
        if best is None:
            for x in enumerate(tokens):
                by_token.setdefault(x, set()).add(len(found))
            found.append([tokens, [masked], n])
        else:
            for j, (a, b) in enumerate(zip(best[0], tokens, strict=True)):
                if a != b and a != WILD:
                    by_token[j, a].discard(at)
                    by_token.setdefault((j, WILD), set()).add(at)
            best[0] = [a if a == b else WILD for a, b in zip(best[0], tokens, strict=True)]
            best[1].append(masked)
            best[2] += n
    return [tuple(t) for t in found]


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("leaf", pa.int64()), ("masked", pa.string()), ("n", pa.int64())])

    def rows():
        held: dict[str, int] = {}
        load = 0
        for b in batches:
            for text in b.column(0).to_pylist():
                for m in {m for line in text.split("\n") if (m := mask(line))}:
                    if m in held:
                        held[m] += 1
                    else:
                        held[m] = 1
                        load += len(m) + 60
                if load > FOLD:
                    yield from ((path(m), m, n) for m, n in held.items())
                    held, load = {}, 0
        yield from ((path(m), m, n) for m, n in held.items())

    yield from in_chunks(rows(), schema, weight=lambda r: len(r[1]))


def _tree(least: int):
    schema = pa.schema([("hash", pa.int64()), ("template", pa.string()), ("members", pa.int64()), ("n", pa.int64())])

    def run(batches):
        def leaves():
            leaf, held = None, {}
            for b in batches:
                for key, masked, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if key != leaf and held:
                        yield held
                        held = {}
                    leaf = key
                    held[masked] = held.get(masked, 0) + n
            if held:
                yield held

        def rows():
            for held in leaves():
                if sum(held.values()) >= least:
                    for template, members, n in grow(sorted(held.items())):
                        if n >= least:
                            for m in members:
                                yield line_hash(m), " ".join(template), len(members), n

        yield from in_chunks(rows(), schema, weight=lambda r: len(r[1]))

    return run


def _held(df: DataFrame, *cols: str) -> list[np.ndarray]:
    got = df.select("hash", *cols).toArrow()
    order = np.argsort(got.column("hash").to_numpy())
    return [got.column(c).to_numpy()[order] for c in ("hash", *cols)]


def _line_rows(texts: DataFrame) -> DataFrame:
    """key, hash: the distinct masked lines of each row of (key, text)."""
    schema = pa.schema([("key", pa.int64()), ("hash", pa.int64())])

    def run(batches):
        def rows():
            for b in batches:
                for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for m in {m for line in text.split("\n") if (m := mask(line))}:
                        yield key, line_hash(m)

        yield from in_chunks(rows(), schema, size=65_536)

    return texts.select("key", "text").mapInArrow(run, "key long, hash long")


def _documents_of(texts: DataFrame, several: DataFrame) -> DataFrame:
    """t, docs: in how many rows of texts a template of several lines is; a row counts once, whatever number of its lines."""
    if several.count() > SHARD:  # by a join: rows of one text hold the same lines, so they are counted together
        lines = _line_rows(texts.withColumn("key", F.xxhash64("text"))).groupBy("key", "hash").agg(F.count("*").alias("n"))
        return lines.join(several.select("hash", "t"), "hash").groupBy("key", "t").agg(F.max("n").alias("n")).groupBy("t").agg(F.sum("n").alias("docs"))
    held = texts.sparkSession.sparkContext.broadcast(_held(several, "t"))

    def run(batches):
        hashes, ids = held.value
        known = dict(zip(hashes.tolist(), ids.tolist(), strict=True))
        out: dict[int, int] = {}
        for b in batches:
            for text in b.column(0).to_pylist():
                for t in {t for line in text.split("\n") if (m := mask(line)) and (t := known.get(line_hash(m))) is not None}:
                    out[t] = out.get(t, 0) + 1
        yield rows_to_batch(list(out.items()), pa.schema([("t", pa.int64()), ("docs", pa.int64())]))

    return texts.select("text").mapInArrow(run, "t long, docs long").groupBy("t").agg(F.sum("docs").alias("docs"))


def recurring(docs: DataFrame, least: int = LEAST_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """hash, template, n: the masked lines of recurring templates, and in how many documents a template is."""
    small_batches(docs.sparkSession)
    texts = id_and_text(docs, id_col, text_col).select("text")
    lines = texts.mapInArrow(_lines, "leaf long, masked string, n long")
    found = lines.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(_tree(least), "hash long, template string, members long, n long")
    found = stash(found.select("hash", F.xxhash64("template").alias("t"), "template", "members", "n"), "templates")
    one, several = found.where("members = 1"), found.where("members > 1")
    if several.isEmpty():
        return one.select("hash", "template", "n")
    # a document may hold several lines of one template: count documents, not lines
    exact = _documents_of(texts, several).where(F.col("docs") >= least)
    out = stash(one.select("hash", "template", "n").unionByName(several.join(exact, "t").select("hash", "template", F.col("docs").alias("n"))), "recurring")
    discard(found)
    return out


def clean(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text without the dropped lines, n_lines, n_dropped."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])
    texts = id_and_text(docs, id_col, text_col)
    few = dropped.count() <= SHARD
    if few:
        texts = texts.withColumn("gone", F.lit(None).cast("array<long>"))
        held = docs.sparkSession.sparkContext.broadcast(_held(dropped)[0])
    else:  # each text with the hashes that it loses; texts of one key share them, and a line is dropped for its own hash only
        texts, held = texts.withColumn("key", F.xxhash64("text")), None
        of_text = _line_rows(texts).join(dropped.select("hash"), "hash", "left_semi").groupBy("key").agg(F.collect_set("hash").alias("gone"))
        texts = texts.join(of_text, "key", "left").select("doc_id", "text", "gone")

    def run(batches):
        every = set(held.value.tolist()) if held else None
        for b in batches:
            rows = []
            for doc_id, text, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                gone = every if every is not None else set(own or ())
                lines = text.split("\n")
                keep = [x for x in lines if not ((m := mask(x)) and line_hash(m) in gone)]
                rows.append((doc_id, "\n".join(keep), len(lines), len(lines) - len(keep)))
            yield from in_chunks(iter(rows), schema, weight=lambda r: len(r[1]))

    return texts.mapInArrow(run, "doc_id long, text string, n_lines long, n_dropped long")


def op4_template_lines(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return clean(docs, recurring(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("clean_sha256"))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
