"""Exact deduplication by a Grace hash table.

Every partition first folds its own copies, so a text that a third of all rows share leaves each
partition once. The folded groups are dealt out by content digest; a task then reads its bucket,
and where the bucket exceeds the memory budget it is split to spill files by further digest bits,
again and again, until each part fits an open-addressing table, which holds one row of each text where only that row is wanted. The table compares complete
contents: two texts of one digest stay apart.

Defined cases. Null text: the empty text. Null ids: larger than any id; a group of null ids alone
has keep_id null. Ties, several rows of the smallest id: the first by (partition, position) stays. Very long texts: compared whole. Empty
tables: no rows. Extra columns of any name are ignored by `assign` and returned untouched by
`survivors`.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bytes_of, in_chunks, small_batches, stash

#: Bytes of content that one open-addressing table may hold.
TABLE_BYTES = 32_000_000
#: Spill files that one split makes; the deepest split.
FANOUT, DEEPEST = 16, 12


def squash(text: bytes) -> bytes:
    """Each run of [\\x20\\x09-\\x0D] as one space."""
    core = b" ".join(text.split())
    if not core:
        return b" " if text else b""
    return (b" " if text[:1].isspace() else b"") + core + (b" " if text[-1:].isspace() else b"")


class OpenTable:
    """Linear probing over content; slots hold entry numbers."""

    def __init__(self, capacity: int = 64, best=None):
        self.best = best  # an order by which a content keeps its least tag only
        self.slots = np.full(capacity, -1, dtype=np.int64)
        self.digests: list[bytes] = []
        self.contents: list[bytes] = []
        self.tags: list[list] = []
        self.variants: list[int] = []

    def add(self, digest: bytes, content: bytes, tag) -> None:
        if 2 * (len(self.contents) + 1) > len(self.slots):
            self.slots = np.full(2 * len(self.slots), -1, dtype=np.int64)
            for i, d in enumerate(self.digests):
                at = self._home(d)
                while self.slots[at] >= 0:
                    at = (at + 1) & (len(self.slots) - 1)
                self.slots[at] = i
        at, variant = self._home(digest), 0
        while (i := self.slots[at]) >= 0:
            if self.digests[i] == digest:
                if self.contents[i] == content:
                    if self.best:
                        self.tags[i][0] = min(self.tags[i][0], tag, key=self.best)
                    else:
                        self.tags[i].append(tag)
                    return
                variant += 1
            at = (at + 1) & (len(self.slots) - 1)
        self.slots[at] = len(self.contents)
        self.digests.append(digest)
        self.contents.append(content)
        self.tags.append([tag])
        self.variants.append(variant)

    def _home(self, digest: bytes) -> int:
        return int.from_bytes(digest[-8:], "little") & (len(self.slots) - 1)

    def groups(self) -> Iterator[tuple]:
        return zip(self.digests, self.variants, self.contents, self.tags, strict=True)


def grace(records: Iterator[tuple], budget: int = TABLE_BYTES, depth: int = 0, weigh=lambda tag: 0, best=None) -> Iterator[tuple]:
    """(digest, content, tag)s -> (digest, variant, content, [tags]) with one group for each content; with an order `best`, its least tag alone.

    Held in memory: one table of at most `budget` bytes of distinct contents, tags included. At the
    deepest split the table grows as needed, since what is left there differs in no digest bit.
    """
    table, load, files, folder = OpenTable(best=best), 0, None, None
    try:
        for digest, content, tag in records:
            if files is None:
                before = len(table.contents)
                table.add(digest, content, tag)
                new = len(table.contents) > before
                load += (len(content) + 200 if new else 64 * (best is None)) + (weigh(tag) if new or best is None else 0)
                if load > budget and len(table.contents) > 1 and depth < DEEPEST:
                    folder = tempfile.TemporaryDirectory(prefix="grace-")
                    files = [(Path(folder.name) / str(i)).open("w+b") for i in range(FANOUT)]
                    for d, _, c, tags in table.groups():
                        for t in tags:
                            pickle.dump((d, c, t), files[_part(d, depth)], protocol=5)
                    table = OpenTable(best=best)
            else:
                pickle.dump((digest, content, tag), files[_part(digest, depth)], protocol=5)
        if files is None:
            yield from table.groups()
            return
        for f in files:
            f.seek(0)
            yield from grace(_unpickled(f), budget, depth + 1, weigh, best)
            f.close()
    finally:
        if folder:
            for f in files:
                f.close()
            folder.cleanup()


def _part(digest: bytes, depth: int) -> int:
    return (digest[depth // 2] >> (4 * (depth & 1))) & (FANOUT - 1)


def _unpickled(f) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


_LAST = (1 << 63, 1 << 63)


def _order(doc_id: int | None, at: int) -> tuple:
    return (_LAST[0] if doc_id is None else doc_id, at)


_LOCAL = "kind int, doc_id long, digest binary, part int, variant int, first boolean, n long, content binary"


def _fold(budget: int):
    schema = to_arrow_schema(_ddl(_LOCAL))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def records():
            at = 0
            for b in batches:
                for doc_id, text in zip(b.column(0).to_pylist(), bytes_of(b.column(1)), strict=True):
                    content = squash(text)
                    yield hashlib.sha256(content).digest(), content, (doc_id, at)
                    at += 1

        def rows():
            for digest, variant, content, tags in grace(records(), budget):
                best = min(tags, key=lambda t: _order(*t))
                yield 1, best[0], digest, part, variant, True, len(tags), content
                for t in tags:
                    yield 0, t[0], digest, part, variant, t == best, 0, None

        yield from in_chunks(rows(), schema, weight=lambda r: len(r[7] or b""))

    return run


def _ddl(text: str):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(text)


_GLOBAL = "digest binary, part int, variant int, keep_id long, group_size long, wins boolean"


def _settle(budget: int):
    schema = to_arrow_schema(_ddl(_GLOBAL))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for b in batches:
                for doc_id, digest, part, variant, n, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    yield digest, content, (doc_id, part, variant, n)

        def rows():
            for digest, _, _, tags in grace(records(), budget):
                best, n = min(tags, key=lambda t: (*_order(t[0], t[1]), t[2])), sum(t[3] for t in tags)
                for t in tags:
                    yield digest, t[1], t[2], best[0], n, t is best

        yield from in_chunks(rows(), schema)

    return run


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs."""
    small_batches(docs.sparkSession)
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    local = stash(whole.mapInArrow(_fold(table_bytes), _LOCAL), "grace")
    groups = local.where("kind = 1").select("doc_id", "digest", "part", "variant", "n", "content")
    settled = groups.repartition("digest").mapInArrow(_settle(table_bytes), _GLOBAL)
    members = local.where("kind = 0").select("doc_id", "digest", "part", "variant", "first")
    return members.join(settled, ["digest", "part", "variant"]).select(
        "doc_id", "keep_id", "group_size", (F.col("first") & F.col("wins")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each text, that of the smallest id."""
    small_batches(docs.sparkSession)
    packed = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    row = packed.schema["row"].dataType
    mid = "id long, digest binary, part int, at long, text string, row " + row.simpleString()
    mid_arrow = to_arrow_schema(packed.select(F.lit(1).cast("long").alias("id"), F.lit(b"").alias("digest"), F.lit(1).alias("part"), F.lit(1).cast("long").alias("at"), "text", "row").schema)

    def fold(batches):
        part = TaskContext.get().partitionId()

        def records():
            at = 0
            for b in batches:
                ids, texts = b.column(0).to_pylist(), bytes_of(b.column(1))
                for i, (doc_id, text) in enumerate(zip(ids, texts, strict=True)):
                    content = squash(text)
                    yield hashlib.sha256(content).digest(), content, (doc_id, at, text, b.column(2).slice(i, 1).to_pylist()[0])
                    at += 1

        def rows():
            for digest, _, _, ((doc_id, at, text, whole),) in grace(records(), table_bytes, weigh=lambda t: 3 * len(t[2]) + 500, best=lambda t: _order(*t[:2])):
                yield doc_id, digest, part, at, text.decode(), whole

        yield from in_chunks(rows(), mid_arrow, weight=lambda r: 2 * len(r[4]))

    def settle(batches):
        def records():
            for b in batches:
                for doc_id, digest, part, at, text, whole in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    yield digest, squash(text.encode()), (doc_id, part, at, whole, len(text))

        def rows():
            for _, _, _, ((_, _, _, whole, _),) in grace(records(), table_bytes, weigh=lambda t: 3 * t[4] + 500, best=lambda t: (*_order(t[0], t[1]), t[2])):
                yield (whole,)

        yield from in_chunks(rows(), pa.schema([mid_arrow.field("row")]), size=256)

    local = packed.mapInArrow(fold, mid)
    kept = local.repartition("digest").mapInArrow(settle, "row " + row.simpleString())
    return kept.select(*[F.col("row").getField(f.name).alias(f.name) for f in row.fields])


def op3_grace_dedup(spark, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM t
"""
