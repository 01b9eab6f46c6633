"""What the training-data operators share: sessions, shared storage, tokens and hashes."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch holds at most. A batch of very long documents stays far below a worker's memory.
BATCH_ROWS = 256
#: Bytes beyond which a batch takes no further row.
BATCH_BYTES = 16_000_000
#: Entries of a worker's word cache; when it is full it starts anew.
CACHE_WORDS = 150_000


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes: documents differ in length by four orders of magnitude."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local one is set only where none is named and there is one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="ckpt-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def stash(df: DataFrame, what: str, by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stash-{what}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete stashes that no later plan reads."""
    for df in frames:
        path = getattr(df, "stash_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            with contextlib.suppress(Exception):  # what stays behind is only disk
                where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with a null text as the empty one; other columns, clashing names included, are dropped."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def bytes_of(column: pa.Array) -> list[bytes]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


class WordHashes(dict):
    """word (bytes) -> 64-bit hash; a bounded cache of one worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """uint64 hashes of words, in order."""
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


#: Odd 64-bit multipliers for sequence hashes and the finaliser (fixed values).
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * M1
    h ^= h >> np.uint64(29)
    h = h * M2
    h ^= h >> np.uint64(32)
    return h


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` items; a shorter sequence counts as one run, an empty one has none."""
    n = len(h)
    if not n:
        return h
    width_here = min(width, n)
    out = mix(h[: n - width_here + 1] + np.uint64(width_here))
    for i in range(1, width_here):
        out = mix(out * M2 + h[i : n - width_here + 1 + i])
    return out


#: Lower-case A-Z alone, on UTF-8 bytes: bytes.lower() does just that.
def ascii_words(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a text whose A-Z are lower-cased."""
    return text.lower().split()


def rows_to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def in_chunks(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096, mb: float = 8, weight=lambda r: 0) -> Iterator[pa.RecordBatch]:
    """Batches of bounded rows and bytes."""
    some: list[tuple] = []
    load = 0
    for r in rows:
        some.append(r)
        load += weight(r)
        if len(some) >= size or load >= mb * 1e6:
            yield rows_to_batch(some, schema)
            some, load = [], 0
    yield rows_to_batch(some, schema)


def pass_rows(docs: DataFrame, text_col: str, decide) -> DataFrame:
    """The rows of docs for which decide(list of texts as bytes) says True, with all their columns and no shuffle."""
    packed = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    row = packed.schema["row"].dataType

    def run(batches):
        for b in batches:
            mask = decide(bytes_of(b.column(0)))
            yield pa.RecordBatch.from_arrays([b.column(1).filter(pa.array(mask, pa.bool_()))], names=["row"])

    kept = packed.mapInArrow(run, "row " + row.simpleString())
    return kept.select(*[F.col("row").getField(f.name).alias(f.name) for f in row.fields])


def frequent_join(left: DataFrame, right: DataFrame, keys: list[str], rows_col: str, most: int) -> DataFrame:
    """left with the columns of right, which has one row for each key of left (nulls included) and in rows_col how many rows of left have it.

    Keys that hold a share of 1 / most of the rows or more, `most` keys at the most, are broadcast; what then shuffles has no frequent key.
    """
    total = right.agg(F.sum(rows_col)).first()[0] or 0
    values = [c for c in right.columns if c not in (*keys, rows_col)]
    fields = F.struct(*values)
    often = right.where(F.col(rows_col) * most >= total).select(*[F.col(k).alias("often_" + k) for k in keys], fields.alias("often_values"))
    seldom = right.where(F.col(rows_col) * most < total).select(*[F.col(k).alias("seldom_" + k) for k in keys], fields.alias("seldom_values"))

    def on(df, kind):
        test = F.lit(True)
        for k in keys:
            test = test & df[k].eqNullSafe(F.col(f"{kind}_{k}"))
        return test

    first = left.join(F.broadcast(often), on(left, "often"), "left")
    have = F.col("often_values").isNotNull()
    rest = first.where(~have)
    done = first.where(have).select(*left.columns, "often_values.*")
    return done.unionByName(rest.join(seldom, on(rest, "seldom"), "inner").select(*left.columns, "seldom_values.*"))
