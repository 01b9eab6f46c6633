"""Near-duplicate classes: banded MinHash candidates, sequential Bayesian verification, exact confirmation.

1. Every document becomes its set of word shingles (64-bit hashes), a key of the whole set and a
   signature. Documents of one set are one node from here on, however many there are.
2. Bands of the signature put nodes in buckets. Each node of a bucket is paired with the bucket's
   least node only, so a bucket of m nodes makes m - 1 pairs.
3. A pair's signatures are compared a batch at a time; it is dropped once the posterior probability
   of a similarity at or above the threshold falls under MISS. Survivors are confirmed on full sets.
4. What one star can't settle, the nodes of a bucket that are still in different classes, is dealt
   out in blocks of BLOCK nodes, block against block, and compared there by the same two tests.
   A block emits the links that join classes and nothing else. A class that fills a bucket is
   compared with the bucket's other nodes only, and never with itself.

With 32 bands of 5 rows two sets at similarity 0.8 share a bucket with probability 1 - 3e-6.

Defined cases. Null or empty text and texts without words: an empty set, linked with nothing. Fewer
words than a shingle has: the whole sequence is one shingle. Very long texts: their whole set. Repeated rows and ties: of one class.
Null ids: in their set's class, of which they are never the representative. Empty tables: no rows. Other columns, clashing
names included, are ignored by `classes` and returned untouched by `survivors`.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import ascii_words, bytes_of, discard, id_and_text, in_chunks, rows_to_batch, small_batches, stash, windows, word_hashes
from .components import components

BANDS, ROWS = 32, 5
#: Hashes of a signature that one step of the sequential test compares; its miss probability for each pair and step.
STEP, MISS = 32, 1e-6
#: Nodes that one side of a block comparison holds.
BLOCK = 512
#: Orders of nodes by which buckets choose their leader: a node meets as many different ones of a large class.
LEADERS = 4
#: Rows up to which ids are broadcast (24 bytes each, so 5 MB); beyond them they are joined by a shuffle.
BROADCAST_ROWS = 200_000

_rng = np.random.RandomState(20_11)
_A = (_rng.randint(0, 2**31, BANDS * ROWS, dtype=np.int64) * 2 + 1).astype(np.uint32)
_B = _rng.randint(0, 2**32, BANDS * ROWS, dtype=np.int64).astype(np.uint32)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    return np.unique(windows(word_hashes(ascii_words(text)), words))


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(len(_A), 2**32 - 1, dtype=np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(low, (_A[:, None] * x[None, i : i + 2048] + _B[:, None]).min(axis=1), out=low)
    return low


def least_matches(percent: int, miss: float = MISS) -> list[int]:
    """By step: how many of the hashes so far must match, or else P(similarity >= percent / 100) < miss.

    The posterior under a uniform prior is Beta(m + 1, n - m + 1); its upper tail is a binomial sum.
    """
    t, out = percent / 100, []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def plausible(a: np.ndarray, b: np.ndarray, bounds: list[int]) -> np.ndarray:
    """Which rows of a (k, hashes) may be similar to the rows of b: the sequential test, for many pairs at once."""
    alive = np.arange(len(b))
    matches = np.zeros(len(b), dtype=np.int64)
    for k, bound in enumerate(bounds):
        if not len(alive):
            break
        s = slice(k * STEP, (k + 1) * STEP)
        matches = matches + ((a[alive, s] if a.ndim == 2 else a[s]) == b[alive, s]).sum(axis=1)
        good = matches >= bound
        alive, matches = alive[good], matches[good]
    return alive


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """On full sets, sorted and distinct."""
    small, large = (a, b) if len(a) < len(b) else (b, a)
    if 100 * len(small) < percent * len(large) or not len(small):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


_SKETCH = "doc_id long, n_shingles long, node binary, sig binary"
_SETS = "node binary, shingles binary"


def _key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, node (key of the whole set), sig; node and sig are null for an empty set."""
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], _SKETCH).schema)

    def run(batches):
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), bytes_of(b.column(1)), strict=True):
                s = shingle_set(text, words)
                rows.append((doc_id, len(s), _key(s), signature(s).tobytes()) if len(s) else (doc_id, 0, None, None))
            yield rows_to_batch(rows, schema)

    return docs.mapInArrow(run, _SKETCH)


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node, shingles of the wanted (doc_id, node)s."""
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], _SETS).schema)

    def run(batches):
        def rows():
            for b in batches:
                for text, node in zip(bytes_of(b.column(0)), b.column(1).to_pylist(), strict=True):
                    s = shingle_set(text, words)
                    if len(s) and _key(s) == node:
                        yield node, s.tobytes()

        yield from in_chunks(rows(), schema, weight=lambda r: len(r[1]))

    few = wanted.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(wanted) if few else wanted.hint("merge"), "doc_id").select("text", "node").mapInArrow(run, _SETS)


def _matrix(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint32).reshape(len(column), len(_A))


def _prune(percent: int):
    bounds = least_matches(percent)

    def run(batches):
        for b in batches:
            if b.num_rows:
                keep = plausible(_matrix(b.column(2).to_pylist()), _matrix(b.column(3).to_pylist()), bounds)
                yield pa.RecordBatch.from_arrays([c.take(pa.array(keep)) for c in b.columns[:2]], names=["a", "b"])

    return run


def _confirm(percent: int):
    def run(batches):
        for b in batches:
            x, y = (b.column(i).to_pylist() for i in (2, 3))
            keep = [i for i in range(b.num_rows) if similar(np.frombuffer(x[i], np.uint64), np.frombuffer(y[i], np.uint64), percent)]
            yield pa.RecordBatch.from_arrays([c.take(pa.array(keep, pa.int64())) for c in b.columns[:2]], names=["a", "b"])

    return run


def _by_block(batches, columns: int):
    """Rows of one block together, whatever batches they come in; blocks are sorted."""
    key, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[0] != key and held:
                yield key, held
                held = []
            key = row[0]
            held.append(row[1:columns])
    if held:
        yield key, held


def _partners(percent: int):
    """Of a block's nodes, those that have a plausible partner of another class."""
    bounds = least_matches(percent)
    schema = pa.schema([("block", pa.string()), ("node", pa.binary())])

    def run(batches):
        def rows():
            for block, held in _by_block(batches, 5):
                nodes, labels, sizes, sigs = zip(*held, strict=True)
                sig, n = _matrix(list(sigs)), np.array(sizes)
                _, label = np.unique(np.array([x.hex() for x in labels]), return_inverse=True)
                hit = np.zeros(len(nodes), dtype=bool)
                for i in range(len(nodes) - 1):
                    rest = np.flatnonzero((label[i + 1 :] != label[i]) & (100 * np.minimum(n[i + 1 :], n[i]) >= percent * np.maximum(n[i + 1 :], n[i]))) + i + 1
                    good = rest[plausible(sig[i], sig[rest], bounds)] if len(rest) else rest
                    if len(good):
                        hit[i] = True
                        hit[good] = True
                for i in np.flatnonzero(hit):
                    yield block, nodes[i]

        yield from in_chunks(rows(), schema)

    return run


def _links(percent: int):
    """Of a block's nodes, confirmed links that join classes: at most one less than there are nodes."""
    bounds = least_matches(percent)
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches):
        def rows():
            for _, held in _by_block(batches, 6):
                nodes, labels, _, sigs, sets = zip(*held, strict=True)
                sig, sets = _matrix(list(sigs)), [np.frombuffer(s, np.uint64) for s in sets]
                _, label = np.unique(np.array([x.hex() for x in labels]), return_inverse=True)
                for i in range(len(nodes) - 1):
                    rest = np.arange(i + 1, len(nodes))
                    for j in rest[plausible(sig[i], sig[rest], bounds)]:
                        if label[i] != label[j] and similar(sets[i], sets[j], percent):
                            yield nodes[i], nodes[j]
                            label[label == label[j]] = label[i]

        yield from in_chunks(rows(), schema)

    return run


def _blocks(rest: DataFrame) -> DataFrame:
    """rest (bucket, node, label) -> (block, node, label): each two nodes of a bucket and of different classes share a block.

    In a bucket larger than a block the largest class, which needs no comparison with itself, is cut
    into blocks that meet the blocks of the others; only the others meet each other.
    """
    by_class = rest.groupBy("bucket", "label").agg(F.count("*").alias("c"))
    per = by_class.groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("m"), F.count("*").alias("classes")).where("classes > 1")
    per = stash(per.select("bucket", F.col("top.label").alias("big"), F.ceil(F.col("top.c") / BLOCK).cast("int").alias("ng"), F.ceil((F.col("m") - F.col("top.c")) / BLOCK).cast("int").alias("nr"), "m"), "buckets")
    r = rest.join(per, "bucket").withColumn("h", F.xxhash64("node"))
    name = lambda kind, x, y: F.concat_ws(":", F.lit(kind), F.col("bucket"), x, y)
    one = F.array(name("one", F.lit(0), F.lit(0)))
    g, s = F.pmod("h", "ng"), F.pmod("h", "nr")
    to_others = F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda x: name("gr", g, x))
    to_big = F.transform(F.sequence(F.lit(0), F.col("ng") - 1), lambda x: name("gr", x, s))
    among = F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda x: name("rr", F.least(x, s), F.greatest(x, s)))
    blocks = F.when(F.col("m") <= 2 * BLOCK, one).when(F.col("label") == F.col("big"), to_others).otherwise(F.concat(to_big, among))
    return r.select(F.explode(blocks).alias("block"), "node", "label")


def links(docs: DataFrame, sk: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, label) of every node that has a link; sk: the stashed sketches of docs."""
    reps = stash(sk.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "nodes")
    size = 4 * ROWS
    bucket = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("sig", b * size + 1, F.lit(size))))
    bands = reps.select(F.posexplode(bucket).alias("band", "bucket"), "node")
    first_of = F.min_by("node", F.xxhash64("node", F.col("band") % LEADERS))  # a band's number is the same all over a bucket
    leaders = stash(bands.groupBy("bucket").agg(first_of.alias("leader"), F.count("*").alias("c")).where("c > 1"), "leaders")
    inside = stash(bands.join(leaders, "bucket").where("node <> leader"), "inside")
    of = lambda node, *cols: reps.select(F.col("node").alias(node), *[F.col(c).alias(f"{c}_{node}") for c in cols])
    pairs = inside.select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    sized = pairs.join(of("a", "n", "sig"), "a").join(of("b", "n", "sig"), "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    alive = stash(sized.select("a", "b", "sig_a", "sig_b").mapInArrow(_prune(percent), "a binary, b binary"), "alive")
    found = _confirmed(docs, reps, alive, words, percent)
    discard(alive)
    first = components(found)
    # nodes that have met their bucket's leader only, in buckets that still hold several classes
    rest = inside.where("c > 2").join(first.withColumnRenamed("label", "known"), "node", "left").select("bucket", "node", F.coalesce("known", "node").alias("label"))
    blocks = stash(_blocks(rest), "blocks")
    if blocks.isEmpty():
        return first
    full = blocks.join(reps.select("node", "n", "sig"), "node").select("block", "node", "label", "n", "sig")
    hits = stash(full.repartition("block").sortWithinPartitions("block").mapInArrow(_partners(percent), "block string, node binary"), "hits")
    discard(inside, leaders)
    if hits.isEmpty():
        return first
    sets = stash(_sets(docs, hits.select("node").distinct().join(reps.select("node", "doc_id"), "node"), words), "sets")
    close = blocks.join(hits, ["block", "node"]).join(reps.select("node", "n", "sig"), "node").join(sets, "node").select("block", "node", "label", "n", "sig", "shingles")
    more = stash(close.repartition("block").sortWithinPartitions("block").mapInArrow(_links(percent), "a binary, b binary"), "more")
    discard(blocks, hits, sets, reps)
    return first if more.isEmpty() else components(found.unionByName(more))


def _confirmed(docs: DataFrame, reps: DataFrame, alive: DataFrame, words: int, percent: int) -> DataFrame:
    nodes = alive.select(F.col("a").alias("node")).union(alive.select("b")).distinct()
    sets = stash(_sets(docs, nodes.join(reps.select("node", "doc_id"), "node"), words), "sets")
    both = alive.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    found = stash(both.select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a binary, b binary"), "links")
    discard(sets)
    return found


def classes(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    small_batches(docs.sparkSession)
    texts = id_and_text(docs, id_col, text_col)
    sk = stash(sketches(texts, words), "sketches")
    label = links(texts, sk, words, percent)
    own = sk.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    linked = stash(label.join(own, "node"), "linked")  # only nodes with a link
    least = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    joined = linked.join(stash(least, "least"), "label").select("node", "component_id")
    known = stash(own.join(joined, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id")), "classes")
    discard(linked)
    out = sk.select("doc_id", "n_shingles", "node").join(known, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def survivors(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: of each class the document of the smallest id, and rows of null id."""
    gone = stash(classes(docs, words, percent, id_col, text_col).where("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    few = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, docs[id_col].cast("long") == gone["_gone"], "left_anti")


def op7_minhash_bayes(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, percent=80)
