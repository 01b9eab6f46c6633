"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence has probability sigmoid(bias + weights of its distinct words' features); a document's is the
noisy-or of its sentences, 1 - prod(1 - p). The document likelihood trains both, so weights settle
on the words that make sentences offend, and `locate` points at them. Features are whole words
and word beginnings of 3 to 8 letters, which carry a stem to other forms; all of them are kept, each in
one of 2^BITS hashed places.

The model is fitted on all labelled rows of the chosen folds and on their whole texts. Up to DRIVER_CHARS of them are numbered and descended on the driver; beyond that they stay
on the executors as blocks of numbers, and each step sends the weights that are not 0 out and adds up the tasks' gradients. Gradients are added as whole multiples of GRAIN, so
the order in which tasks end changes nothing. Beginnings are numbered as a tree, so each is worked on once for all words that share it. The number of steps and the
penalty were chosen by training on remainder 0 of the ids' hash and testing on remainder 2, and the other way round.

Defined cases. Null, empty or wordless text: no sentence, score 0. Repeated rows: scored alike; null ids: scored and returned as null, `held_out` null too. Very long
texts: scored whole. Several labels of one id: the largest counts; null labels and ids: not trained on. No label or no
positive one: every score is that of a bias alone. Ties: equal texts have equal scores. Empty tables: no rows. Labels, language, source
and id are no inputs of a score. `score` and `locate` return the columns they name and ignore others, clashing names included; `survivors` returns all untouched.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, pass_rows, rows_to_batch, small_batches, stash

#: Characters up to which the driver trains by itself; those of a block, and tasks that hold the blocks, no more than there are cores: each sends 2^BITS numbers a step.
DRIVER_CHARS, BLOCK_CHARS, TASKS = 8_000_000, 12_000_000, 32
#: Labelled ids up to which they are broadcast to the texts.
BROADCAST_ROWS = 2_000_000
GRAIN = 2.0**-30
BITS, STEPS, PENALTY = 18, 200, 0.2
THRESHOLD, OFFENDS = 0.7, 0.5
#: The held-out third: this remainder of crc32(id) by 3.
FOLDS, HELD_OUT = 3, 1
CACHE = 150_000

_SENTENCE = re.compile(r"[^.!?\n]+")
_SENTENCES = re.compile(r"[.!?\n]+").split
_EDGES = ".,;:!?\"'()[]{}<>|*%&#$@+-=_~^/\\`"


def features(word: str) -> list[int]:
    """The places of a whole word and of its beginnings; without marks at its edges."""
    w = word.strip(_EDGES)
    return [_place(f) for f in (w, *("^" + w[:k] for k in range(3, min(9, len(w)))))] if w else []


def _place(feature: str) -> int:
    return zlib.crc32(feature.encode()) & (1 << BITS) - 1


def sentences(text: str) -> list[list[str]]:
    """The distinct words of each sentence that has any."""
    return [s for x in _SENTENCES(text) if (s := list(dict.fromkeys(x.lower().split())))]


class _Heads(dict):
    """beginning -> sum of its own weight and those of the shorter ones; a bounded cache."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        at = np.flatnonzero(weights)
        self.known = dict(zip(at.tolist(), weights[at].tolist(), strict=True))

    def __missing__(self, head: str) -> float:
        x = self.known.get(_place("^" + head), 0.0) + (self[head[:-1]] if len(head) > 3 else 0.0)
        if len(self) >= CACHE:
            self.clear()
        self[head] = x
        return x


class _Weights(dict):
    """word -> sum of its features' weights; a bounded cache."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.heads = _Heads(weights)

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        w = word.strip(_EDGES)
        x = self.heads.known.get(_place(w), 0.0) if w else 0.0
        if len(w) > 3:
            x += self.heads[w[: min(8, len(w) - 1)]]
        self[word] = x
        return x


@dataclass
class Model:
    bias: float = -9.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))

    def __post_init__(self):
        self.of = _Weights(self.weights)

    def __getstate__(self):
        return {"bias": self.bias, "weights": self.weights}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def odds(self, some: list[list[str]]) -> np.ndarray:
        """log-odds of sentences; the same in every order of their words."""
        of = self.of.__getitem__
        return self.bias + np.array([math.fsum(map(of, s)) for s in some])

    def score(self, text: str) -> float:
        some = sentences(text)
        return float(-np.expm1(-np.logaddexp(0, self.odds(some)).sum())) if some else 0.0

    def spans(self, text: str, least: float = OFFENDS) -> list[tuple[int, int, float]]:
        """(start, end, p) of the sentences with p >= least, in code points, without white space at their edges."""
        found = [(m, s) for m in _SENTENCE.finditer(text) if (s := list(dict.fromkeys(m[0].lower().split())))]
        p = 1 / (1 + np.exp(-self.odds([s for _, s in found]))) if found else []
        return [(m.start() + len(m[0]) - len(m[0].lstrip()), m.start() + len(m[0].rstrip()), float(x)) for (m, _), x in zip(found, p, strict=True) if x >= least]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int | None = None, train_chars: int | None = None, folds: tuple[int, ...] = (0, 2), driver_chars: int = DRIVER_CHARS) -> Model:
    """A model of all labelled rows whose ids' hash has one of these remainders; train_docs and train_chars are for callers that want fewer, in the order of a hash of their ids."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic is not null")
    known = known.where((F.crc32(F.col("id").cast("string")) % FOLDS).isin(*folds)).groupBy("id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where((F.crc32(F.col("id").cast("string")) % FOLDS).isin(*folds))
    if train_docs is not None or train_chars is not None:
        known = _bounded(texts, known, train_docs, train_chars)
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    told = Observation()
    rows = texts.join(known, "id").select("id", (F.col("toxic") > 0).cast("int").alias("y"), "text")
    rows = stash(rows.observe(told, F.sum(F.length("text")).alias("chars"), F.max("y").alias("any")), "labelled")
    if not told.get["any"]:
        discard(rows)
        return Model()
    chars = told.get["chars"] or 0
    if chars <= driver_chars:
        got = rows.mapInArrow(lambda batches: map(_bags, batches), _BAGS)
        model = train(got.toArrow())
    else:
        n = min(TASKS, spark.sparkContext.defaultParallelism, -(-chars // BLOCK_CHARS))
        blocks = rows.coalesce(n).mapInArrow(_blocks, "block binary").rdd.map(lambda r: pickle.loads(r.block)).persist(StorageLevel.DISK_ONLY)
        model = descend(lambda w, bias: _added(blocks, w, bias))
        blocks.unpersist()
    discard(rows)
    return model


def _bounded(texts: DataFrame, known: DataFrame, train_docs: int | None, train_chars: int | None) -> DataFrame:
    """As many of the labelled ids as the caller's bounds allow."""
    if train_docs is not None:
        known = known.orderBy(F.xxhash64("id"), "id").limit(train_docs)
    if train_chars is None:
        return known
    sizes = texts.join(known, "id").groupBy("id", "toxic").agg(F.sum(F.length("text")).alias("chars")).withColumn("at", F.xxhash64("id")).toPandas().sort_values(["at", "id"])
    room, fits = train_chars, []
    for chars in sizes.chars.tolist():  # a row too long for what is left makes room for those after it
        fits.append(chars <= room)
        room -= chars * fits[-1]
    return texts.sparkSession.createDataFrame(list(sizes[["id", "toxic"]][np.array(fits, dtype=bool)].itertuples(index=False, name=None)), "id long, toxic int")


_BAGS = "id long, y int, sentences array<array<string>>"


def _bags(b: pa.RecordBatch) -> pa.RecordBatch:
    """The distinct words of each sentence of (id, y, text)."""
    rows = [(d, y, sentences(t)) for d, y, t in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    return rows_to_batch(rows, pa.schema([("id", pa.int64()), ("y", pa.int32()), ("sentences", pa.list_(pa.list_(pa.string())))]))


def _blocks(batches):
    """Numbered bags of bounded size, pickled: one row each."""
    held, chars = [], 0

    def block():
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(tuple(x if x.dtype == float else x.astype(np.int32) for x in numbered(pa.Table.from_batches(held))))], pa.binary())], names=["block"])

    for b in batches:
        held.append(_bags(b))
        chars += b.column(2).nbytes
        if chars >= BLOCK_CHARS:
            yield block()
            held, chars = [], 0
    if held:
        yield block()


def _added(blocks, weights: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """The gradient over all blocks; the driver gets one vector a task."""
    n, at = len(weights), np.flatnonzero(weights).astype(np.int32)
    some = weights[at]

    def run(held):
        w = np.zeros(n)
        w[at] = some
        total = np.zeros(n + 1, dtype=np.int64)
        for data in held:
            _, by_weight, by_bias = loss_and_gradient(w, bias, data)
            total[:-1] += np.rint(by_weight / GRAIN).astype(np.int64)
            total[-1] += round(by_bias / GRAIN)
        yield total

    parts = blocks.mapPartitions(run).collect()
    g = sum(parts[1:], parts[0]) * GRAIN
    return g[:-1], g[-1]


def _tree(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(node by word, parent by node, place by node, where each level begins and the last ends) of words and their beginnings; node 0 weighs nothing.

    A word's features are those on the way from its node to the root. Levels hold beginnings of 3 to 8 letters, then whole words.
    """
    bare = [w.strip(_EDGES) for w in words]
    parent, place, begins, above = [0], [0], [1], {}
    heads: list[dict[str, int]] = []
    for k in range(3, 9):
        level = dict.fromkeys(w[:k] for w in bare if len(w) > k)
        place += [_place("^" + h) for h in level]
        parent += [above[h[:-1]] for h in level] if k > 3 else [0] * len(level)
        heads.append(above := dict(zip(level, range(begins[-1], len(place)), strict=True)))
        begins.append(len(place))
    whole = dict.fromkeys(w for w in bare if w)
    place += map(_place, whole)
    parent += [heads[min(8, len(w) - 1) - 3][w[: min(8, len(w) - 1)]] if len(w) > 3 else 0 for w in whole]
    nodes = dict(zip(whole, range(begins[-1], len(place)), strict=True)) | {"": 0}
    begins.append(len(place))
    return np.array([nodes[w] for w in bare], dtype=np.int64), np.array(parent, dtype=np.int64), np.array(place, dtype=np.int64), begins


def numbered(bags: pa.Table) -> tuple[np.ndarray, ...]:
    """(y by bag, bag by sentence, words by sentence, node by place, then the nodes' parents, places and levels) of (id, y, sentences)."""
    order = bags.drop_columns(["sentences"]).append_column("n", pa.array(np.arange(len(bags)))).sort_by([("id", "ascending"), ("y", "ascending")]).column("n")
    bags = bags.take(order).combine_chunks()
    lists = bags.column("sentences").chunk(0) if len(bags) else pa.array([], pa.list_(pa.list_(pa.string())))
    inner = lists.flatten()
    words = inner.flatten().dictionary_encode()
    node, parent, place, begins = _tree(words.dictionary.to_pylist())
    bag = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    sizes = inner.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return bags.column("y").to_numpy().astype(float), bag, sizes, node[words.indices.to_numpy()], parent, place, np.array(begins)


def loss_and_gradient(weights: np.ndarray, bias: float, data: tuple[np.ndarray, ...]) -> tuple[float, np.ndarray, float]:
    """Of the negative log-likelihood of noisy-or bags, by weights and bias."""
    y, bag, sizes, word, parent, place, begins = (x if x.dtype == float else x.astype(np.intp, copy=False) for x in data)
    levels = list(zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True))
    u = weights[place]
    u[0] = 0.0
    for a, b in levels:
        u[a:b] += u[parent[a:b]]
    z = bias + np.add.reduceat(u[word], np.cumsum(sizes) - sizes)
    t = np.exp(-np.abs(z))
    none = -np.bincount(bag, np.maximum(z, 0) + np.log1p(t), minlength=len(y))  # log of the probability that no sentence offends
    none = np.minimum(none, -1e-12)
    loss = -np.where(y > 0, np.log(-np.expm1(none)), none).sum()
    q = np.exp(none)
    pull = np.where(y > 0, -q / -np.expm1(none), 1.0)
    per = pull[bag] * np.where(z > 0, 1.0, t) / (1 + t)
    by_node = np.bincount(word, np.repeat(per, sizes), minlength=len(place))
    for a, b in reversed(levels):
        by_node[:a] += np.bincount(parent[a:b], by_node[a:b], minlength=a)
    return float(loss), np.bincount(place[1:], by_node[1:], minlength=len(weights)), float(per.sum())


def train(bags: pa.Table, steps: int = STEPS, penalty: float = PENALTY) -> Model:
    """The model of (id, y, sentences)."""
    data = numbered(bags)
    return descend(lambda w, bias: loss_and_gradient(w, bias, data)[1:], steps, penalty)


def descend(gradient, steps: int = STEPS, penalty: float = PENALTY) -> Model:
    """Full-batch proximal Adam: the loss and the penalty times the weights' absolute values, which keeps words of too few documents at 0."""
    n, w, bias = 1 << BITS, np.zeros(1 << BITS), -5.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, steps + 1):
        g = np.append(*gradient(w, bias))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        rate = 0.1 / (np.sqrt(v / (1 - 0.99**step)) + 1e-3)
        move = rate * m / (1 - 0.9**step)
        w, bias = w - move[:-1], min(bias - move[-1], -2.0)
        w = np.sign(w) * np.maximum(np.abs(w) - rate[:-1] * penalty, 0.0)
    return Model(float(bias), w.astype(np.float32))


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, spans: the noisy-or of each row's sentences, and start:end of those that offend, comma-joined."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)  # 2^BITS numbers
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("spans", pa.string())])

    def run(batches):
        model = held.value
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p = model.score(t or "")  # no sentence is likelier to offend than the text that holds it
                rows.append((d, p, ",".join(f"{a}:{z}" for a, z, _ in model.spans(t)) if p >= OFFENDS else ""))
            yield rows_to_batch(rows, schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, spans string")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score."""
    return judge(docs, model, id_col, text_col).select("doc_id", "score")


def locate(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end: the offending sentences of each text."""
    spans = judge(docs, model, id_col, text_col).where("spans <> ''").select("doc_id", F.explode(F.split("spans", ",")).alias("s"))
    return spans.select("doc_id", *(F.split("s", ":")[i].cast("long").alias(n) for i, n in enumerate(("start", "end"))))


def survivors(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    return pass_rows(docs, text_col, lambda texts: [held.value.score(t.decode()) < threshold for t in texts])


def op8_toxicity_mil(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT
    return judge(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
