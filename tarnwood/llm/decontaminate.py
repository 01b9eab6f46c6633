"""Benchmark decontamination by latent semantic retrieval, longest common subsequences and answer checks.

1. Document frequencies of the benchmark's words are counted over all documents, in one pass for all items. Every word carries
   TF-IDF weight; words that stand everywhere weigh next to nothing by themselves.
2. A randomised SVD of the TF-IDF matrix of passages (the items, and the passages of about SAMPLE documents chosen by a hash of id
   and text) gives at most RANK right singular vectors; products with the matrix are made on the executors, which send
   back blocks of vocabulary x rank numbers.
3. Every whole text is cut into overlapping windows at scales that hold an item whole; none is sampled or skipped. Each window's latent vector
   is the sum of its words' vectors, made from sums over blocks of STEP words by doubling. Windows of cosine COSINE or more to an item are its candidates:
   the cosine alone decides, each item's by itself, whatever other items there are in the search.
4. A candidate's longest common subsequence with the item, in words, is taken over the window and its surroundings. A
   document is contaminated at a share of COPY of the item, or, as a paraphrase, at a share of PARAPHRASE if it
   also holds ANSWER of the item's last sentence's words. Candidates that cannot reach these shares are not compared: a subsequence of m words of an item
   holds m - k words beside those of its k places that its commonest words take, so fewer of the rarer words in the window and its surroundings rule it out; the
   same goes for the answer. This loses no match.

Items of fewer than SHORT words count only where they stand whole, word by word, and are looked up by their rarest word: so few words have no
direction that stands out in a window. Items are taken in blocks of ITEMS, one pass each, so what a worker holds is bounded whatever the benchmark's
size; a text is searched in slabs of SLAB words that overlap by a window, whatever its length.

Defined cases. Null or empty texts and items: never contaminated, never contaminating. Repeated rows: judged alike; null ids: judged and returned as null. Ties: every item
at or above the bounds is reported. Very long texts: searched whole. Empty tables: no rows. Other columns, clashing names included, are ignored by `matches`, returned untouched by `survivors`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_and_text, pass_rows, rows_to_batch, small_batches, stash

SAMPLE, RANK, OVERSAMPLE, POWERS = 3_000, 96, 16, 2
COSINE, COPY, PARAPHRASE, ANSWER, SHORT = 0.15, 0.7, 0.5, 0.8, 8
ITEMS, LEAST_WINDOW, STEP = 2_000, 32, 8
#: Words that are searched at once; items whose cosines are taken at once.
SLAB, ITEM_SLAB = 65_536, 512
#: ASCII marks part words; everything else is part of one.
_MARKS = bytes.maketrans(b".,;:!?\"'()[]{}<>|*%&#$@+-=_~^/\\`", b" " * 32)


def words_of(text: str) -> list[bytes]:
    """Lower-case words in UTF-8, parted by white space and marks."""
    return text.lower().encode().translate(_MARKS).split()


def numbers_of(words: list[bytes], vocabulary: dict[bytes, int]) -> np.ndarray:
    """Numbers in the vocabulary, -1 for other words; one dictionary look-up a word, all in C."""
    return np.fromiter(map(vocabulary.get, words, repeat(-1)), dtype=np.int32, count=len(words))


def lcs(masks: dict[bytes, int], n: int, words: list[bytes]) -> int:
    """Length of the longest common subsequence with an item of n words, bit-parallel; masks: word -> its positions."""
    full = (1 << n) - 1
    v = full
    for m in filter(None, map(masks.get, words)):
        u = v & m
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


@dataclass
class Item:
    item_id: int
    words: list[bytes]
    answer: set[bytes]
    masks: dict[bytes, int]
    scale: int  # windows of this many words hold the item wherever it stands


def items_of(rows) -> list[Item]:
    out = []
    for item_id, text in rows:
        words = words_of(text or "")
        if not words:
            continue
        masks: dict[bytes, int] = {}
        for i, w in enumerate(words):
            masks[w] = masks.get(w, 0) | 1 << i
        last = next(s for x in reversed(re.split(r"[.!?\n]+", text)) if (s := words_of(x)))
        scale = LEAST_WINDOW
        while 3 * scale < 4 * len(words):  # windows start every quarter, so one of this many words holds the item whole
            scale = scale * 3 // 2 if scale & (scale - 1) == 0 else scale * 4 // 3
        out.append(Item(item_id, words, set(last), masks, scale))
    return out


def least(share: float, n: int) -> int:
    """The smallest count c with c / n of at least share."""
    return next(c for c in range(n + 1) if c / n >= share)


def beside_common(counts: list[tuple[bytes, int]], need: int, stay: int) -> tuple[set[bytes], int]:
    """(word, times) from the commonest on, `need` of which are held: words without the commonest, and how many of them are held at least; this is stay or more, if need is."""
    words, left = dict(counts), need
    for w, k in counts:
        if left - k < stay:
            break
        left -= k
        del words[w]
    return set(words), left


@dataclass
class Scale:
    """The items whose windows are of one size, and what their matches hold at least."""

    words: int
    which: np.ndarray  # numbers of the items
    column: int  # of the first item's body words in the table of words that tell; those of the items' answers come after all bodies
    needs: np.ndarray  # 3 x items: of the body for a paraphrase, of the answer for it, of the body for a copy


def scales_of(items: list[Item], vocabulary: dict[bytes, int], df: dict[bytes, int]) -> tuple[list[Scale], np.ndarray]:
    """By window size the items, and a table of vocabulary and none x (body words, answer words): 1 for words that tell."""
    out, width = [], 2 * sum(len(x.words) >= SHORT for x in items)
    holds = np.zeros((len(vocabulary) + 1, width), np.uint8 if 2 * max((x.scale for x in items), default=0) < 250 else np.uint32)
    column = 0
    for scale in sorted({x.scale for x in items if len(x.words) >= SHORT}):
        which = [i for i, x in enumerate(items) if x.scale == scale and len(x.words) >= SHORT]
        needs = np.zeros((3, len(which)), np.int64)
        for k, i in enumerate(which):
            x = items[i]
            n, a = len(x.words), len(x.answer)
            common = sorted(x.masks, key=lambda w: (-df[w], w))
            body, left = beside_common([(w, x.masks[w].bit_count()) for w in common], half := least(PARAPHRASE, n), max(1, n // 8))
            answer, said = beside_common([(w, 1) for w in common if w in x.answer], least(ANSWER, a), max(1, a // 3))
            holds[[vocabulary[w] for w in body], column + k] = 1
            holds[[vocabulary[w] for w in answer], column + len(which) + k] = 1
            needs[:, k] = left, said, left + least(COPY, n) - half
        out.append(Scale(scale, np.array(which), column, needs))
        column += 2 * len(which)
    return out, holds


def block_sums(table: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of a table's rows over blocks of STEP word numbers; what is no word has the last row."""
    places = np.ascontiguousarray(np.where(n < 0, len(table) - 1, n).astype(np.intp).reshape(-1, STEP).T)
    out, row = table.take(places[0], axis=0, mode="clip"), np.empty((places.shape[1], table.shape[1]), table.dtype)
    for at in places[1:]:
        out += table.take(at, axis=0, out=row, mode="clip")
    return out


class Sums:
    """Sums of blocks over runs of them, each within its piece, by doubling."""

    def __init__(self, blocks: np.ndarray, of: np.ndarray):
        self.of = of
        self.known = {1: blocks}

    def over(self, size: int) -> np.ndarray:
        if size not in self.known:
            half = 1 << (size - 1).bit_length() - 1
            a, b = self.over(half), self.over(size - half)
            both = a.copy()
            both[:-half] += b[half:]
            over = np.flatnonzero(self.of[half:] != self.of[:-half])
            both[over] = a[over]
            self.known[size] = both
        return self.known[size]


@dataclass
class Index:
    items: list[Item]
    vocabulary: dict[bytes, int]
    vectors: np.ndarray = field(default=None)  # vocabulary x rank: IDF times right singular vectors; a last row of zeros for other words
    queries: np.ndarray = field(default=None)  # items x rank, of length 1
    rarest: dict[int, list[tuple[int, int]]] = field(default_factory=dict)  # number of a word -> short items of which it is the rarest, its place there
    scales: list[Scale] = field(default_factory=list)
    holds: np.ndarray = field(default=None)

    def search(self, texts: list[str]) -> list[dict[int, tuple[float, float, float]]]:
        """By text: item number -> (share of the longest common subsequence, share of the answer, cosine) of what is contaminated."""
        out: list[dict] = [{} for _ in texts]
        overlap = 2 * max((x.scale for x in self.items), default=0) // STEP * STEP
        pieces, load = [], 0
        for d, text in enumerate(texts):
            words = words_of(text)
            n = numbers_of(words, self.vocabulary)
            for low in range(0, len(n), SLAB):
                low = max(0, low - overlap)
                part = n[low : low + SLAB + 2 * overlap]
                pieces.append((d, low, words, part))
                load += len(part)
                if load >= SLAB:
                    self._slab(pieces, out)
                    pieces, load = [], 0
        if pieces:
            self._slab(pieces, out)
        return out

    def _slab(self, pieces: list[tuple], out: list[dict]) -> None:
        """Search pieces (text number, first word, words of the text, word numbers), each from a block of its own on."""
        blocks = np.array([-(-len(p[3]) // STEP) for p in pieces])
        first = np.cumsum(blocks) - blocks
        n = np.full(int(blocks.sum()) * STEP, -1, np.int32)
        for p, at in zip(pieces, first.tolist(), strict=True):
            n[at * STEP : at * STEP + len(p[3])] = p[3]
        of = np.repeat(np.arange(len(pieces)), blocks)
        if self.rarest:
            self._short(n, of, first, pieces, out)
        latent = Sums(block_sums(self.vectors, n), of)
        holds = block_sums(self.holds, n)
        for s in self.scales:
            stride, margin = max(1, s.words // 4 // STEP), -(-s.words // 4 // STEP)
            starts = np.arange(0, len(of), stride)
            x = latent.over(s.words // STEP)[starts]
            length = np.sqrt(np.einsum("ij,ij->i", x, x))
            near = np.maximum(starts - margin, first[of[starts]])  # a window with its surroundings, or more at the start of a piece
            for a in range(0, len(s.which), ITEM_SLAB):
                k = slice(a, a + ITEM_SLAB)
                cosine = x @ self.queries[s.which[k]].T
                chosen = (cosine >= COSINE * length[:, None]) & (length > 1e-6)[:, None]
                i, j = np.nonzero(chosen & self._may(s, k, holds, of, near, s.words // STEP + 2 * margin))
                for b, item, c in zip(starts[i].tolist(), s.which[a + j].tolist(), (cosine[i, j] / length[i]).tolist(), strict=True):
                    d, low, words, _ = pieces[of[b]]
                    if out[d].get(item, (0,))[0] == 1.0:
                        continue
                    share, answer = self.compare(self.items[item], words, low + (b - int(first[of[b]])) * STEP)
                    if share >= COPY or share >= PARAPHRASE and answer >= ANSWER:
                        out[d][item] = max(out[d].get(item, (0.0, 0.0, 0.0)), (share, answer, c))

    def _may(self, s: Scale, k: slice, holds: np.ndarray, of: np.ndarray, near: np.ndarray, size: int) -> np.ndarray:
        """windows x items: whether a window's surroundings hold the words that a match holds at least."""
        body, answer = (Sums(np.ascontiguousarray(holds[:, c : c + len(s.which)][:, k]), of).over(size)[near] for c in (s.column, s.column + len(s.which)))
        needs = s.needs[:, k].astype(body.dtype)
        return (body >= needs[0]) & (answer >= needs[1]) | (body >= needs[2])

    def _short(self, n: np.ndarray, of: np.ndarray, first: np.ndarray, pieces: list[tuple], out: list[dict]) -> None:
        wanted = np.zeros(len(self.vocabulary) + 1, bool)
        wanted[list(self.rarest)] = True
        for at in np.flatnonzero(wanted[n]).tolist():
            p = of[at // STEP]
            d, low, words, _ = pieces[p]
            place = low + at - int(first[p]) * STEP
            for item, offset in self.rarest[int(n[at])]:
                start, want = place - offset, self.items[item].words
                if start >= 0 and item not in out[d] and words[start : start + len(want)] == want:
                    out[d][item] = (1.0, 1.0, 1.0)

    def compare(self, item: Item, words: list[bytes], start: int) -> tuple[float, float]:
        margin = item.scale // 4
        words = words[max(0, start - margin) : start + item.scale + margin]
        share = lcs(item.masks, len(item.words), words) / len(item.words)
        return share, len(item.answer.intersection(words)) / len(item.answer) if share >= PARAPHRASE else 0.0


def _frequencies(texts: DataFrame, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """Documents that hold each word, and all documents."""

    def run(batches):
        counts, docs = np.zeros(len(vocabulary) + 1, np.int64), 0
        for b in batches:
            for text in b.column(0).to_pylist():
                n = numbers_of(words_of(text), vocabulary)
                counts[np.unique(n[n >= 0])] += 1
                docs += 1
        counts[-1] = docs
        yield rows_to_batch([(i, int(c)) for i, c in enumerate(counts) if c], pa.schema([("word", pa.int32()), ("n", pa.int64())]))

    out = np.zeros(len(vocabulary) + 1, np.int64)
    for r in texts.select("text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():  # a row for each word of the benchmark
        out[r.word] = r.n
    return out[:-1], int(out[-1])


def _products(parts: DataFrame, q: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A' (A Q) of the passages in parts; each task sends one block back."""

    def run(batches):
        z = np.zeros(q.shape)
        for b in batches:
            for ids in b.column(0).to_pylist():
                w, n = np.unique(np.array(ids, dtype=np.int64), return_counts=True)
                a = n * weight[w]
                a /= np.sqrt((a * a).sum()) + 1e-12
                z[w] += np.outer(a, a @ q[w])
        yield rows_to_batch([(z.tobytes(),)], pa.schema([("z", pa.binary())]))

    return sum((np.frombuffer(r.z).reshape(q.shape) for r in parts.mapInArrow(run, "z binary").toLocalIterator()), np.zeros(q.shape))


def build(texts: DataFrame, items: list[Item], df: dict[bytes, int], n_docs: int) -> Index:
    """The latent index of a block of items; df: documents that hold each word."""
    spark = texts.sparkSession
    keep = sorted({w for x in items for w in x.words})
    weight = np.array([log((n_docs + 2) / (df[w] + 1)) for w in keep])
    index = Index(items, {w: i for i, w in enumerate(keep)})
    step = LEAST_WINDOW * 2

    def passages(batches):
        for b in batches:
            rows = []
            for text in b.column(0).to_pylist():
                n = numbers_of(words_of(text), index.vocabulary)
                rows += [(x[x >= 0],) for x in (n[i : i + step] for i in range(0, len(n), step))]
            yield rows_to_batch([r for r in rows if len(r[0]) > 1], pa.schema([("ids", pa.list_(pa.int32()))]))

    # the same row again adds nothing to a sample: one stays for each hash
    at = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 53))
    sample = texts.select(at.alias("at"), "text").where(F.col("at") < int(min(1.0, SAMPLE / max(1, n_docs)) * (1 << 53))).groupBy("at").agg(F.first("text").alias("text")).select("text")
    own = spark.createDataFrame([([index.vocabulary[w] for w in x.words],) for x in items], "ids array<int>")
    parts = stash(sample.mapInArrow(passages, "ids array<int>").unionByName(own).repartition(4), "passages")
    rank = max(1, min(RANK, len(items), len(keep)))
    q = np.linalg.qr(np.random.RandomState(3).standard_normal((len(keep), min(len(keep), rank + OVERSAMPLE))))[0]
    for _ in range(POWERS):
        q = np.linalg.qr(_products(parts, q, weight))[0]
    values, vectors = np.linalg.eigh(q.T @ _products(parts, q, weight))
    discard(parts)
    v = q @ vectors[:, np.argsort(-values)[:rank]]
    index.vectors = np.concatenate((weight[:, None] * v, np.zeros((1, rank)))).astype(np.float32)
    queries = np.array([index.vectors[[index.vocabulary[w] for w in x.words]].sum(axis=0) for x in items])
    index.queries = (queries / (np.sqrt((queries**2).sum(axis=1, keepdims=True)) + 1e-9)).astype(np.float32)
    index.scales, index.holds = scales_of(items, index.vocabulary, df)
    for i, x in enumerate(items):
        if len(x.words) < SHORT:
            rarest = min(x.words, key=lambda w: (df[w], w))
            index.rarest.setdefault(index.vocabulary[rarest], []).append((i, x.words.index(rarest)))
    return index


def indexes(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Iterator[Index]:
    """An index for each block of items; word frequencies of all are counted in one pass."""
    small_batches(docs.sparkSession)
    texts = id_and_text(docs, id_col, text_col)
    items = items_of(sorted((r.item_id, r.text) for r in benchmark.select("item_id", "text").distinct().collect() if r.item_id is not None and r.text))  # the query set
    if items:
        words = sorted({w for x in items for w in x.words})
        counts, n_docs = _frequencies(texts, {w: i for i, w in enumerate(words)})
        df = dict(zip(words, counts.tolist(), strict=True))
        for i in range(0, len(items), ITEMS):
            yield build(texts, items[i : i + ITEMS], df, n_docs)


_MATCH = "doc_id long, item_id long, lcs double, answer double, cosine double"


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, lcs, answer, cosine: a row for each contaminated document and item, and each of a document's rows."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("lcs", pa.float64()), ("answer", pa.float64()), ("cosine", pa.float64())])
    out = docs.sparkSession.createDataFrame([], _MATCH)
    for index in indexes(docs, benchmark, id_col, text_col):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, held=held):
            for b in batches:
                found = held.value.search(b.column(1).to_pylist())
                yield rows_to_batch([(d, held.value.items[k].item_id, *x) for d, hits in zip(b.column(0).to_pylist(), found, strict=True) for k, x in sorted(hits.items())], schema)

        out = out.unionByName(id_and_text(docs, id_col, text_col).mapInArrow(run, _MATCH))
    return out


def survivors(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    for index in indexes(docs, benchmark, id_col, text_col):
        held = docs.sparkSession.sparkContext.broadcast(index)
        docs = pass_rows(docs, text_col, lambda texts, held=held: [not hits for hits in held.value.search([t.decode() for t in texts])])
    return docs


def op1_lsa_decontamination(spark, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
