"""Packing of token sequences into windows: repeat counts of length combinations by non-negative least squares, then a line of what is left.

Counting. A task tokenizes its documents, numbers those of the same remainder (length modulo WINDOW) and writes ids and numbers to the shared folder.
Whole windows of long documents are sequences by themselves; the remainders make a histogram of WINDOW - 1 places at most, which is all that the driver gets.

Solving (`Plan`). Shallow combinations that fill a window exactly are enumerated: one or two lengths, each any number of times, and three lengths once
each. Repeat counts x >= 0 minimise |A x - h|^2 (A: how often a combination holds a length; h: the histogram) by multiplicative steps, are rounded in
descending order, up where documents are left, and never use a document twice. Residual documents are packed greedily, longest first, in one line that is cut at each
WINDOW tokens; its last window is cut into powers of two. So no sequence needs padding, and only documents of the line are cut, one a window at most.

Dealing out. A document's place follows from its number among those of its length by a search in the plan's intervals; numbers within a task become global by the
running sum of the tasks' histograms, joined on (task, length).

Defined cases. Null and empty texts: the end token alone. Null ids: packed and returned as null. Repeated rows and ties: each row is packed by itself. Very long texts:
tokenized whole, cut into windows. Empty tables: no rows. Other columns of any name are ignored.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .bpe import NONE, PairTable
from .common import bytes_of, id_and_text, small_batches, stash

WINDOW, END, STEPS = 4096, 2, 60
#: Words and pieces that a worker's caches hold; bytes beyond which a word is tokenized whenever it occurs.
CACHED_WORDS, CACHED, WORD_BYTES = 500_000, 300_000, 64
#: Words that are split here: printable ASCII and the Latin letters up to U+00FF, which are in composed form and lower-case one by one; and the tokenizer's pattern on them (fixed values).
_PLAIN = re.compile("[\x21-\x7E\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00DF-\u00F6\u00F8-\u00FF]+|[0-9]|[^a-z0-9\u00DF-\u00F6\u00F8-\u00FF]+")
#: Whole windows of a task: their sequence ids are task * 2^SHARD + number.
SHARD = 36


class Merges:
    """A vocabulary whose pieces end in letters of their own, as rounds over all new pieces at once."""

    def __init__(self, model: dict, kind: np.dtype):
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others are named from 256 on
        names = {b: chr(b) for b in letters} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letters)}
        ids, end = model["vocab"], model["end_of_word_suffix"]
        self.kind = kind
        self.inner = np.array([ids[names[b]] for b in range(256)], dtype=np.int32)
        self.last = np.array([ids[names[b] + end] for b in range(256)], dtype=np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merged = np.array([ids[a + b] for a, b in pairs], dtype=np.int32)
        self.table = PairTable({(ids[a], ids[b]): i for i, (a, b) in enumerate(pairs)})

    def of(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of each piece. A round merges the leftmost pair of least rank of each."""
        out, raw = [b""] * len(pieces), [p.encode() for p in pieces]
        if not raw:
            return out
        size = np.array([len(r) for r in raw])
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        cells, own = self.inner[flat], np.repeat(np.arange(len(raw)), size)
        tips = np.cumsum(size) - 1
        cells[tips] = self.last[flat[tips]]
        ranks = np.full(len(cells), NONE, dtype=np.int32)
        inside = np.flatnonzero(own[:-1] == own[1:])
        ranks[inside] = self.table.rank(cells[inside], cells[inside + 1])
        while len(cells):
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            size = np.diff(starts, append=len(own))
            least = np.minimum.reduceat(ranks, starts)
            if (over := least == NONE).any():
                gone = np.repeat(over, size)
                done, ends = cells[gone].astype(self.kind).tobytes(), np.cumsum(size[over]) * self.kind.itemsize
                at = 0
                for i, to in zip(own[starts[over]].tolist(), ends.tolist(), strict=True):
                    out[i] = done[at:to]
                    at = to
                cells, own, ranks = cells[~gone], own[~gone], ranks[~gone]
                least, size = least[~over], size[~over]
                if not len(cells):
                    break
            hit = np.flatnonzero(ranks == np.repeat(least, size))
            at = hit[np.flatnonzero(np.diff(own[hit], prepend=-1))]
            cells[at] = self.merged[ranks[at]]
            stay = np.ones(len(cells), dtype=bool)
            stay[at + 1] = False
            at -= np.arange(len(at))  # one cell before each went
            cells, own, ranks = cells[stay], own[stay], ranks[stay]
            ranks[at] = NONE
            for side in (at - 1, at):
                ok = (side >= 0) & (side < len(cells) - 1)
                i = side[ok]
                i = i[own[i] == own[i + 1]]
                ranks[i] = self.table.rank(cells[i], cells[i + 1])
        return out


class Ids:
    """Texts to packed ids, for a tokenizer file that lower-cases, parts words at white space by a pattern and merges pairs by rank up to word ends.

    Words of ASCII and Latin letters are split and merged here, once each while they stay in the bounded caches; others, long ones and those that may hold a
    special token go to the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.encoder.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            self.merges = Merges(json.load(f)["model"], self.kind)
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def of_batch(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        split = [t.split() for t in texts]  # ASCII white space: matches of the pattern hold none
        known, pieces = self.words, self.pieces
        if len(known) > CACHED_WORDS:
            known.clear()
        if len(pieces) > CACHED:
            pieces.clear()
        found = [list(map(known.get, words)) for words in split]
        new = {w for words, ids in zip(split, found, strict=True) if None in ids for w, i in zip(words, ids, strict=True) if i is None}
        here, odd = [], []
        for w in new:
            text = w.decode()
            if len(w) <= WORD_BYTES and _PLAIN.fullmatch(text) and "<|" not in text:
                here.append((w, _PIECE.findall(text.lower())))
            else:
                odd.append(w)
        fresh = list({p for _, ps in here for p in ps}.difference(pieces))
        pieces.update(zip(fresh, self.merges.of(fresh), strict=True))
        for w, ps in here:
            known[w] = pieces[ps[0]] if len(ps) == 1 else b"".join([pieces[p] for p in ps])
        for i in range(0, len(odd), 4096):
            some = odd[i : i + 4096]
            for w, e in zip(some, self.encoder.encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, dtype=self.kind).tobytes()
        out = [b"".join(map(known.__getitem__, words) if None in ids else ids) for words, ids in zip(split, found, strict=True)]
        for w in odd:
            if len(w) > WORD_BYTES:
                del known[w]
        return out


class Plan:
    """Where the k-th document of each length goes."""

    def __init__(self, histogram: dict[int, int], window: int = WINDOW, steps: int = STEPS):
        self.window = window
        h = np.zeros(window, dtype=np.int64)
        for length, n in histogram.items():
            h[length] = n
        left = h.copy()
        self.intervals: dict[int, list[tuple[int, int, int, int]]] = {}
        self.sequences = 0
        self._take(combinations(h, window), h, left, steps)
        self.table = {length: tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) for length, rows in self.intervals.items()}
        # the line: longest first
        lengths = np.flatnonzero(left)[::-1]
        starts = np.cumsum(left[lengths] * lengths) - left[lengths] * lengths
        self.first_left = {int(n): int(h[n] - left[n]) for n in lengths}
        self.base = dict(zip(lengths.tolist(), starts.tolist(), strict=True))
        self.total = int((left * np.arange(window)).sum())
        tail = self.total % window
        self.tail_at = self.total - tail
        powers = [1 << b for b in reversed(range(tail.bit_length())) if tail >> b & 1]
        self.tail_ends = np.cumsum(powers) + self.tail_at if powers else np.zeros(0, dtype=np.int64)
        self.count = self.sequences + self.tail_at // window + len(powers)

    def _take(self, combos, h, left, steps) -> None:
        lengths, times = combos
        if not len(lengths):
            return
        x = repeats(lengths, times, h, steps)
        order = np.argsort(-x, kind="stable")
        ns, ts, xs, room = lengths[order].tolist(), times[order].tolist(), x[order].tolist(), left.tolist()
        for ls, ms, v in zip(ns, ts, xs, strict=True):
            t = max(1, round(v))
            for n, m in zip(ls, ms, strict=True):
                if m:
                    t = min(t, room[n] // m)
            if t <= 0:
                continue
            offset = 0
            for n, m in zip(ls, ms, strict=True):
                if m:
                    self.intervals.setdefault(n, []).append((int(h[n]) - room[n], self.sequences, m, offset))
                    room[n] -= t * m
                    offset += n * m
            self.sequences += t
        left[:] = room

    def place(self, length: int, k: int) -> list[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the pieces of the k-th document of a length."""
        first = self.first_left.get(length)
        if first is None or k < first:
            ranks, seqs, times, offsets = self.table[length]
            i = int(np.searchsorted(ranks, k, side="right")) - 1
            nth = k - int(ranks[i])
            m = int(times[i])
            return [(0, length, int(seqs[i]) + nth // m, int(offsets[i]) + nth % m * length)]
        at = self.base[length] + (k - first) * length
        out, start = [], 0
        while start < length:
            p = at + start
            if p < self.tail_at:
                seq, begin, end = self.sequences + p // self.window, p // self.window * self.window, (p // self.window + 1) * self.window
            else:
                i = int(np.searchsorted(self.tail_ends, p, side="right"))
                seq, begin, end = self.sequences + self.tail_at // self.window + i, int(self.tail_ends[i - 1]) if i else self.tail_at, int(self.tail_ends[i])
            n = min(length - start, end - p)
            out.append((start, n, seq, p - begin))
            start += n
        return out


def combinations(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, times), three columns each: i a + j b = window, and a + b + c = window, from lengths that the histogram has, as often as it has them."""
    have = np.flatnonzero(h)
    parts: list[np.ndarray] = []

    def put(a, i, b, j, c, k):
        n = max(map(np.size, (a, i, b, j, c, k)))
        parts.append(np.stack([np.broadcast_to(np.asarray(v, dtype=np.int32), (n,)) for v in (a, b, c, i, j, k)], axis=1))

    for a in have.tolist():
        small = have[have < a]
        for i in range(1, min(int(h[a]), window // a) + 1):
            rest = window - i * a
            if not rest:
                put(a, i, 0, 0, 0, 0)
                continue
            b = small[rest % small == 0]
            b = b[rest // b <= h[b]]
            if len(b):
                put(a, i, b, rest // b, 0, 0)
        b = small[(2 * small > window - a) & (small < window - a)]
        c = window - a - b
        b = b[h[c] > 0]
        if len(b):
            put(a, 1, b, 1, window - a - b, 1)
    if not parts:
        return np.zeros((0, 3), dtype=np.int32), np.zeros((0, 3), dtype=np.int32)
    both = np.concatenate(parts)
    return both[:, :3], both[:, 3:]


def repeats(lengths: np.ndarray, times: np.ndarray, h: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """x >= 0 that lowers |A x - h|^2: each step multiplies x by (A'h) / (A'A x), which never raises the sum of squares."""
    flat, weight = lengths.T.ravel(), times.T.astype(np.float64)
    goal = h.astype(np.float64)

    def back(r):
        return sum(weight[c] * r[lengths[:, c]] for c in range(3))

    def forth(x):
        return np.bincount(flat, weights=(weight * x).ravel(), minlength=len(h))

    top = back(goal)
    x = np.full(len(lengths), goal.sum() / max(1.0, forth(np.ones(len(lengths))).sum()))
    for _ in range(steps):
        x *= top / np.maximum(back(forth(x)), 1e-300)
    return x


_COUNTED = "shard long, doc_id long, n long, rest int, rank long, whole_before long, ids binary"


def counted(docs: DataFrame, path: str, end: int = END, window: int = WINDOW) -> DataFrame:
    """Each document's ids (without the end token), length, remainder, its number among those of that remainder in its task, and the task's whole windows before it."""

    def run(batches):
        ids, shard = Ids(path), TaskContext.get().partitionId()
        rank, before = np.zeros(window, dtype=np.int64), 0
        for b in batches:
            packed = ids.of_batch(bytes_of(b.column(1)))
            ns = [len(p) // ids.kind.itemsize + 1 for p in packed]
            ranks, whole = [], []
            for n in ns:
                ranks.append(int(rank[n % window]))
                rank[n % window] += 1
                whole.append(before)
                before += n // window
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * len(ns), pa.int64()), b.column(0), pa.array(ns, pa.int64()), pa.array([n % window for n in ns], pa.int32()), pa.array(ranks, pa.int64()), pa.array(whole, pa.int64()), pa.array(packed, pa.binary())],
                names=["shard", "doc_id", "n", "rest", "rank", "whole_before", "ids"],
            )

    return stash(docs.mapInArrow(run, _COUNTED), "packing")


def pack(docs: DataFrame, path: str, end: int = END, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids (packed little-endian unsigned 32-bit), doc_tokens, sequence_id, offset: one row for each piece of a document."""
    small_batches(docs.sparkSession)
    rows = counted(id_and_text(docs, id_col, text_col), path, end, window)
    local = stash(rows.where("rest > 0").groupBy("shard", "rest").agg(F.count(F.lit(1)).alias("n")), "histograms")
    plan = Plan({r.rest: r.n for r in local.groupBy("rest").agg(F.sum("n").alias("n")).collect()}, window)
    base = local.select(F.col("shard").alias("b_shard"), F.col("rest").alias("b_rest"), (F.sum("n").over(Window.partitionBy("rest").orderBy("shard")) - F.col("n")).alias("base"))
    placed = rows.join(base, (rows.shard == base.b_shard) & (rows.rest == base.b_rest), "left").select("shard", "doc_id", "n", "rest", (F.col("rank") + F.coalesce("base", F.lit(0))).alias("rank"), "whole_before", "ids")

    def run(batches):
        kind = None
        for b in batches:
            out = []
            for shard, doc_id, n, rest, rank, before, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                kind = kind or Ids(path).kind
                all_ids = np.append(np.frombuffer(ids, dtype=kind).astype("<u4"), np.uint32(end))
                at = n - rest
                pieces = [(w * window, window, plan.count + (shard << SHARD) + before + w, 0) for w in range(at // window)]
                if rest:
                    pieces += [(at + s, m, seq, off) for s, m, seq, off in plan.place(rest, rank)]
                out += [(doc_id, s, m, all_ids[s : s + m].tobytes(), n, seq, off) for s, m, seq, off in pieces]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return placed.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op11_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of the pieces of all documents."""
    import public_tokenizers

    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
