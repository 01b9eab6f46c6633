"""Language-model scoring from a log-frequency Bloom filter of quantised n-gram counts.

Counting. Tasks turn texts into 64-bit token hashes, fold them in chunks and deal sorted key blocks out
by key range; a task merges one bucket at a time. Word counts become a table. A pair's key begins with bits of its context's hash, so a
context's pairs share a bucket; those of the HOT commonest words (of START, and of a sample's words: this settles only where pairs go) are spread
over all buckets. All pairs of a bucket go to its Bloom filter: a pair of count c is entered as
(pair, 1), ..., (pair, 1 + floor(log2 c)), and counts as q(v, w) = 2^floor(log2 c). The sum of q over a context's pairs, T(v), is counted exactly and stands
in the table of words.

Scoring. q is found by probing levels until one is absent, so it can be too high but never too low. With f the rate at which the filter
takes absent pairs for present, and V words, the q of a context that the filter gives add up to Z(v) = T(v) + f (V + 1), as expected; so
P(w | v) = lambda(v) q(v, w) / Z(v) + (1 - lambda(v)) P(w), lambda(v) = T(v) / (Z(v) + DAMP), P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))
adds up to one over all words and an unknown one, but for the chance of f. After contexts never seen it is P(w) alone. c, N, V and T are exact.
An entry's PROBES bits lie in one 64-bit word, read at once.

What is broadcast: the frequent words, COMMON at most (24 bytes each), and the filter if it has SMALL bytes at most. A larger filter stays
where it is: texts are taken in chunks, the distinct pairs of a chunk are dealt to the buckets, and one byte for each pair, the level that
its bucket's filter gave, comes back to the chunk. So texts are passed over twice, whatever their size. A pass scores the
tokens whose word and context are both frequent. It hands on the others with the q of their pairs, and they are scored
when a join with the table of words has brought the counts of the other words; the base score takes them from there too.

Defined cases. Null text: empty, a single end token. Null ids: held out, so not learned from. Repeated rows: each counts
when learning and is scored. Very long texts: counted and scored whole. Ties: equal texts have equal scores. Empty tables: no rows; without training rows all
tokens are unknown. Columns of other names, clashing ones included, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import ceil, log10

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import M2, ascii_words, bytes_of, id_and_text, in_chunks, mix, rows_to_batch, small_batches, stash, word_hashes

FOLDS, HELD_OUT = 5, 1
#: Tokens that a counting task folds at once; characters of input for each bucket of keys; keys in a row that is dealt.
CHUNK, CHARS_A_BUCKET, ROW = 2_000_000, 8_000_000, 8_192
COMMON, SHARD_BYTES = 500_000, 64_000_000
#: Bytes up to which the whole filter is broadcast.
SMALL = 16_000_000
#: Tokens of a chunk whose pairs are dealt to the buckets of a filter that is not broadcast.
ASKED = 1_000_000
#: Words whose pairs are spread over all buckets; documents that they are taken from.
HOT, HOT_DOCS = 512, 2_000
#: Bits for each entry of the filter, probes for each entry.
BITS, PROBES = 16, 4
LEVELS = 40
DAMP = 5.0
_LOWER = np.uint64((1 << 40) - 1)
#: Tokens that are no words: words hold no space.
START, END = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b" start ", b" end "))


def tokens(text: bytes) -> np.ndarray:
    """Hashes of the words and the end."""
    return np.append(word_hashes(ascii_words(text)), END)


def contexts(seqs: list[np.ndarray]) -> np.ndarray:
    """The token before each token of the texts, START before the first."""
    flat = np.concatenate(([START], *seqs))[:-1]
    flat[np.cumsum([0, *map(len, seqs[:-1])])] = START
    return flat


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, where each begins in the sorted ones, and what sorts them; numpy's own unique is slower by hashing."""
    order = np.argsort(keys)
    some = keys[order]
    first = np.flatnonzero(np.append(True, some[1:] != some[:-1])[: len(some)])
    return some[first], first, order


def distinct(keys: np.ndarray) -> np.ndarray:
    some = np.sort(keys)
    return some[np.append(True, some[1:] != some[:-1])[: len(some)]]


def placed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and of each key its place there."""
    some, first, order = runs(keys)
    place = np.empty(len(keys), np.int64)
    place[order] = np.repeat(np.arange(len(some)), np.diff(np.append(first, len(keys))))
    return some, place


def pair_keys(before: np.ndarray, token: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Keys of pairs; their upper 24 bits, by which they are dealt, are those of the context, if it is not among the hot ones."""
    key = mix(before * M2 + token)
    together = (mix(before) & ~_LOWER) | (key >> np.uint64(24))
    return np.where(hot[np.minimum(np.searchsorted(hot, before), len(hot) - 1)] == before, key, together)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(40)).astype(np.int64) * buckets) >> 24


_BLOCK = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("words", pa.binary())])


def _packed(counts: np.ndarray) -> bytes:
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.uint32).tobytes()


def _counts(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, np.uint8 if len(packed) == n else np.uint32)


def _fold(buckets: int, hot: np.ndarray):
    def run(batches):
        def blocks(held: list[np.ndarray]) -> Iterator[tuple]:
            flat, before = np.concatenate(held), contexts(held)
            for kind in (0, 1):
                if kind:
                    keys, first, order = runs(pair_keys(before, flat, hot))
                    other, counts = before[order[first]], np.diff(np.append(first, len(flat)))
                else:
                    other, first, _ = runs(flat)
                    counts = np.diff(np.append(first, len(flat)))
                    keys = mix(other)  # a word goes where pairs go whose context it is
                    order = np.argsort(keys)
                    keys, other, counts = keys[order], other[order], counts[order]
                cut = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
                for i in range(buckets):
                    for low in range(cut[i], cut[i + 1], ROW):
                        k = slice(low, min(low + ROW, cut[i + 1]))
                        yield i, kind, keys[k].tobytes(), _packed(counts[k]), other[k].tobytes()

        def rows():
            held, n = [], 0
            for b in batches:
                for text in bytes_of(b.column(0)):
                    held.append(tokens(text))
                    n += len(held[-1])
                    if n >= CHUNK:
                        yield from blocks(held)
                        held, n = [], 0
            if held:
                yield from blocks(held)

        yield from in_chunks(rows(), _BLOCK, weight=lambda r: len(r[2]) + len(r[3]) + len(r[4]))

    return run


def _probe(keys: np.ndarray, level: int, words: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry the 64-bit word of the filter, and its bits there."""
    h = mix(keys + np.array([level], dtype=np.uint64) * M2)
    mask = np.zeros(len(keys), dtype=np.uint64)
    for i in range(PROBES):
        mask |= np.uint64(1) << (h >> np.uint64(6 * i) & np.uint64(63))
    return ((h >> np.uint64(32)) * np.asarray(words, dtype=np.uint64) >> np.uint64(32)).astype(np.int64), mask


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(counts)).astype(np.int64) + 1


def bucket_filter(keys: np.ndarray, counts: np.ndarray, bits_each: int = BITS) -> np.ndarray:
    """The 64-bit words of one bucket; bits_each for each entry."""
    level = levels_of(counts)
    bits = np.zeros(max(1, ceil(int(level.sum()) * bits_each / 64)), dtype=np.uint64)
    for j in range(1, int(level.max(initial=0)) + 1):
        at, mask = _probe(keys[level >= j], j, len(bits))
        order = np.argsort(at)
        at, first = np.unique(at[order], return_index=True)
        bits[at] |= np.bitwise_or.reduceat(mask[order], first)
    return bits


def taken(bits: np.ndarray) -> float:
    """The share of absent entries that the filter takes for present."""
    return float(((np.bitwise_count(bits) / 64) ** PROBES).mean())


_MERGED = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("t", pa.int64()), ("taken", pa.float64()), ("bits", pa.binary())])
_MERGED_SQL = "kind int, key long, n long, t long, taken double, bits binary"


def _merge(hot: np.ndarray, bits_each: int):
    """Blocks in order of (bucket, kind) -> 0: words with their counts and T; 1: the filter of each bucket; 2: the same as 0 for hot words, in parts."""

    def run(batches):
        def groups():
            at, held = None, ([], [])
            for b in batches:
                for bucket, kind, keys, counts, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if bucket != at and at is not None:
                        yield at, held
                        held = ([], [])
                    at = bucket
                    held[kind].append((k := np.frombuffer(keys, np.uint64), _counts(counts, len(k)), np.frombuffer(words, np.uint64)))
            if at is not None:
                yield at, held

        def folded(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Keys, counts, words."""
            if not held:
                return np.array([], np.uint64), np.array([], np.int64), np.array([], np.uint64)
            keys, counts, words = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(keys)
            keys = keys[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            return keys[first], np.add.reduceat(counts[order].astype(np.int64), first), words[order[first]]

        def table(kind: int, words: np.ndarray, n: np.ndarray, t: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(words), kind, np.int32)), pa.array(words.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(t.astype(np.int64)), pa.nulls(len(words), pa.float64()), pa.nulls(len(words), pa.binary())], schema=_MERGED)

        for bucket, (of_words, of_pairs) in groups():
            _, n, words = folded(of_words)
            keys, counts, before = folded(of_pairs)
            every, of = np.unique(np.concatenate((words, before)), return_inverse=True)
            n = np.bincount(of[: len(words)], weights=n, minlength=len(every))
            t = np.bincount(of[len(words) :], weights=2.0 ** (levels_of(counts) - 1), minlength=len(every))
            spread = np.isin(every, hot)
            yield table(0, every[~spread], n[~spread], t[~spread])
            yield table(2, every[spread], n[spread], t[spread])
            if len(keys):
                bits = bucket_filter(keys, counts, bits_each)
                yield rows_to_batch([(1, bucket, len(keys), None, taken(bits), bits.tobytes())], _MERGED)

    return run


def levels_in(keys: np.ndarray, bits: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many levels of each pair a filter holds, by repeated probes; starts and sizes (in 64-bit words) of its bucket, one for each pair."""
    level = np.zeros(len(keys), dtype=np.int64)
    left = np.arange(len(keys))
    for j in range(1, LEVELS):
        at, mask = _probe(keys[left], j, sizes[left])
        left = left[bits[starts[left] + at] & mask == mask]
        if not len(left):
            break
        level[left] = j
    return level


def quantised(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, 2.0 ** (level.astype(np.int64) - 1), 0.0)


@dataclass
class Shard:
    """Some buckets of the filter and the frequent words: what a worker holds."""

    words: np.ndarray  # sorted hashes of frequent words
    counts: np.ndarray
    sums: np.ndarray  # T of the frequent words
    starts: np.ndarray  # by bucket: its first 64-bit word, -1 if it is in another shard
    sizes: np.ndarray  # by bucket: 64-bit words
    bits: np.ndarray
    others: float  # known words beside the frequent ones; without any, what is not among these is unknown
    start: float  # T of the start
    hot: np.ndarray
    divisor: float
    noise: float  # f (V + 1)

    def count(self, keys: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """q of pairs; 0 for what is absent."""
        return quantised(levels_in(keys, self.bits, self.starts[bucket], self.sizes[bucket]))

    def exact(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and T of frequent words, 0 for others."""
        if not len(self.words):
            return np.zeros(len(words)), np.zeros(len(words))
        at = np.searchsorted(self.words, words)
        at[at == len(self.words)] = 0
        there = self.words[at] == words
        return np.where(there, self.counts[at], 0).astype(float), np.where(there, self.sums[at], 0).astype(float)


#: What a pass hands on: a text's other words, and of each token left open the places there (-1: none), T of the context, the count of the word and q of the pair.
_PASSED = "rid long, doc_id long, n_tokens long, n_known long, base_log double, score double, words array<long>, before array<int>, token array<int>, n_before array<double>, n_token array<double>, n_pair array<double>"
_SCORED = "rid long, doc_id long, n_tokens long, n_known long, base_log double, score double"


def log_p(before: np.ndarray, token: np.ndarray, pair: np.ndarray, divisor: float, noise: float) -> np.ndarray:
    """log10 P(w | v) from T(v), c(w) and q(v, w)."""
    lam = before / (before + noise + DAMP)
    return np.log10(lam * np.minimum(before, pair) / np.maximum(before + noise, 1.0) + (1 - lam) * (token + 0.5) / divisor)


_FLOATS, _INTS = pa.list_(pa.float64()), pa.list_(pa.int32())
_PASSED_ARROW = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_log", pa.float64()), ("score", pa.float64()), ("words", pa.list_(pa.int64())), ("before", _INTS), ("token", _INTS), ("n_before", _FLOATS), ("n_token", _FLOATS), ("n_pair", _FLOATS)])


def _scored(s: Shard, ids: list, n: np.ndarray, words: np.ndarray, inverse: np.ndarray, pairs) -> Iterator[tuple]:
    """Rows without rid of texts of n tokens, words[inverse]; pairs(places) gives q where it matters."""
    doc = np.repeat(np.arange(len(n)), n)
    flat = words[inverse]
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    c, t = (x[inverse] for x in s.exact(words))
    before = np.concatenate(([0.0], t[:-1]))
    before[starts] = s.start
    token_open = (c <= 0) & (s.others > 0)
    before_open = np.concatenate(([False], token_open[:-1]))
    before_open[starts] = False
    at = np.flatnonzero((before > 0) | before_open)
    pair = np.zeros(len(flat))
    pair[at] = pairs(at)
    still = token_open | before_open
    score = np.bincount(doc, np.where(~still, log_p(before, c, pair, s.divisor, s.noise), 0.0), minlength=len(n))
    base = np.bincount(doc, np.where(~token_open, np.log10(c + 0.5), 0.0), minlength=len(n))
    known = np.bincount(doc, ~token_open & (c > 0), minlength=len(n)).astype(np.int64)
    left = np.flatnonzero(still)
    cut = np.searchsorted(left, np.concatenate((starts, [len(flat)])))
    for i, d in enumerate(ids):
        x = left[cut[i] : cut[i + 1]]
        t, b = x[token_open[x]], x[before_open[x]]
        own, place = np.unique(np.concatenate((flat[t], flat[b - 1])), return_inverse=True)
        to, bo = np.full(len(x), -1, np.int32), np.full(len(x), -1, np.int32)
        to[token_open[x]], bo[before_open[x]] = place[: len(t)], place[len(t) :]
        yield d, int(n[i]), int(known[i]), float(base[i]), float(score[i]), own.view(np.int64), bo, to, before[x], c[x], pair[x]


def _with_rid(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() << 33
    yield from in_chunks(((first + i, *r) for i, r in enumerate(rows)), _PASSED_ARROW, weight=lambda r: 8 * len(r[6]) + 32 * len(r[7]))


def _score(shard):
    """(doc_id, text) with the whole filter at hand."""

    def run(batches):
        s: Shard = shard.value

        def rows():
            for b in batches:
                seqs = [tokens(t) for t in bytes_of(b.column(1))]
                if seqs:
                    flat = np.concatenate(seqs)
                    keys = pair_keys(contexts(seqs), flat, s.hot)
                    yield from _scored(s, b.column(0).to_pylist(), np.array([len(x) for x in seqs]), *placed(flat), lambda at, k=keys: s.count(k[at], bucket_of(k[at], len(s.starts))))

        yield from _with_rid(rows())

    return run


def _chunks(batches, most: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and tokens of about `most` tokens, whole texts."""
    ids, seqs, n = [], [], 0
    for b in batches:
        for d, text in zip(b.column(0).to_pylist(), bytes_of(b.column(1)), strict=True):
            ids.append(d)
            seqs.append(tokens(text))
            n += len(seqs[-1])
            if n >= most:
                yield ids, seqs
                ids, seqs, n = [], [], 0
    if ids:
        yield ids, seqs


def _chunk_id(flat: np.ndarray, seqs: list[np.ndarray]) -> int:
    """Of a chunk's texts, on which alone its answers depend."""
    h = xxhash.xxh64(flat.tobytes())
    h.update(np.array([len(x) for x in seqs], np.int64).tobytes())
    return int(np.uint64(h.intdigest()).astype(np.int64))


def _narrow(x: np.ndarray, width: int) -> bytes:
    """Numbers below 256^width."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def _wide(packed: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(packed) // width, 4), np.uint8)
    out[:, :width] = np.frombuffer(packed, np.uint8).reshape(-1, width)
    return out.view("<u4").ravel().astype(np.int64)


def _width(n: int) -> int:
    return 2 if n <= 1 << 16 else 3 if n <= 1 << 24 else 4


_ASKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("low", pa.int64()), ("data", pa.binary())])
_ASKED_SQL = "bucket int, kind int, chunk long, low long, data binary"
_ANSWERED = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("low", pa.int64()), ("ids", pa.list_(pa.int64())), ("n", pa.binary()), ("words", pa.binary()), ("data", pa.binary())])
_ANSWERED_SQL = "chunk long, kind int, low long, ids array<long>, n binary, words binary, data binary"


def _ask(buckets: int, hot: np.ndarray, most: int):
    """The distinct pairs of each chunk, in order, in rows of one bucket."""

    def run(batches):
        def rows():
            for _, seqs in _chunks(batches, most):
                flat = np.concatenate(seqs)
                keys, chunk = distinct(pair_keys(contexts(seqs), flat, hot)), _chunk_id(flat, seqs)
                cut = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
                for i in np.flatnonzero(np.diff(cut)).tolist():
                    for low in range(int(cut[i]), int(cut[i + 1]), ROW):
                        yield i, 1, chunk, low, keys[low : min(low + ROW, int(cut[i + 1]))].tobytes()

        yield from in_chunks(rows(), _ASKED, weight=lambda r: len(r[4]))

    return run


def _answer(batches):
    """Filters (kind 0) and pairs in order of (bucket, kind) -> a level in one byte for each pair."""
    held, bits = None, np.zeros(1, np.uint64)

    def rows():
        nonlocal held, bits
        for b in batches:
            bucket, kind, chunk, low, data = (c.to_pylist() for c in b.columns)
            i = 0
            while i < len(bucket):
                if bucket[i] != held:
                    held, bits = bucket[i], np.zeros(1, np.uint64)
                if not kind[i]:
                    bits = np.frombuffer(data[i], np.uint64)
                    i += 1
                    continue
                j = i
                while j < len(bucket) and bucket[j] == held:
                    j += 1
                keys = np.frombuffer(b"".join(data[i:j]), np.uint64)
                level = levels_in(keys, bits, np.zeros(len(keys), np.int64), np.full(len(keys), len(bits))).astype(np.uint8)
                at = 0
                for k in range(i, j):
                    yield chunk[k], 0, low[k], None, None, None, level[at : (at := at + len(data[k]) // 8)].tobytes()
                i = j

    yield from in_chunks(rows(), _ANSWERED, weight=lambda r: len(r[6]))


def _pack(most: int):
    """Each chunk as one row that its answers are joined to."""

    def run(batches):
        def rows():
            for ids, seqs in _chunks(batches, most):
                flat = np.concatenate(seqs)
                words, inverse = placed(flat)
                yield _chunk_id(flat, seqs), 1, 0, ids, np.array([len(x) for x in seqs], np.int64).tobytes(), words.tobytes(), _narrow(inverse, _width(len(words)))

        yield from in_chunks(rows(), _ANSWERED, weight=lambda r: len(r[5]) + len(r[6]))

    return run


def _score_chunks(shard):
    """Answers (kind 0) and chunks in order of (chunk, kind, low)."""

    def run(batches):
        s: Shard = shard.value

        def rows():
            of, levels = None, {}
            for b in batches:
                for chunk, kind, low, ids, n, words, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if chunk != of:
                        of, levels = chunk, {}
                    if not kind:
                        levels[low] = data  # equal chunks have equal answers
                        continue
                    n, words = np.frombuffer(n, np.int64), np.frombuffer(words, np.uint64)
                    inverse = _wide(data, _width(len(words)))
                    flat = words[inverse]
                    seqs = np.split(flat, np.cumsum(n)[:-1])
                    keys, place = placed(pair_keys(contexts(seqs), flat, s.hot))
                    level = np.frombuffer(b"".join(levels[k] for k in sorted(levels)), np.uint8)
                    if len(level) != len(keys):
                        raise RuntimeError("texts came in another order when they were read again; write them out before they are scored")
                    yield from _scored(s, ids, n, words, inverse, lambda at, level=level, place=place: quantised(level[place[at]]))

        yield from _with_rid(rows())

    return run


def _finish(divisor: float, noise: float):
    """Passed rows with (place, n, t) of the words that the join found -> rows whose tokens are all scored."""
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_log", pa.float64()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            out = []
            for rid, d, n, known, base, score, size, before, token, n_before, n_token, n_pair, got in zip(*([*c] for c in b.columns), strict=True):
                counts, sums = np.zeros(size.as_py() + 1), np.zeros(size.as_py() + 1)  # the last is for places of -1
                if got.is_valid:
                    k = got.values.field("k").to_numpy()
                    counts[k], sums[k] = got.values.field("n").to_numpy(), got.values.field("t").to_numpy()
                at, of = token.values.to_numpy(), before.values.to_numpy()
                c, v = n_token.values.to_numpy() + counts[at], n_before.values.to_numpy() + sums[of]
                more, c_open = log_p(v, c, n_pair.values.to_numpy(), divisor, noise).sum(), c[at >= 0]
                out.append((rid.as_py(), d.as_py(), n.as_py(), known.as_py() + int((c_open > 0).sum()), base.as_py() + float(np.log10(c_open + 0.5).sum()), score.as_py() + float(more)))
            yield rows_to_batch(out, schema)

    return run


@dataclass
class LanguageModel:
    vocabulary: DataFrame  # word (hash), n, t
    filters: DataFrame  # bucket, words64, taken, bits
    buckets: int
    hot: np.ndarray
    train_tokens: int
    types: int
    least_common: int  # words of at least this count are frequent
    start: int
    taken: float

    @property
    def divisor(self) -> float:
        return self.train_tokens + 0.5 * (self.types + 1)

    @property
    def noise(self) -> float:
        return self.taken * (self.types + 1)


def hot_words(texts: DataFrame, n_docs: int) -> np.ndarray:
    """START and the commonest words of about HOT_DOCS documents, sorted."""
    sample = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 53)) < int(min(1.0, HOT_DOCS / max(1, n_docs)) * (1 << 53)))

    def run(batches):
        for b in batches:
            words, counts = np.unique(np.concatenate([tokens(t) for t in bytes_of(b.column(0))] or [np.array([], np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts.astype(np.int64))], names=["word", "n"])

    top = sample.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(HOT).collect()
    return np.unique(np.array([START, *(np.int64(r.word).astype(np.uint64) for r in top)], dtype=np.uint64))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_each: int = BITS) -> LanguageModel:
    """Counts over all rows of docs."""
    small_batches(docs.sparkSession)
    texts = id_and_text(docs, id_col, text_col)
    chars, n_docs = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count("*")).first()
    buckets = max(16, ceil(chars / CHARS_A_BUCKET))
    hot = hot_words(texts, n_docs)
    blocks = texts.select("text").mapInArrow(_fold(buckets, hot), "bucket int, kind int, keys binary, counts binary, words binary")
    merged = stash(blocks.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_merge(hot, bits_each), _MERGED_SQL), "ngrams", by=["kind"])
    parts = merged.where("kind = 2").groupBy(F.col("key").alias("word")).agg(F.sum("n").alias("n"), F.sum("t").alias("t")).collect()  # HOT words and START
    spread = docs.sparkSession.createDataFrame([(r.word, r.n, r.t) for r in parts if r.n], "word long, n long, t long")
    start = sum(r.t for r in parts if not r.n)
    vocabulary = merged.where("kind = 0").select(F.col("key").alias("word"), "n", "t").unionByName(spread)
    filters = merged.where("kind = 1").select(F.col("key").cast("int").alias("bucket"), (F.length("bits") / 8).cast("long").alias("words64"), "taken", "bits")
    # a histogram of log-spaced counts settles from which count on words are frequent
    step = F.floor(F.log2("n") * 16).cast("int")
    by_count = sorted((r.step, r.low, r.types, r.tokens) for r in vocabulary.groupBy(step.alias("step")).agg(F.min("n").alias("low"), F.count("*").alias("types"), F.sum("n").alias("tokens")).collect())
    total, types, least, room = sum(x[3] for x in by_count), sum(x[2] for x in by_count), 1 << 62, COMMON
    for _, low, k, _ in reversed(by_count):
        if k > room:
            break
        room -= k
        least = low
    rate = filters.agg(F.coalesce(F.sum(F.col("taken") * F.col("words64")) / F.sum("words64"), F.lit(0.0))).first()[0]
    return LanguageModel(vocabulary, filters, buckets, hot, int(total), int(types), int(least), int(start), float(rate))


def _frequent(model: LanguageModel) -> Shard:
    """The frequent words, and no bucket."""
    got = model.vocabulary.where(F.col("n") >= model.least_common).select("word", "n", "t").toArrow()
    words, counts, sums = got.column("word").to_numpy().view(np.uint64), got.column("n").to_numpy(), got.column("t").to_numpy()
    order = np.argsort(words)
    none = np.array([], np.int64)
    return Shard(words[order], counts[order], sums[order], none, none, np.array([], np.uint64), float(model.types - len(words)), float(model.start), model.hot, model.divisor, model.noise)


def _shards(model: LanguageModel) -> Iterator[Shard]:
    """One shard after the other; each is collected by itself and bounded by SHARD_BYTES."""
    frequent = _frequent(model)
    sizes = dict(model.filters.select("bucket", "words64").collect())
    plan: list[list[int]] = [[]]
    load = 0
    for b in sorted(sizes):
        if load + 8 * sizes[b] > SHARD_BYTES and plan[-1]:
            plan.append([])
            load = 0
        plan[-1].append(b)
        load += 8 * sizes[b]
    for k, some in enumerate(plan):
        starts, words64 = np.full(model.buckets, -1, dtype=np.int64), np.full(model.buckets, 1, dtype=np.int64)
        low, high = (some[0], some[-1]) if some else (0, -1)
        bits = bytearray()
        for r in model.filters.where(F.col("bucket").between(low, high)).select("bucket", "bits").toLocalIterator():
            starts[r.bucket], words64[r.bucket] = len(bits) // 8, len(r.bits) // 8
            bits += r.bits
        if k == len(plan) - 1:  # buckets without any pair: a shared empty one, in the last shard
            starts[[b for b in range(model.buckets) if b not in sizes]] = len(bits) // 8
            bits += bytes(8)
        yield replace(frequent, starts=starts, sizes=words64, bits=np.frombuffer(bytes(bits), np.uint64))


def score(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score: one row for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = id_and_text(docs, id_col, text_col)
    if 8 * (model.filters.agg(F.sum("words64")).first()[0] or 0) <= min(SMALL, SHARD_BYTES):
        (shard,) = _shards(model)
        held = spark.sparkContext.broadcast(shard)
        passed = texts.mapInArrow(_score(held), _PASSED)
    else:
        held = spark.sparkContext.broadcast(_frequent(model))
        chars = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
        none = [F.lit(None).cast("long").alias(c) for c in ("chunk", "low")]
        filters = model.filters.select("bucket", F.lit(0).alias("kind"), *none, F.col("bits").alias("data"))
        asked = texts.mapInArrow(_ask(model.buckets, model.hot, ASKED), _ASKED_SQL).unionByName(filters)
        answers = asked.repartition(model.buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_answer, _ANSWERED_SQL)
        both = answers.unionByName(texts.mapInArrow(_pack(ASKED), _ANSWERED_SQL))
        passed = both.repartition(max(16, ceil(chars / CHARS_A_BUCKET)), "chunk").sortWithinPartitions("chunk", "kind", "low").mapInArrow(_score_chunks(held), _PASSED)
    parts = stash(passed, "scores")
    held.unpersist()
    if model.least_common > 1:  # some words are not among the frequent ones
        others = parts.select("rid", F.posexplode("words").alias("k", "word")).join(model.vocabulary.where(F.col("n") < model.least_common), "word")
        others = others.groupBy("rid").agg(F.collect_list(F.struct("k", "n", "t")).alias("got"))
        cols = [F.col(c) if c != "words" else F.size("words").alias("size") for c in parts.columns]
        done = parts.join(others, "rid", "left").select(*cols, "got").mapInArrow(_finish(model.divisor, model.noise), _SCORED)
    else:
        done = parts.select("rid", "doc_id", "n_tokens", "n_known", "base_log", "score")
    base = F.col("base_log") - F.col("n_tokens") * log10(model.divisor)
    return done.select("doc_id", "n_tokens", "n_known", base.alias("base_score"), "score")


def op9_lm_bloom(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(True))
    model = train(docs.where(~held))
    return score(docs, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
