"""Byte-level BPE encoding and decoding over length-bucketed numpy matrices.

A text is split by the vocabulary's pattern; distinct pieces that a worker has not met yet are
grouped by length into padded matrices of token ids. In each round every row merges its leftmost
pair of least rank; ranks come from a hashed table of pairs, rows that have no pair left are taken
out and the columns close up. A piece beyond WIDE bytes is a row by itself. A round merges its pair at all places, from left to right, if no pair
with the merged token ranks below it, as the next rounds would merge just these, one by one; its columns close up when half of them are empty.

Defined cases. Null text: the empty text, which has no tokens. Null ids: encoded and returned as null. Repeated rows: encoded alike. Very long
texts and pieces: encoded whole, by the same rounds. Ties (a pair at several places): leftmost first. Empty
tables: no rows. Other columns of any name are ignored by `encode`.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, rows_to_batch, small_batches

#: Bytes beyond which a round merges a pair at all its places; cells of a matrix; pieces that a worker's cache holds.
WIDE, CELLS, CACHED = 128, 1 << 19, 200_000
NONE = np.int32(2**31 - 1)


class PairTable:
    """(left id, right id) -> rank, by open addressing; looked up for whole arrays at once."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        bits = max(4, (3 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << bits, NONE, dtype=np.int32)
        key = np.array([(a << 32) | b for a, b in pairs], dtype=np.int64)
        rank = np.array(list(pairs.values()), dtype=np.int32)
        at, left = self._home(key), np.arange(len(key))
        self.probes = 1
        while len(left):
            free = self.keys[at[left]] < 0
            _, first = np.unique(at[left], return_index=True)
            wins = np.zeros(len(left), dtype=bool)
            wins[first] = True
            wins &= free
            self.keys[at[left[wins]]] = key[left[wins]]
            self.ranks[at[left[wins]]] = rank[left[wins]]
            left = left[~wins]
            at[left] = (at[left] + 1) & self.mask
            self.probes += bool(len(left))

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """int32 ranks, NONE for what is no pair; negative ids are padding."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        key[(left < 0) | (right < 0)] = -2
        at = self._home(key)
        out = np.full(key.shape, NONE, dtype=np.int32)
        open_ = np.flatnonzero((key >= 0).ravel())
        flat, flat_at, flat_out = key.ravel(), at.ravel(), out.ravel()
        for _ in range(self.probes):
            if not len(open_):
                break
            there = self.keys[flat_at[open_]]
            hit = there == flat[open_]
            flat_out[open_[hit]] = self.ranks[flat_at[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
            flat_at[open_] = (flat_at[open_] + 1) & self.mask
        return flat_out.reshape(key.shape)


class Coder:
    """One vocabulary in one worker."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.ids = ranks
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.single = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.pairs = {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.table = PairTable(self.pairs)
        # by token: no pair that it is a part of ranks below it
        self.settled = np.ones(len(self.bytes), dtype=bool)
        for (a, b), r in self.pairs.items():
            self.settled[a] &= r > a
            self.settled[b] &= r > b
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        pieces = [self.split(t) for t in texts]
        fresh = set().union(*pieces)
        if len(self.cache) + len(fresh) > CACHED:
            self.cache.clear()
        fresh.difference_update(self.cache)
        known = self.cache
        if len(fresh) > CACHED:  # one batch of more distinct pieces than the cache may hold
            known = {}
            fresh = set().union(*pieces)
        known.update(self.merge(list(fresh)))
        return [b"".join([known[p] for p in ps]) for ps in pieces]

    def merge(self, pieces: list[str]) -> dict[str, bytes]:
        done: dict[str, bytes] = {}
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            raw = p.encode()
            if (i := self.ids.get(raw)) is not None:  # a whole token is what its merges would end in, or the rank file's own rule
                done[p] = i.to_bytes(4, "little")
            else:
                by_width.setdefault(1 << (len(raw) - 1).bit_length(), []).append((p, raw))
        for width, some in by_width.items():
            if width > WIDE:
                done.update((p, self.by_row(raw)) for p, raw in some)
                continue
            step = max(1, CELLS // width)
            for i in range(0, len(some), step):
                part = some[i : i + step]
                for (p, _), ids in zip(part, self.by_matrix([raw for _, raw in part], width), strict=True):
                    done[p] = ids
        return done

    def by_matrix(self, raws: list[bytes], width: int) -> list[bytes]:
        flat = np.frombuffer(b"".join(raws), dtype=np.uint8)
        n = np.array([len(r) for r in raws])
        cells = np.full((len(raws), width), -1, dtype=np.int32)
        cells[np.arange(width) < n[:, None]] = self.single[flat]
        out: list[bytes] = [b""] * len(raws)
        rows = np.arange(len(raws))
        ranks = self.table.rank(cells[:, :-1], cells[:, 1:]) if width > 1 else np.full((len(raws), 0), NONE, dtype=np.int32)
        while len(rows):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), dtype=np.int64)
            least = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NONE)
            if (over := least == NONE).any():
                for r, cell in zip(rows[over], cells[over], strict=True):
                    out[r] = cell[cell >= 0].astype("<u4").tobytes()
                rows, cells, ranks, at, least = (x[~over] for x in (rows, cells, ranks, at, least))
                if not len(rows):
                    break
            here = np.arange(len(rows))
            cells[here, at] = least  # the merged token's id is its rank
            col = np.arange(cells.shape[1] - 1)
            close = col > at[:, None]
            cells = np.where(close, cells[:, 1:], cells[:, :-1])
            ranks = np.where(col[:-1] > at[:, None], ranks[:, 1:], ranks[:, :-1])
            if ranks.shape[1]:
                for side in (at - 1, at):
                    ok = (side >= 0) & (side < ranks.shape[1])
                    i, j = here[ok], side[ok]
                    ranks[i, j] = self.table.rank(cells[i, j], cells[i, j + 1])
        return out

    def by_row(self, raw: bytes) -> bytes:
        cells = self.single[np.frombuffer(raw, dtype=np.uint8)]
        ranks = np.append(self.table.rank(cells[:-1], cells[1:]), NONE)
        alive = 0
        while (least := ranks[at := int(ranks.argmin())]) != NONE:
            if 2 * alive < len(cells):  # close up; columns of their own number their neighbours
                stay = cells >= 0
                cells, ranks = cells[stay], ranks[stay]
                alive = len(cells)
                after, before = np.arange(1, len(cells) + 1), np.arange(-1, len(cells) - 1)
                at = int(ranks.argmin())
            left = np.flatnonzero(ranks == least) if self.settled[least] else np.array([at])
            k = np.arange(len(left))
            run = np.maximum.accumulate(np.where(np.append(True, left[1:] != after[left[:-1]]), k, 0))
            left = left[(k - run) % 2 == 0]  # places that do not overlap one to the left
            right = after[left]
            cells[left], cells[right], ranks[right] = least, -1, NONE  # the merged token's id is its rank
            after[left] = beyond = after[right]
            inside = beyond < len(cells)
            before[beyond[inside]] = left[inside]
            ranks[left[~inside]] = NONE
            ranks[left[inside]] = self.table.rank(cells[left[inside]], cells[beyond[inside]])
            ahead = before[left]
            left, ahead = left[ahead >= 0], ahead[ahead >= 0]
            ranks[ahead] = self.table.rank(cells[ahead], cells[left])
            alive -= len(right)
        return cells[cells >= 0].astype("<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_CODERS: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = Coder(path, pattern)
    return _CODERS[path, pattern]


def _strings(column: pa.Array, at_most: int) -> Iterator[list[str]]:
    """The texts in lists of bounded size."""
    some, load = [], 0
    for t in column.to_pylist():
        some.append(t)
        load += len(t)
        if load > at_most:
            yield some
            some, load = [], 0
    yield some


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: the ids of each whole text."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        c = coder(path, pattern)
        for b in batches:
            ids = [x for some in _strings(b.column(1), 500_000) for x in c.encode(some)]
            yield rows_to_batch([(d, np.frombuffer(x, dtype="<i4")) for d, x in zip(b.column(0).to_pylist(), ids, strict=True)], schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, bytes: the bytes that the ids stand for."""
    schema = pa.schema([("doc_id", pa.int64()), ("bytes", pa.binary())])

    def run(batches):
        c = coder(path, pattern)
        for b in batches:
            yield rows_to_batch([(d, c.decode(np.array(ids or [], dtype="<u4").tobytes())) for d, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], schema)

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, and decoded again, in one pass."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        c = coder(path, pattern)
        for b in batches:
            ids = [x for some in _strings(b.column(1), 500_000) for x in c.encode(some)]
            rows = [(d, len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(c.decode(x)).hexdigest()) for d, x in zip(b.column(0).to_pylist(), ids, strict=True)]
            yield rows_to_batch(rows, schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def public_vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op5_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), *public_vocabulary())
