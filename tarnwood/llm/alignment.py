"""Alignment of two tokenizers over the same bytes, in relations.

Units. A space between two characters that are no white space parts what either tokenizer reads: the first one's pattern starts a match there, and no piece of the second
one holds a space after another character (tested against whole texts). So a text is a sequence of units, and tokens, cuts and links of a text are those of its units. Distinct units are
tokenized and aligned once, with the number of times they occur.

Relations. Tokens are exploded with their positions; a windowed sum of byte lengths gives each its end; both sides are joined on unit and end,
by one grouping of all ends (a full equi-join whose result stays with its unit). An end of both is a cut; running counts of cuts number the groups. Each end of either side closes a stretch of bytes that lies in one token of each side: the
next token of a side at or after it, taken by one window over a unit's ends. These stretches are the links, as many as ends, so no pairs within a group are formed.
Counts of linked id pairs are sums of occurrences; a B id's highest is a maximum over its pairs.

Back to the texts. What units have is added up by document, group lists in order. Units that occur often (COMMON at most, of bounded length) are
broadcast; each document gets those of its other units by a join on the unit and one on the document.

Defined cases. Null and empty texts, and texts whose joined bytes differ (U+2581, which the second tokenizer reads as a space): zeros and an empty digest; their tokens count nowhere.
Null ids: as others. Repeated rows: each has its own row and counts. Very long texts: aligned whole; a text without spaces is one unit. Ties: all pairs with the highest count are best. Empty
tables: no rows. Other columns of any name are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import discard, frequent_join, id_and_text, small_batches, stash

#: Units that are broadcast at most, and bytes of such a unit and of its group list; pairs of ids that are broadcast at most; counts that a task gathers.
COMMON, UNIT_BYTES, GROUP_BYTES, PAIRS, GATHERED = 400_000, 64, 256, 100_000, 200_000
_ODD, _CUT = re.compile(r"\s "), re.compile(r"(?<=\S)(?= \S)")


def units(text: str) -> list[str]:
    """The units of space + text, each without its first space."""
    s = " " + text
    if not _ODD.search(s) and s[-1] != " ":
        return s.split(" ")[1:]
    return [u[1:] for u in _CUT.split(s)]


class Pair:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in letters)}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        size = self.b.get_piece_size()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(size)))]
        self.a_size, self.b_size = (np.array([len(x) for x in t], dtype=np.int32) for t in (self.a_bytes, self.b_bytes))

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of space + text, and of text."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        return a, self.b.encode(texts, num_threads=1)

    def whole(self, text: str, a: list[int], b: list[int]) -> bool:
        """Both sides' bytes are those of space + text."""
        want = (" " + text).encode()
        return b"".join(map(self.a_bytes.__getitem__, a)) == want == b"".join(map(self.b_bytes.__getitem__, b))


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair(a_path: str, b_path: str) -> Pair:
    if (a_path, b_path) not in _PAIRS:
        _PAIRS[a_path, b_path] = Pair(a_path, b_path)
    return _PAIRS[a_path, b_path]


def _readable(text: str) -> bool:
    """The text has tokens: the second tokenizer gives back every character but the one that stands for a space in it."""
    return bool(text) and "▁" not in text


def counted_units(docs: DataFrame) -> DataFrame:
    """(unit, n) over the texts that have tokens."""

    def run(batches):
        seen: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["unit", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                if _readable(t):
                    seen.update(units(t))
            if len(seen) > GATHERED:
                yield rows()
                seen.clear()
        yield rows()

    return docs.select("text").mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


_ENCODED = "uid long, unit string, n long, a array<int>, a_size array<int>, b array<int>, b_size array<int>"


def encoded_units(counts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Ids and byte lengths of each unit, with a number of its own."""

    def run(batches):
        two, at = pair(a_path, b_path), TaskContext.get().partitionId() << 40
        for batch in batches:
            names = batch.column(0).to_pylist()
            a, b = two.encode(names)
            if not all(map(two.whole, names, a, b)):
                raise ValueError("a text that both tokenizers should give back differs")
            lists = [[np.array(x, dtype=np.int32) for x in side] for side in (a, b)]
            sizes = [[table[x] for x in side] for side, table in zip(lists, (two.a_size, two.b_size), strict=True)]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(at, at + len(names)), pa.int64()), batch.column(0), batch.column(1), pa.array(lists[0], kind), pa.array(sizes[0], kind), pa.array(lists[1], kind), pa.array(sizes[1], kind)],
                names=["uid", "unit", "n", "a", "a_size", "b", "b_size"],
            )
            at += len(names)

    return counts.mapInArrow(run, _ENCODED)


def ends(encoded: DataFrame) -> DataFrame:
    """(uid, is_a, pos, id, end): tokens of both sides with the byte after their last."""
    tokens = encoded.select("uid", F.expr("inline(concat(transform(a, (x, i) -> struct(true AS is_a, i AS pos, x AS id, a_size[i] AS size)), transform(b, (x, i) -> struct(false AS is_a, i AS pos, x AS id, b_size[i] AS size))))"))
    end = F.sum("size").over(Window.partitionBy("uid", "is_a").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return tokens.select("uid", "is_a", "pos", "id", end.alias("end"))


def links(encoded: DataFrame) -> DataFrame:
    """One row for each link: uid, end (of the shared stretch), group (counted from the last), a_pos, b_pos (where a token ends there), a_id, b_id."""
    e = ends(encoded)
    both = e.groupBy("uid", "end").agg(*[F.max(F.when(F.col("is_a") == (side == "a"), F.col(c))).alias(f"{side}_{c}") for side in "ab" for c in ("pos", "id")])
    back = Window.partitionBy("uid").orderBy(F.col("end").desc()).rowsBetween(Window.unboundedPreceding, 0)
    cut = F.col("a_id").isNotNull() & F.col("b_id").isNotNull()
    return both.select("uid", "end", F.sum(cut.cast("int")).over(back).alias("group"), "a_pos", "b_pos", cut.alias("cut"), F.last("a_id", True).over(back).alias("a_id"), F.last("b_id", True).over(back).alias("b_id"))


def aligned(encoded: DataFrame) -> DataFrame:
    """Each unit with its counts, its group list and its links."""
    encoded = encoded.repartition("uid")  # the only shuffle: all below is by unit
    by_unit = links(encoded).groupBy("uid").agg(F.count(F.lit(1)).alias("n_links"), F.sum(F.col("cut").cast("long")).alias("n_groups"), F.collect_list(F.when(F.col("cut"), F.struct("a_pos", "b_pos"))).alias("cuts"), F.collect_list(F.struct("a_id", "b_id")).alias("links"))
    cuts = by_unit.withColumn("cuts", F.array_sort("cuts"))
    group = """transform(cuts, (c, i) -> concat(
        array_join(slice(a, if(i = 0, 0, cuts[i - 1].a_pos + 1) + 1, c.a_pos - if(i = 0, -1, cuts[i - 1].a_pos)), ','), '|',
        array_join(slice(b, if(i = 0, 0, cuts[i - 1].b_pos + 1) + 1, c.b_pos - if(i = 0, -1, cuts[i - 1].b_pos)), ',')))"""
    return encoded.join(cuts, "uid").select("uid", "unit", "n", F.size("a").cast("long").alias("n_a"), F.size("b").cast("long").alias("n_b"), "n_groups", "n_links", F.concat_ws(";", F.expr(group)).alias("groups"), "links")


def pair_counts(units_: DataFrame) -> DataFrame:
    """a_id, b_id, rows (units' links), count (links of the corpus), best (1 for a B id's highest)."""
    pairs = units_.select("n", F.explode("links").alias("l")).groupBy("l.a_id", "l.b_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("count"))
    pairs = stash(pairs, "pairs")
    top = pairs.groupBy(F.col("b_id").alias("top_id")).agg(F.max("count").alias("top"))  # a row for each id of B's vocabulary
    return pairs.join(F.broadcast(top), F.col("b_id") == F.col("top_id")).select("a_id", "b_id", "rows", "count", (F.col("count") == F.col("top")).cast("long").alias("best"))


_VALUES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def unit_table(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """unit, n, numbers (those of _VALUES) and the group list, one row for each distinct unit of the texts."""
    counts = stash(counted_units(docs), "units")
    encoded = stash(encoded_units(counts, a_path, b_path), "encoded")
    units_ = stash(aligned(encoded), "aligned")
    discard(counts, encoded)
    each = units_.select("uid", F.explode("links").alias("l")).select("uid", "l.*")
    sums = frequent_join(each, pair_counts(units_), ["a_id", "b_id"], "rows", PAIRS).groupBy("uid").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    out = stash(units_.drop("links").join(sums, "uid").select("unit", "n", F.concat_ws(",", *_VALUES).alias("numbers"), "groups"), "unit-table")
    discard(units_)
    return out


def common_units(table: DataFrame, most: int = COMMON) -> pa.Table:
    """unit, numbers, groups of the most frequent units of bounded length: `most` at most, all that occur as often as the least frequent of them."""
    short = table.where((F.octet_length("unit") <= UNIT_BYTES) & (F.octet_length("groups") <= GROUP_BYTES))
    step = F.floor(F.log2("n") * 16).cast("int")
    level, held = None, 0
    for r in sorted(short.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):  # 16 rows for each doubling of a count
        held += r["count"]
        if held > most:
            break
        level = r["step"]
    return short.where(F.lit(False) if level is None else step >= level).select("unit", "numbers", "groups").toArrow()


class Common:
    """The common units in a worker. Broadcast as one buffer; a worker holds a number for each unit, and group lists in one piece of memory."""

    def __init__(self, table: pa.Table):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self.data = sink.getvalue().to_pybytes()
        self.at: dict[str, int] | None = None

    def __getstate__(self):
        return self.data

    def __setstate__(self, data):
        self.data, self.at = data, None

    def read(self) -> Common:
        if self.at is None:
            _PAIRS.clear()  # a worker that looks units up tokenizes no more
            self.at, sizes, lists, numbers = {}, [], [], []
            for b in pa.ipc.open_stream(self.data):
                for start in range(0, len(b), 10_000):
                    some = b.slice(start, 10_000)
                    for u in some.column(0).to_pylist():
                        self.at[u] = len(self.at)
                    groups = [g.encode() for g in some.column(2).to_pylist()]
                    sizes += map(len, groups)
                    lists.append(b"".join(groups))
                    numbers.append(np.array([n.split(",") for n in some.column(1).to_pylist()], dtype=np.int64))
            self.ends = np.cumsum(np.array(sizes, dtype=np.int64)).tolist()
            self.lists = b"".join(lists)
            self.numbers = np.concatenate(numbers) if numbers else np.zeros((0, len(_VALUES)), dtype=np.int64)
            self.data = b""
        return self

    def groups(self, i: int) -> bytes:
        return self.lists[self.ends[i - 1] if i else 0 : self.ends[i]]


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", most: int = COMMON) -> DataFrame:
    """doc_id, the counts of _VALUES and `groups`, the group list of each text as one string (empty without tokens)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = id_and_text(docs, id_col, text_col)
    table = unit_table(docs, a_path, b_path)
    known = spark.sparkContext.broadcast(Common(common_units(table, most)))
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")

    def rare(batches):
        often = known.value.read().at
        for b in batches:
            keys, found = [], []
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if _readable(t):
                    some = [u for u in set(units(t)) if u not in often]
                    keys += [key] * len(some)
                    found += some
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.string())], names=["key", "unit"])

    # texts whose keys are equal by chance share their lists: a text looks up its own units only
    wanted = keyed.select("key", "text").mapInArrow(rare, "key long, unit string")
    lists = wanted.join(table, "unit").groupBy("key").agg(F.collect_set(F.struct("unit", "groups", "numbers")).alias("rare"))
    rows = keyed.join(lists, "key", "left").select("doc_id", "text", "rare")

    def run(batches):
        often = known.value.read()
        for b in batches:
            out = []
            for doc_id, t, some in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not _readable(t):
                    out.append((doc_id, *[0] * len(_VALUES), ""))
                    continue
                own = {r["unit"]: (r["groups"].encode(), r["numbers"]) for r in some or ()}
                us = units(t)
                places = [often.at.get(u, -1) for u in us]
                held = np.array(places, dtype=np.int64)
                sums = often.numbers[held[held >= 0]].sum(0)
                lists = [often.groups(i) if i >= 0 else own[u][0] for i, u in zip(places, us, strict=True)]
                others = [own[u][1].split(",") for i, u in zip(places, us, strict=True) if i < 0]
                if others:
                    sums = sums + np.array(others, dtype=np.int64).sum(0)
                out.append((doc_id, *sums.tolist(), b";".join(lists).decode()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * (1 + len(_VALUES)) + [pa.string()], strict=True)], names=["doc_id", *_VALUES, "groups"])

    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{v} long" for v in _VALUES) + ", groups string")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of all documents."""
    import public_tokenizers

    out = align(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", *_VALUES, F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"))
