"""Product codes of vectors: integer codebooks refined over the whole table, nearest entries found by screened matrix products.

Components become integers floor(SCALE x). A vector is cut into PARTS equal consecutive parts; each part position has a codebook of ENTRIES
entries, at first that part of the vectors of the smallest ids. ROUNDS times every part is assigned to its nearest entry and entries become the
floored means of their parts; then parts are assigned once more.

Assignment. With x a part and c an entry, |c|^2 - 2 x.c is compared over entries; x.c comes from one float32 matrix product for a batch and a part.
Rounding of inputs, products and sums in any order moves x.c by at most (d + 4) u / (1 - (d + 4) u) |x| |c|, u = 2^-24, so the true value lies in an
interval; entries whose interval reaches below the least upper end are evaluated again in int64, and ties go to the lower index. A part with one
such entry is settled. The result doesn't depend on float32 arithmetic.

Each round is one pass with no shuffle but that of the partial sums (PARTS x ENTRIES rows a task at most); what reaches the driver is codebooks.

Defined cases. Dropped: null vectors, vectors with null, NaN or infinite components, and vectors that can't be coded together with the others: empty
ones, those whose length PARTS does not divide, those of another length than the kept vector of the least id. Null ids: coded, larger than any id.
Repeated ids and rows: each row is coded; as seeds, equal ids are ordered by their vectors. Fewer vectors than ENTRIES: so many entries. Null labels
count as one label. Components beyond 2^LARGE (after scaling; up to 2^120, beyond that as non-finite): the same results by whole numbers of any size.
An error, or a label's sum, that exceeds a long is null. Empty tables: no rows. Other columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frequent_join, stash

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Magnitude (a power of two) to which int64 sums of squares are safe for parts of up to 2^10 components.
LARGE = 25
LONG = 2**63 - 1
#: Labels whose sums are broadcast at most: those that hold a share of 1 / LABELS of the rows or more.
LABELS = 10_000
U = 2.0**-24


def kept(table: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, vector, label) of the vectors that can be coded, but for their common length."""
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(2.0**120 / SCALE)))
    some = (F.size(vector_col) > 0) & (F.size(vector_col) % PARTS == 0)
    # a null vector makes the conditions null
    return table.where(fine & some).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"))


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE x) as int64, or as Python ints where one is beyond LARGE. Scaling by a power of two is exact."""
    v = np.floor(values.astype(np.float64) * SCALE)
    if v.size and np.abs(v).max() > 2.0**LARGE:
        return np.array([int(x) for x in v.ravel()], dtype=object).reshape(v.shape)
    return v.astype(np.int64)


def batch_of(column: pa.Array, width: int) -> np.ndarray:
    """Rows x width integers of an Arrow list column whose lists all have this width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return whole(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, exact squared distance) for each row of x."""
    n, d = x.shape
    if x.dtype == object or book.dtype == object or d > 1 << 10:
        return _by_whole_numbers(x, book)
    best = np.empty(n, dtype=np.int64)
    c64, x64 = book.astype(np.float64), x.astype(np.float64)
    squares = (book * book).sum(1).astype(np.float64)
    dots = (x.astype(np.float32) @ book.astype(np.float32).T).astype(np.float64)
    k = (d + 4) * U
    # norms, the difference and this bound are taken in float64; the factor covers their own rounding
    reach = 2 * k / (1 - k) * (1 + 1e-9) * np.sqrt((x64 * x64).sum(1))[:, None] * np.sqrt(squares)[None, :]
    value = squares[None, :] - 2 * dots
    reach += 1e-15 * (squares[None, :] + 2 * np.abs(dots) + reach)
    open_ = value - reach <= (value + reach).min(1)[:, None]
    alone = open_.sum(1) == 1
    best[alone] = open_[alone].argmax(1)
    rest = np.flatnonzero(~alone)
    if len(rest):
        row, entry = np.nonzero(open_[rest])
        exact = ((x[rest[row]] - book[entry]) ** 2).sum(1)
        start = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(exact, start)
        hit = np.flatnonzero(exact == least[row])
        first = np.unique(row[hit], return_index=True)[1]  # entries of a row ascend
        best[rest] = entry[hit[first]]
    return best, ((x - book[best]) ** 2).sum(1)


def _by_whole_numbers(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for components of any size."""
    x, book = x.astype(object), book.astype(object)
    best, far = [], []
    for row in x:
        at = [sum((a - b) ** 2 for a, b in zip(row, c, strict=True)) for c in book]
        far.append(min(at))
        best.append(at.index(far[-1]))
    return np.array(best, dtype=np.int64), np.array(far, dtype=object)


def _narrow(book: list[list[int]]) -> np.ndarray:
    return np.array(book, dtype=np.int64 if max((abs(v) for e in book for v in e), default=0) <= 2**LARGE else object)


def _parts(x: np.ndarray, parts: int) -> Iterator[np.ndarray]:
    w = x.shape[1] // parts
    for p in range(parts):
        y = x[:, p * w : (p + 1) * w]
        yield np.ascontiguousarray(y) if y.dtype != object else y


#: A sum is carried as high * 10^18 + low in two decimals: partial sums of any size add up in the JVM.
_SUMS = "part int, entry int, n long, high array<decimal(38,0)>, low array<decimal(38,0)>"
_TEN18 = 10**18


def _sums(width: int, books: list[np.ndarray]):
    from decimal import Decimal

    parts = len(books)

    def run(batches):
        total = [[None] * len(b) for b in books]
        count = np.zeros((parts, max(len(b) for b in books)), dtype=np.int64)
        for batch in batches:
            x = batch_of(batch.column(0), width)
            if not len(x):
                continue
            for p, y in enumerate(_parts(x, parts)):
                best, _ = nearest(y, books[p])
                order = np.argsort(best, kind="stable")
                used, start = np.unique(best[order], return_index=True)
                sums = np.add.reduceat(y[order], start, axis=0)
                count[p] += np.bincount(best, minlength=count.shape[1])
                for e, s in zip(used.tolist(), sums.tolist(), strict=True):
                    total[p][e] = s if total[p][e] is None else [a + b for a, b in zip(total[p][e], s, strict=True)]  # Python ints
        rows = [(p, e, int(count[p, e]), [Decimal(v // _TEN18) for v in s], [Decimal(v % _TEN18) for v in s]) for p in range(parts) for e, s in enumerate(total[p]) if s is not None]
        if rows:
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0)), pa.list_(pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "entry", "n", "high", "low"])

    return run


def refine(vectors: DataFrame, width: int, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks whose entries are the floored means of the parts next to them."""
    partial = vectors.select("vector").mapInArrow(_sums(width, books), _SUMS)
    long = partial.select("part", "entry", "n", F.posexplode(F.arrays_zip("high", "low")).alias("at", "s"))
    totals = long.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s.high").alias("high"), F.sum("s.low").alias("low"))
    new = [b.astype(object).tolist() for b in books]
    for r in totals.collect():  # PARTS x ENTRIES x the width of a part
        new[r.part][r.entry][r.at] = (int(r.high) * _TEN18 + int(r.low)) // r.n
    return [_narrow(b) for b in new]


def fit(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[int, list[np.ndarray]]:
    """(length of the vectors, codebooks) of a table of kept vectors; (0, []) for an empty one."""
    seeds = table.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), F.size("vector"), "vector").limit(1).collect()
    if not seeds:
        return 0, []
    width = len(seeds[0].vector)
    same = table.where(F.size("vector") == width)
    seeds = same.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    x = whole(np.array([r.vector for r in seeds]))
    books = [_narrow(y.tolist()) for y in _parts(x, parts)]
    for _ in range(rounds):
        books = refine(same, width, books)
    return width, books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for e in b for v in e).encode()).hexdigest()


def encode(table: DataFrame, width: int, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) of each kept vector."""
    same = table.where(F.size("vector") == width)

    def run(batches):
        for batch in batches:
            x = batch_of(batch.column(2), width)
            if not len(x):
                continue
            codes, far = np.empty((len(x), len(books)), dtype=np.uint8), 0
            for p, y in enumerate(_parts(x, len(books))):
                codes[:, p], d = nearest(y, books[p])
                far = far + d.astype(object) if d.dtype == object else far + d
            error = far.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array([e if e <= LONG else None for e in error], pa.int64())], names=["vec_id", "label", "code", "error"])

    kind = table.schema["label"].dataType.simpleString()
    return same.select("vec_id", "label", "vector").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def compress(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and the digest of the codebooks, one row for each kept vector."""
    vectors = kept(table, id_col, vector_col, label_col)
    width, books = fit(vectors)
    if not width:
        return vectors.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = stash(encode(vectors, width, books), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = coded.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.when(F.count("error") == F.count(F.lit(1)), total).alias("total"))
    sums = sums.select("label", "rows", F.expr("try_cast(total AS LONG)").alias("label_error"))
    out = frequent_join(coded, sums, ["label"], "rows", LABELS)
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of all embeddings."""
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _assign(turn: int, of: str = "parts") -> str:
    near = "list_sum(list_transform(list_zip(v.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    return f"""near{turn} AS MATERIALIZED (SELECT r, p, x, arg_min(e, (far, e)) AS e, min(far) AS far FROM
    (SELECT v.r, v.p, v.x, b.e, {near} AS far FROM {of} v JOIN book{turn} b USING (p)) GROUP BY r, p, x)"""


def _means(turn: int) -> str:
    return f"""book{turn + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{turn} b LEFT JOIN
    (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM
      (SELECT p, e, i, sum(x[i]) AS s, count(*) AS n FROM near{turn}, unnest(range(1, len(x) + 1)) u(i) GROUP BY p, e, i) GROUP BY p, e) m USING (p, e))"""


OP13_SQL = f"""WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0 AND len(embedding) % {PARTS} = 0),
  parts AS MATERIALIZED (SELECT r, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM kept, range({PARTS}) t(p)),
  book0 AS (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= {ENTRIES}),
  {_assign(0)}, {_means(0)}, {_assign(1)}, {_means(1)}, {_assign(2)},
  coded AS (SELECT r, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM near2 GROUP BY r),
  said AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), said"""
