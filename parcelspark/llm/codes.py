"""Vector code compression: product codes found through segment-mean lower bounds.

Entries become integers floor(4096 x), and vectors are cut in equal consecutive
parts, each with a codebook of its own. A part and an entry of a codebook are
compared by their means over blocks first: with blocks of w places,

    |a - b|^2 >= sum over blocks of w (mean a - mean b)^2 + (rest a - rest b)^2

where the rest is the norm of what the mean leaves of a block. One block a part
comes first, then two, four and so on. The first bound names a likely entry, whose
exact distance is the mark; entries whose bound is above the mark, with slack for
rounding, are dropped at each level, and the survivors get exact integer
distances. So the nearest entry, and the lower of equally near ones, is the one
that all exact distances would give.

Every round is one pass of tasks over the staged integers: a task returns sums and
counts for each entry, Spark adds them up, and the driver gets the codebooks'
size. Totals by label are joined to rows by salts, so that a label of any number
of rows is many tasks' work.

Defined results: null vectors and vectors with null or non-finite components are
dropped, and so are vectors of another length than most usable ones have (see
``vectors``); where the parts do not divide the length, part p covers the places
from p * length // parts. With fewer vectors than entries a codebook has so many
entries. Null ids come after all others; rows with one id are rows each, ordered
by their integers where the first codebooks are chosen. An empty table gives no
rows. Extra columns are dropped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, salts_of, stage
from .vectors import BLOCK, Extent, embeddings_with, extent, usable_rows, whole_numbers

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6


def _bits(size: int) -> int:
    """Integers of fewer bits have squared distances, over ``size`` places, that fit a long."""
    return (62 - size.bit_length()) // 2 - 1


def cuts(size: int, parts: int) -> list[int]:
    """Where parts begin, and the end."""
    return [p * size // parts for p in range(parts + 1)]


def _segments(x: np.ndarray, edges: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Means of each row's blocks, and norms of what they leave."""
    means = np.stack([x[:, a:b].mean(1) for a, b in zip(edges, edges[1:], strict=False)], 1)
    rest = np.stack([np.sqrt(((x[:, a:b] - means[:, [k]]) ** 2).sum(1)) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], 1)
    return means, rest


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of integers the nearest of ``entries``, the lowest of equally near ones, and its squared distance."""
    n, size = x.shape
    if not n or not size:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    fx, fe = x.astype(np.float64), entries.astype(np.float64)
    # Far above what rounding can do to a bound, far below the least step of an integer distance that matters.
    slack = 1e-9 * (1 + size * max(np.abs(fx).max(), np.abs(fe).max()) ** 2)
    i = j = mark = None
    blocks = 1
    while blocks == 1 or blocks < size:
        edges = cuts(size, blocks)
        width = np.diff(edges).astype(np.float64)
        (mx, rx), (me, re) = _segments(fx, edges), _segments(fe, edges)
        if i is None:
            bound = width[0] * (mx - me.T) ** 2 + (rx - re.T) ** 2
            likely = bound.argmin(1)
            mark = ((x - entries[likely]) ** 2).sum(1)
            i, j = np.nonzero(bound <= mark[:, None] + slack)
        else:
            bound = ((mx[i] - me[j]) ** 2 * width + (rx[i] - re[j]) ** 2).sum(1)
            able = bound <= mark[i] + slack
            i, j = i[able], j[able]
        blocks *= 2
    d = ((x[i] - entries[j]) ** 2).sum(1)
    # Pairs are in order of rows, then entries, and every row has its likely entry at least.
    first = np.flatnonzero(np.diff(i, prepend=-1))
    least = np.minimum.reduceat(d, first)
    hit = np.flatnonzero(d == least[i])
    hit = hit[np.diff(i[hit], prepend=-1) != 0]
    return j[hit], d[hit]


def _assigned(x: np.ndarray, books: list[np.ndarray], edges: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each row, a column a part, and the sums of squared distances."""
    codes, error = np.zeros((len(x), len(books)), np.int64), np.zeros(len(x), np.int64)
    for p, book in enumerate(books):
        for low in range(0, len(x), BLOCK):
            codes[low : low + BLOCK, p], d = nearest(x[low : low + BLOCK, edges[p] : edges[p + 1]], book)
            error[low : low + BLOCK] += d
    return codes, error


def _matrix(column, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), size)


def _integers(size: int):
    """Rows of usable vectors, with their integers as ``x``."""

    def run(batches):
        for b in batches:
            at, v = usable_rows(b.column(2), size)
            x = whole_numbers(v, SCALE, 0)
            offsets = np.arange(0, x.size + 1, size, dtype=np.int32)
            places = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(places), b.column(1).take(places), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["vec_id", "label", "x"]
            )

    return run


def _round(books: list[np.ndarray], edges: list[int]):
    """A task's (slot, total): sums of each place of each entry, and, after them, the numbers of parts of each."""
    size, n = edges[-1], len(books[0])

    def run(batches):
        sums, counts = np.zeros((n, size), np.int64), np.zeros((n, len(books)), np.int64)
        for b in batches:
            x = _matrix(b.column(0), size)
            codes, _ = _assigned(x, books, edges)
            for p, (a, e) in enumerate(zip(edges, edges[1:], strict=False)):
                np.add.at(sums[:, a:e], codes[:, p], x[:, a:e])
                counts[:, p] += np.bincount(codes[:, p], minlength=n)
        total = np.concatenate([sums.ravel(), counts.ravel()])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"slot": some.astype(np.int32), "total": total[some]})

    return run


def _next_books(rows: DataFrame, books: list[np.ndarray], edges: list[int]) -> list[np.ndarray]:
    """Codebooks whose used entries are the floors of their parts' means."""
    found = rows.select("x").mapInArrow(_round(books, edges), "slot int, total long").groupBy("slot").agg(F.sum("total").alias("total"))
    size, n = edges[-1], len(books[0])
    total = np.zeros(n * (size + len(books)), np.int64)
    for row in found.toLocalIterator():
        total[row.slot] = row.total
    sums, counts = total[: n * size].reshape(n, size), total[n * size :].reshape(n, len(books))
    out = []
    for p, (book, a, e) in enumerate(zip(books, edges, edges[1:], strict=False)):
        used = counts[:, p] > 0
        book = book.copy()
        book[used] = sums[used, a:e] // counts[used, p][:, None]
        out.append(book)
    return out


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all integers in order of part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


def trained(rows: DataFrame, e: Extent, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks of the staged integers ``rows`` (vec_id, x) after ``rounds`` rounds."""
    edges = cuts(e.size, parts)
    first = rows.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    start = np.array([r.x for r in first], np.int64)
    books = [start[:, a:b].copy() for a, b in zip(edges, edges[1:], strict=False)]
    for _ in range(rounds):
        books = _next_books(rows, books, edges)
    return books


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of every usable vector, as a table, and the codebooks; code: two hex digits a part.

    ``entries``: 256 at most.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has room for 256 entries")
    rows = embeddings_with(rows, "label")
    kind = rows.schema["label"].dataType.simpleString()
    e = extent(rows, SCALE, 0, _bits)
    if e is None:
        return rows.sparkSession.createDataFrame([], f"vec_id long, label {kind}, code string, error long"), []
    whole = stage(rows.mapInArrow(_integers(e.size), f"vec_id long, label {kind}, x array<long>"), "vector-integers")
    books, edges = trained(whole, e, parts, entries, rounds), cuts(e.size, parts)

    def run(batches):
        for b in batches:
            codes, error = _assigned(_matrix(b.column(2), e.size), books, edges)
            text = pa.array([c.tobytes().hex() for c in codes.astype(np.uint8)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), text, pa.array(error)], ["vec_id", "label", "code", "error"])

    return stage(whole.mapInArrow(run, f"vec_id long, label {kind}, code string, error long"), "vector-codes"), books


def compressed(rows: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable vector."""
    coded, books = compress(rows)
    # Nulls are one group; a text of the label keeps any type, NaN among them, apart from null.
    coded = coded.withColumns({"_none": F.col("label").isNull(), "_label": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    groups = coded.groupBy("_label", "_none").agg(F.sum("error").alias("label_error"), salts_of("vec_id").alias("salts"))
    return join_groups(coded, groups, ["_label", "_none"], "vec_id").select(
        "vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")
    )
