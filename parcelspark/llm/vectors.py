"""Columns of vectors as matrices of whole numbers, and what is known of all of them.

Used by the operators that compute with integers made of embeddings: each entry c
of a vector becomes floor(scale * c) + shift.

A vector counts as usable if it is not null and has neither null nor non-finite
entries. Matrices need one length: that of most usable vectors, the smallest of
those that are equally frequent. Vectors of other lengths are no rows of that
matrix and are left out, as are empty ones. Entries so large that results would
not fit their types end the job with a ValueError rather than give wrong numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, with_long

#: Rows that are worked on at once.
BLOCK = 8192


@dataclass(frozen=True)
class Extent:
    """Of all usable vectors: their number and length, and each entry's exact sum, least and largest value as an integer."""

    n: int
    size: int
    sums: tuple[int, ...]
    low: tuple[int, ...]
    high: tuple[int, ...]


def lists(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of a column of lists as doubles (null: NaN), the n + 1 offsets of its rows, and which rows are null."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    offsets = np.asarray(column.offsets, np.int64)
    flat = column.values.slice(offsets[0], offsets[-1] - offsets[0]).cast(pa.float64())
    return np.asarray(flat.fill_null(np.nan)), offsets - offsets[0], np.asarray(column.is_null())


def usable_rows(column, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of length ``size``, and the vectors as a matrix."""
    flat, offsets, null = lists(column)
    at = np.flatnonzero((np.diff(offsets) == size) & ~null)
    x = flat[offsets[at][:, None] + np.arange(size)]
    fine = np.isfinite(x).all(1)
    return at[fine], x[fine]


def whole_numbers(x: np.ndarray, scale: int, shift: int) -> np.ndarray:
    return np.floor(scale * x).astype(np.int64) + shift


def _partial_sums(scale: int, shift: int):
    """A row for each length and entry that a task has seen; sums come in two halves, so that they stay exact."""

    def run(batches):
        seen: dict[int, list] = {}
        for b in batches:
            _, offsets, null = lists(b.column(0))
            for size in np.unique(np.diff(offsets)[~null]).tolist():
                if not size:
                    continue
                _, x = usable_rows(b.column(0), size)
                if not len(x):
                    continue
                with np.errstate(invalid="ignore"):  # too large ones are refused by their extremes
                    whole = whole_numbers(x, scale, shift)
                now = [len(x), (whole >> 32).sum(0), (whole & 0xFFFFFFFF).sum(0), x.min(0), x.max(0)]
                old = seen.get(size)
                if old:
                    now = [old[0] + now[0], old[1] + now[1], old[2] + now[2], np.minimum(old[3], now[3]), np.maximum(old[4], now[4])]
                seen[size] = now
        for size, (n, upper, lower, low, high) in seen.items():
            yield pa.RecordBatch.from_pydict(
                {
                    "size": np.full(size, size, np.int32),
                    "entry": np.arange(size, dtype=np.int32),
                    "n": np.full(size, n, np.int64),
                    "upper": upper,
                    "lower": lower,
                    "low": low,
                    "high": high,
                }
            )

    return run


def extent(rows: DataFrame, scale: int, shift: int, bits) -> Extent | None:
    """What is known of all usable vectors of ``rows``, None if there are none.

    Integers of ``bits(length)`` bits and more are refused. The driver gets a row for
    each entry of a vector.
    """
    parts = rows.select("embedding").mapInArrow(
        _partial_sums(scale, shift), "size int, entry int, n long, upper long, lower long, low double, high double"
    )
    parts = stage(parts, "vector-sums")
    top = parts.where("entry = 0").groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "size").first()
    if top is None:
        return None
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    each = parts.where(F.col("size") == top.size).groupBy("entry").agg(whole("upper"), whole("lower"), F.min("low").alias("low"), F.max("high").alias("high"))
    each = each.orderBy("entry").collect()
    widest = max(max(abs(r.low), abs(r.high)) for r in each)
    if widest * scale + abs(shift) >= 2.0 ** bits(top.size):
        raise ValueError(f"an entry of {widest:g} gives an integer of {bits(top.size)} bits or more")
    at = lambda c: int(np.floor(scale * c)) + shift
    return Extent(
        top.n,
        top.size,
        tuple((int(r.upper) << 32) + int(r.lower) for r in each),
        tuple(at(r.low) for r in each),
        tuple(at(r.high) for r in each),
    )


def embeddings_with(rows: DataFrame, *extra: str) -> DataFrame:
    """(vec_id, *extra, embedding) of ``rows``, ids as long."""
    return with_long(rows, "vec_id").select("vec_id", *extra, F.col("embedding").cast("array<double>").alias("embedding"))
