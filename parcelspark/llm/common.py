"""Helpers shared by the text operators: staging, byte buffers, hashes, graphs."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graphs import SALTS, connected_components, join_groups, salt, salts_of
from ..sources.shared import staged as stage

__all__ = ["SALTS", "connected_components", "join_groups", "salt", "salts_of", "stage"]

#: 64-bit odd constants of the splitmix and murmur finishers (fixed values).
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Odd base of the byte polynomial, modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 1
#: Seed of the second half of 128-bit hashes.
SECOND_SEED = 0xC2B2AE3D27D4EB4F

WORD_GAP = r"[\x20\x09-\x0D]+"


def with_long(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the id ``column`` as long; ids of other than integer types are refused."""
    kind = df.schema[column].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{column} is {kind.simpleString()}: ids are integers here")
    return df.withColumn(column, F.col(column).cast("long"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers, bijectively."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and its n + 1 row offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blobs(column, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Values of a binary column's rows, one after the other, and its n + 1 row offsets in values."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    column = column.cast(pa.large_binary())
    n, (_, offsets, data) = len(column), column.buffers()
    if not n or data is None:
        return np.zeros(0, dtype), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return flat.view(dtype) if flat.ctypes.data % np.dtype(dtype).itemsize == 0 else flat.copy().view(dtype), (offsets - offsets[0]) // np.dtype(dtype).itemsize


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words_of(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _SPACE):
    """Starts, ends and row of every word: maximal runs without gap bytes in a row.

    A row boundary ends a word even where no gap byte stands.
    """
    inside = ~gap[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


#: Bytes of a span that are scrambled eight at a time; longer spans are digested whole.
_SCRAMBLED = 512
#: Masks of the first 0 to 8 bytes of a little-endian word.
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans: equal bytes give equal hashes wherever they stand; another ``seed`` gives unrelated ones.

    Every eight bytes are followed by a scrambling of all bits, so that no pattern of
    bytes collides more often than others; spans of more than 512 bytes are digested
    by BLAKE2b.
    """
    size = ends - starts
    out = mix64(np.uint64(seed) ^ size.astype(np.uint64) * _M1)
    for i in np.flatnonzero(size > _SCRAMBLED).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little"))
        out[i] = int.from_bytes(digest.digest(), "little")
    eight = np.ndarray((len(data) + 1,), "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))
    # A block of spans at a time, so that the work stays in cache.
    for first in range(0, len(starts), 1 << 15):
        live = first + np.flatnonzero(size[first : first + (1 << 15)] <= _SCRAMBLED)
        live, at = live[size[live] > 0], 0
        while len(live):
            word = eight[starts[live] + at] & _FIRST_BYTES[np.minimum(size[live] - at, 8)]
            out[live] = mix64(out[live] ^ word)
            at += 8
            live = live[size[live] > at]
    return out


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def rolling_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans that overlap much, at a cost that their overlaps do not add to.

    A polynomial modulo 2**64, which some patterns defeat: for sorting before bytes
    are compared, never instead of that.
    """
    inverse = np.uint64(pow(_BASE, -1, 1 << 64))
    if not len(starts):
        return np.zeros(0, np.uint64)
    out = np.empty(len(starts), np.uint64)
    step, first = 1 << 18, 0
    while first < len(starts):
        # Spans in one block of bytes at a time, so that the work stays in cache.
        last = max(int(np.searchsorted(starts, starts[first] + step)), first + 1)
        low, high = int(starts[first]), int(ends[first:last].max())
        part = data[low:high].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _powers(len(part)), out=sums[1:])
        s, e = starts[first:last] - low, ends[first:last] - low
        back = np.full(len(part) + 1, inverse, np.uint64)
        back[0] = 1
        out[first:last] = (sums[e] - sums[s]) * np.multiply.accumulate(back)[s]
        first = last
    return mix64(out ^ (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words, at each word at which k of them begin."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        # The shift keeps the sum from being a polynomial, in which arrangements of few words cancel out.
        total ^= total >> np.uint64(32)
        total *= np.uint64(0xD6E8FEB86659FD93)
        total += words[i : i + n]
    return mix64(total)


def slices(n_bytes: np.ndarray, limit: int):
    """Row ranges of at most ``limit`` bytes, or of one longer row."""
    offsets = np.concatenate([[0], np.cumsum(n_bytes)])
    row = 0
    while row < len(n_bytes):
        end = max(int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1, row + 1)
        yield row, end
        row = end


def text_slices(batches, limit: int = 2 << 20):
    """Arrow batches (id, text) in parts of bounded text: (ids, bytes, offsets)."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for a, b in slices(np.diff(offsets), limit):
            yield batch.column(0).slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


#: Rows of one bucket of a running total, at most, and buckets of a small table.
BUCKET_ROWS, BUCKETS = 5_000, 512


def buckets_for(n: int) -> int:
    """Number of buckets for ``n`` rows: of BUCKET_ROWS at most, and of fewer where that gives less than BUCKETS."""
    return max(1, -(-n // BUCKET_ROWS), min(BUCKETS, -(-n // 64)))


def running_total(df: DataFrame, key: str, bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Add the sum of ``value`` over the rows before, in each key (not null), as ``out``.

    A key of any size is dealt over its buckets: rows are ordered by bucket and
    then ``order``; only one total a bucket meets in a window by key.
    """
    from pyspark.sql import Window as W

    totals = df.groupBy(key, bucket).agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(key).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(
        F.col(key).alias("_of_key"), F.col(bucket).alias("_of_bucket"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start")
    )
    inner = W.partitionBy(key, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        df.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .join(totals, (F.col(key) == F.col("_of_key")) & (F.col(bucket) == F.col("_of_bucket")))
        .withColumn(out, (F.col("_start") + F.col("_inner")).cast("long"))
        .drop("_of_key", "_of_bucket", "_start", "_inner")
    )


def added_up(parts: DataFrame, add, by: list[str], schema: str, fan: int, levels: int, last=None) -> DataFrame:
    """``parts`` of all tasks, added up by the columns ``by``: ``add(table)`` of rows with equal ones gives their sum, a row.

    Tasks are added up in groups of ``fan`` neighbours, these again, and so on: no
    task reads more than ``fan`` rows, but the last, for ``fan`` to the power of
    ``levels`` and one tasks.
    ``last(columns)``, if given, is made of each sum in the task that has it: a step
    of its own would be a Python worker more for every task.
    """
    names = ", ".join(f"{c} {parts.schema[c].dataType.simpleString()}" for c in by)
    whole = f"{names}, task int, {schema}" if by else f"task int, {schema}"

    def run(table):
        keys = {c: table.column(c).slice(0, 1) for c in [*by, "task"]}
        return pa.table(keys | add(table))

    parts = parts.withColumn("task", F.spark_partition_id())
    for _ in range(levels):
        parts = parts.withColumn("task", F.expr(f"int(task div {fan})"))
        parts = parts.groupBy(*by, "task").applyInArrow(run, whole)

    def end(table):
        total = run(table)
        return pa.table({c: total.column(c) for c in [*by, "task"]} | last(total)) if last else total

    return parts.withColumn("task", F.lit(0)).groupBy(*by, "task").applyInArrow(end, whole).drop("task")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
