"""Exact matching of hashes of all documents in two moves: chunk to bucket and back.

Documents are dealt to chunks of a few MB by a hash of their id. A chunk's
different hashes, sorted, are cut into buckets by value, and a bucket gets one
compact row from every chunk: however often a hash stands in a chunk, it counts
once, so that no bucket grows with a hot key. Buckets without a hash of a chunk
get no row from it: rows are chunks times buckets while that is less than the
hashes, and a row a hash beyond that, never more. A bucket answers each chunk with
one bit for each of its hashes, in the chunk's order. The chunk, worked out anew
from the same shuffled texts, knows its hashes in that order and reads the bits.

The shuffle of the texts is one and the same for all uses in a plan, and Spark
runs it once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_long

CHUNK_BYTES = 8 << 20
ANSWERS = "chunk int, turn int, bucket int, bits binary"


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """``docs`` as (chunk, id, text), dealt by chunk, and the number of chunks."""
    docs = with_long(docs, "doc_id")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // chunk_bytes))
    rows = docs.select(
        F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("chunk"),
        F.col("doc_id").alias("id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return by_number(rows, "chunk", n), n


def by_number(rows: DataFrame, column: str, n: int) -> DataFrame:
    """``rows`` dealt by a column of ``n`` numbers, to as many tasks."""
    return rows.repartition(max(n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), column)


def buckets_of(sorted_hashes: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that have hashes, and where each one's begin, and the end: as many as there are hashes at most."""
    # The bucket of a hash is its upper half times their number, by 2**32.
    bucket = (sorted_hashes >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)
    first = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] + np.uint64(1)))
    return bucket[first].astype(np.int64), np.append(first, len(sorted_hashes))


def to_buckets(chunk: int, turn: int, hashes: np.ndarray, n_buckets: int, width: int, **values: np.ndarray) -> pa.Table:
    """A row a bucket: the low ``width`` bytes of its hashes, and their values as bytes."""
    some, edges = buckets_of(hashes, n_buckets)
    ranges = list(zip(edges, edges[1:], strict=False))
    low = hashes.view(np.uint8).reshape(-1, 8)[:, :width]
    parts = {"keys": [low[a:b].tobytes() for a, b in ranges]}
    for name, v in values.items():
        parts[name] = [v[a:b].tobytes() for a, b in ranges]
    return pa.table(
        {"chunk": np.full(len(some), chunk, np.int32), "turn": np.full(len(some), turn, np.int32), "bucket": some.astype(np.int32)}
        | {k: pa.array(v, pa.binary()) for k, v in parts.items()}
    )


def read_keys(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All rows' hashes, and where each row's begin."""
    blobs = column.to_pylist()
    sizes = np.array([len(b) // width for b in blobs], np.int64)
    out = np.zeros((int(sizes.sum()), 8), np.uint8)
    out[:, :width] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, width)
    return out.view(np.uint64).ravel(), np.concatenate([[0], np.cumsum(sizes)])


def read_values(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def groups_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts ``keys``, and where each new key begins in it."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    return order, np.flatnonzero(new)


def answer(table: pa.Table, edges: np.ndarray, bits: np.ndarray) -> pa.Table:
    """One row of bits for every row of ``table`` that has a bit set."""
    blobs = [np.packbits(bits[a:b]).tobytes() if bits[a:b].any() else None for a, b in zip(edges, edges[1:], strict=False)]
    out = pa.table(
        {"chunk": table.column("chunk"), "turn": table.column("turn"), "bucket": table.column("bucket"), "bits": pa.array(blobs, pa.binary())}
    )
    return out.filter(pa.compute.is_valid(out.column("bits")))


def answers_of(answers: pa.Table, turn: int, hashes: np.ndarray, n_buckets: int):
    """(begin, end, bits) of what buckets answered about stretches of a chunk's sorted hashes."""
    some, edges = buckets_of(hashes, n_buckets)
    for t, b, bits in zip(*(answers.column(c).to_pylist() for c in ("turn", "bucket", "bits")), strict=True):
        if t == turn:
            k = int(np.searchsorted(some, b))
            yield int(edges[k]), int(edges[k + 1]), np.frombuffer(bits, np.uint8)


def read_answer(answers: pa.Table, turn: int, hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """For each of a chunk's sorted hashes, the bit that its bucket answered."""
    out = np.zeros(len(hashes), bool)
    for a, b, bits in answers_of(answers, turn, hashes, n_buckets):
        out[a:b] = np.unpackbits(bits, count=b - a)
    return out
