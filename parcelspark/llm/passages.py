"""Substring dedup over words, by fixed-block anchors.

The words of every document are cut into non-overlapping reference blocks, so
short that each window of ``window`` words holds a whole one. Every rolling
window of a block's length probes the index of reference blocks; a block's hash
is a hit if it is a reference block somewhere and stands in two documents. Only
windows that hold a hit can repeat. They are extended to the full window: the
least document of every such window is found, and a word goes if a window that
covers it also starts in a document with a smaller id. Runs of such windows are
the maximal exact repeats.

Both look-ups move compact rows between chunks and buckets (see ``chunks``).
Blocks are matched by 40 bits and the bucket; that can only add candidates.
Windows are equal if 128-bit hashes of their words, in order, are: two halves with
different seeds, in which all bits are scrambled after every eight bytes, so that
texts can't be arranged to collide as they can under polynomials.

Defined results: null and empty texts have no words; a document of fewer words
than a window keeps all; rows with the same id are one document's, none smaller
than the other; ids are of any integer type and returned as long, others are
refused with a TypeError; a null id counts as smaller than all others. Extra
columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import ANSWERS, answer, by_number, chunked, groups_of, read_answer, read_keys, read_values, to_buckets
from .common import SECOND_SEED, gram_hashes, span_hashes, text_bytes, words_of

_NO_ID = np.iinfo(np.int64).min


class _Words:
    """The words of a chunk's documents and their hashes."""

    def __init__(self, table: pa.Table, window: int):
        self.ids = np.asarray(table.column("id").fill_null(_NO_ID), np.int64)
        self.data, offsets = text_bytes(table.column("text"))
        self.starts, self.ends, self.of = words_of(self.data, offsets)
        self.first = np.searchsorted(self.of, np.arange(len(self.ids) + 1))
        self.hashes = span_hashes(self.data, self.starts, self.ends)
        self.window, self.block = window, (window + 1) // 2

    def grams(self, k: int):
        """Hashes of k words, and whether each is within a document that has a window."""
        h = gram_hashes(self.hashes, k)
        whole = self.of[: len(h)] == self.of[k - 1 :] if len(h) else np.zeros(0, bool)
        long = np.diff(self.first) >= self.window
        return h, whole & long[self.of[: len(h)]]

    def blocks(self):
        """Sorted different block hashes, their flags (1: a reference block, 2: in two documents), and the place of each word's."""
        h, whole = self.grams(self.block)
        at = np.flatnonzero(whole)
        order, new = groups_of(h[at])
        if not len(at):
            return h[at], np.zeros(0, np.uint8), at, at
        place = np.empty(len(at), np.int64)
        place[order] = np.cumsum(np.isin(np.arange(len(at)), new, assume_unique=True)) - 1
        reference = (at - self.first[self.of[at]]) % self.block == 0
        doc = self.of[at][order]
        flags = np.maximum.reduceat(reference[order].astype(np.uint8), new)
        two = np.maximum.reduceat(doc, new) != np.minimum.reduceat(doc, new)
        return h[at][order][new], flags | (two.astype(np.uint8) << 1), at, place

    def windows(self, hit_words: np.ndarray):
        """(start, hash, second hash) of the windows that hold a hit block."""
        h, whole = self.grams(self.window)
        if not len(h):
            return np.zeros(0, np.int64), h, h
        hits = np.zeros(len(self.of) + 1, np.int64)
        hits[1 + hit_words] = 1
        hits = np.cumsum(hits)
        inside = self.window - self.block + 1
        start = np.flatnonzero(whole & (hits[np.arange(len(h)) + inside] > hits[: len(h)]))
        # The second halves need the words of these windows alone.
        edge = np.zeros(len(self.of) + 1, np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + self.window, -1)
        some = np.cumsum(edge)[:-1] > 0
        second = np.zeros(len(self.of), np.uint64)
        second[some] = span_hashes(self.data, self.starts[some], self.ends[some], SECOND_SEED)
        return start, h[start], gram_hashes(second, self.window)[start]


def _first_turn(n_buckets: int, window: int):
    def run(key, table):
        words = _Words(table, window)
        h, flags, _, _ = words.blocks()
        return to_buckets(key[0].as_py(), 1, h, n_buckets, 5, flags=flags)

    return run


def _meet_blocks(table: pa.Table) -> pa.Table:
    keys, edges = read_keys(table.column("keys"), 5)
    flags = read_values(table.column("flags"), np.uint8)
    order, new = groups_of(keys)
    count = np.diff(np.append(new, len(keys)))
    either = np.bitwise_or.reduceat(flags[order], new)
    hit = ((either & 1) == 1) & ((count > 1) | (either >= 2))
    bits = np.empty(len(keys), bool)
    bits[order] = np.repeat(hit, count)
    return answer(table, edges, bits)


def _pairs_of(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts (key, check), and where each new pair begins in it."""
    order = np.lexsort((checks, keys))
    k, c = keys[order], checks[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    return order, np.flatnonzero(new)


def _candidates(words: _Words, answers: pa.Table, n_buckets: int):
    """Starts of the candidate windows, their sorted different hashes (both halves), each one's place there, its id, and the least id of each."""
    h, _, at, place = words.blocks()
    hit = read_answer(answers, 1, h, n_buckets)
    start, wide, check = words.windows(at[hit[place]])
    order, new = _pairs_of(wide, check)
    place = np.empty(len(wide), np.int64)
    place[order] = np.cumsum(np.isin(np.arange(len(wide)), new, assume_unique=True)) - 1
    ids = words.ids[words.of[start]]
    least = np.minimum.reduceat(ids[order], new) if len(new) else ids
    return start, wide[order][new], check[order][new], place, ids, least


def _second_turn(n_buckets: int, window: int):
    def run(key, table, answers):
        none = np.zeros(0, np.uint64)
        if not table.num_rows:
            return to_buckets(0, 2, none, n_buckets, 8, check=none, ids=np.zeros(0, np.int64))
        _, wide, check, _, _, least = _candidates(_Words(table, window), answers, n_buckets)
        return to_buckets(key[0].as_py(), 2, wide, n_buckets, 8, check=check, ids=least)

    return run


def _meet_windows(table: pa.Table) -> pa.Table:
    keys, edges = read_keys(table.column("keys"), 8)
    checks, ids = read_values(table.column("check"), np.uint64), read_values(table.column("ids"), np.int64)
    order, new = _pairs_of(keys, checks)
    least = np.minimum.reduceat(ids[order], new)
    bits = np.empty(len(keys), bool)
    bits[order] = ids[order] > np.repeat(least, np.diff(np.append(new, len(keys))))
    return answer(table, edges, bits)


def _joined(words: _Words, kept: np.ndarray) -> pa.Array:
    """Each document's kept words, joined by one space."""
    n = len(words.ids)
    starts, length = words.starts[kept], (words.ends - words.starts)[kept] + 1
    out_ends = np.cumsum(length)
    total = int(out_ends[-1]) if len(out_ends) else 0
    data = np.append(words.data, np.uint8(32))
    out = data[np.repeat(starts - (out_ends - length), length) + np.arange(total)] if total else np.zeros(0, np.uint8)
    out[out_ends - 1] = 32
    doc = np.searchsorted(words.of[kept], np.arange(n + 1))
    edges = np.concatenate([[0], out_ends])[doc]
    # Without the space after the last word of each document that keeps one.
    last = out_ends[doc[1:][np.diff(doc) > 0] - 1] - 1
    out = np.delete(out, last)
    offsets = edges - np.concatenate([[0], np.cumsum(np.diff(doc) > 0)])
    return pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)])


def _remove(n_buckets: int, window: int):
    def run(key, table, answers):
        words = _Words(table, window)
        start, wide, _, place, ids, least = _candidates(words, answers, n_buckets)
        later = read_answer(answers, 2, wide, n_buckets)
        gone = start[later[place] | (ids > least[place])] if len(start) else start
        cover = np.zeros(len(words.of) + 1, np.int64)
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + window, -1)
        removed = np.cumsum(cover)[:-1] > 0
        n = len(words.ids)
        edge = removed.copy()
        edge[1:] &= ~removed[:-1] | (words.of[1:] != words.of[:-1])
        end = removed.copy()
        end[:-1] &= ~removed[1:] | (words.of[1:] != words.of[:-1])
        s, e = np.flatnonzero(edge), np.flatnonzero(end) + 1
        base = words.first[words.of[s]]
        runs = pa.StructArray.from_arrays([pa.array((s - base).astype(np.int32)), pa.array((e - base).astype(np.int32))], ["start", "end"])
        spans = pa.ListArray.from_arrays(np.searchsorted(words.of[s], np.arange(n + 1)).astype(np.int32), runs)
        return pa.table(
            {
                "doc_id": table.column("id"),
                "n_words": np.diff(words.first).astype(np.int64),
                "n_removed": np.bincount(words.of[removed], minlength=n).astype(np.int64),
                "spans": spans,
                "text": _joined(words, ~removed).cast(pa.string()),
            }
        )

    return run


def dedup(docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, text): what is left of every document, and the removed runs of words."""
    texts, n = chunked(docs)
    row = "chunk int, turn int, bucket int, keys binary"
    by_chunk = texts.groupBy("chunk")
    first = by_chunk.applyInArrow(_first_turn(n, window), f"{row}, flags binary")
    first = by_number(first, "bucket", n).groupBy("bucket").applyInArrow(_meet_blocks, ANSWERS)
    second = by_chunk.cogroup(first.groupBy("chunk")).applyInArrow(_second_turn(n, window), f"{row}, check binary, ids binary")
    second = by_number(second, "bucket", n).groupBy("bucket").applyInArrow(_meet_windows, ANSWERS)
    answers = first.union(second)
    out = "doc_id long, n_words long, n_removed long, spans array<struct<start: int, end: int>>, text string"
    return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(_remove(n, window), out)
