"""Byte-level dedup by a distributed sparse suffix array.

Every string of ``length`` bytes has an anchor: the leftmost least hash among its
K-byte grams. Equal strings have equal anchors at the same place, so that only
anchors whose gram stands more than once can be in a repeat. Their suffixes (and
the bytes before them, read backwards) are gathered by gram and sorted by
deep-shallow sorting; classes of equal strings around the anchor follow from the
common prefixes of neighbours in the two orders, for each place of the string
about the anchor. All but the first of a class, by document id and start, go.

A gram that stands more than ``hot`` times is not gathered: the strings around
its anchors are matched one by one, by 128-bit hashes, each once a chunk, so that
no task gets all of them.

Texts move once, and gathered are only suffixes of ``length`` bytes whose
surroundings differ, byte by byte, within a chunk (see ``chunks``).

Defined results: null and empty texts have no bytes; texts shorter than
``length`` keep all; matches never cross documents; rows with the same id are
one document's, and strings at the same start of it are none before the other;
ids are of any integer type and returned as long, others are refused with a
TypeError; a null id counts as smaller than all others; a ``length`` beyond 24 to
255 is refused with a ValueError. Extra columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import answer, answers_of, by_number, chunked, groups_of, read_answer, read_keys, read_values, to_buckets
from .common import SECOND_SEED, mix64, rolling_hashes, span_hashes, text_bytes
from .suffixes import class_depths

K = 24
#: Bytes of text in one chunk: a task holds some 40 times as much.
CHUNK_BYTES = 4 << 20
#: Places of one gram that are still gathered.
HOT = 100_000
_NO_ID = np.iinfo(np.int64).min
_A = 0x9E3779B97F4A7C15


def gram_values(data: np.ndarray) -> np.ndarray:
    """Hashes of all K = 24 bytes, at each byte at which so many begin."""
    h = data.astype(np.uint64) + np.uint64(1)
    by_size = {1: h}
    size = 1
    while size < 16:
        h = h[:-size] * np.uint64(pow(_A, size, 1 << 64)) + h[size:]
        size *= 2
        by_size[size] = h
    n = len(data) - K + 1
    return mix64(by_size[16][:n] * np.uint64(pow(_A, 8, 1 << 64)) + by_size[8][16 : 16 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Places and gram hashes of the anchors of all strings of ``length`` bytes within rows."""
    width = length - K + 1
    starts = np.zeros(len(data) + 1, np.int32)
    np.add.at(starts, offsets[:-1], 1)
    np.add.at(starts, np.maximum(offsets[1:] - length + 1, offsets[:-1]), -1)
    inside = np.cumsum(starts, dtype=np.int32)[:-1] > 0  # a string of a row can begin here
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for low in range(0, len(data), step):
        here = inside[low : low + step]
        if not here.any():
            continue
        h = gram_values(data[low : low + step + length - 1])
        least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        done = 1
        while done < width:
            more = min(done, width - done)
            least = np.minimum(least[: len(least) - more], least[more:])
            done += more
        at = (least[: len(here)][here[: len(least)]] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at = at[np.append(True, at[1:] != at[:-1])]
        places.append(low + at)
        hashes.append(mix64(h[at]))  # least hashes are small: scrambled, they fall evenly into buckets
    places, hashes = np.concatenate(places), np.concatenate(hashes)
    new = np.ones(len(places), bool)
    new[1:] = places[1:] != places[:-1]
    return places[new], hashes[new]


class _Chunk:
    def __init__(self, table: pa.Table, length: int):
        self.ids = np.asarray(table.column("id").fill_null(_NO_ID), np.int64)
        self.data, self.offsets = text_bytes(table.column("text"))
        self.length, self.side = length, length - K
        self.places, self.hashes = anchors(self.data, self.offsets, length)
        order, new = groups_of(self.hashes)
        self.different = self.hashes[order][new]
        self.count = np.diff(np.append(new, len(order))).astype(np.uint32)

    def gathered(self, chosen: np.ndarray):
        """Anchors of the chosen grams, sorted by gram, the first of each surrounding first; and each one's first."""
        keep = chosen[np.searchsorted(self.different, self.hashes)] if len(self.hashes) else np.zeros(0, bool)
        place, gram = self.places[keep], self.hashes[keep]
        row = np.searchsorted(self.offsets, place, side="right") - 1
        left = np.minimum(place - self.offsets[row], self.side)
        right = np.minimum(self.offsets[row + 1] - place, self.length)
        around = rolling_hashes(self.data, place - left, place + right) + mix64(left * 1000 + right)
        start = place - self.offsets[row]
        while True:
            order = np.lexsort((start, self.ids[row], around, gram))
            place, gram, row, left, right, around, start = (x[order] for x in (place, gram, row, left, right, around, start))
            new = np.ones(len(place), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (around[1:] != around[:-1])
            first = np.flatnonzero(new)
            head = first[np.cumsum(new) - 1]
            alike = (left == left[head]) & (right == right[head])
            alike[alike] = self.same_bytes((place - left)[alike], (place - left)[head][alike], (left + right)[alike])
            if alike.all():
                break
            around[~alike] = mix64(around[~alike] + np.uint64(1))  # other bytes of one hash
        return {
            "place": place, "gram": gram, "id": self.ids[row], "start": start, "left": left.astype(np.uint8), "right": right.astype(np.uint8),
            "first": first, "of": np.cumsum(new) - 1,
        }

    def same_bytes(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` bytes (8 or more) from ``a`` are those from ``b``, eight at a time."""
        eight = np.ndarray((max(len(self.data) - 7, 0),), "<u8", np.ascontiguousarray(self.data), strides=(1,))
        same, open_ = np.ones(len(a), bool), np.flatnonzero(a != b)
        for at in range(0, int(size.max(initial=0)), 8):
            open_ = open_[at < size[open_]]
            low = np.minimum(at, size[open_] - 8)
            fits = eight[a[open_] + low] == eight[b[open_] + low]
            same[open_[~fits]] = False
            open_ = open_[fits]
        return same

    def bytes_around(self, place, left, right) -> np.ndarray:
        """A row an anchor: ``side`` bytes before it read backwards, then ``length`` from it; zeros beyond the text."""
        out = np.zeros((len(place), self.side + self.length), np.uint8)
        for low in range(0, len(place), 1 << 12):
            p, le, ri = (x[low : low + (1 << 12), None].astype(np.int64) for x in (place, left, right))
            back, on = np.arange(self.side)[None], np.arange(self.length)[None]
            part = out[low : low + (1 << 12)]
            part[:, : self.side] = np.where(back < le, self.data[np.maximum(p - 1 - back, 0)], 0)
            part[:, self.side :] = np.where(on < ri, self.data[np.minimum(p + on, len(self.data) - 1)], 0)
        return out


def _first_turn(n_buckets: int, length: int):
    def run(key, table):
        chunk = _Chunk(table, length)
        return to_buckets(key[0].as_py(), 1, chunk.different, n_buckets, 5, count=chunk.count)

    return run


def _meet_grams(hot: int):
    def run(table: pa.Table) -> pa.Table:
        keys, edges = read_keys(table.column("keys"), 5)
        count = read_values(table.column("count"), np.uint32).astype(np.int64)
        order, new = groups_of(keys)
        total = np.empty(len(keys), np.int64)
        total[order] = np.repeat(np.add.reduceat(count[order], new), np.diff(np.append(new, len(keys))))
        often = table.set_column(1, "turn", pa.array(np.full(table.num_rows, 3, np.int32)))
        return pa.concat_tables([answer(table, edges, (total > 1) & (total <= hot)), answer(often, edges, total > hot)])

    return run


def _strings(chunk: _Chunk, x: dict) -> dict:
    """All strings around the first anchors of ``x``: anchor, o, hash (both halves), id and start, with the different hashes' order."""
    f, length, side = x["first"], chunk.length, chunk.side
    o = np.arange(side + 1)[None]
    i, o = np.nonzero((o <= x["left"][f, None]) & (length - o <= x["right"][f, None]))
    begin = x["place"][f][i] - o
    by_place = np.argsort(begin, kind="stable")
    i, o, begin = i[by_place], o[by_place], begin[by_place]
    h, check = (span_hashes(chunk.data, begin, begin + length, seed) for seed in (0, SECOND_SEED))
    ids, start = x["id"][f][i], x["start"][f][i] - o
    order, new = _classes(h, check, ids, start)
    return {"anchor": i, "o": o, "hash": h[order][new], "check": check[order][new], "id": ids, "start": start, "order": order, "new": new}


def _classes(h: np.ndarray, check: np.ndarray, ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by hash, the earliest of each first, and where each new hash begins in it."""
    order = np.lexsort((start, ids, check, h))
    h, check = h[order], check[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
    return order, np.flatnonzero(new)


def _second_turn(n_buckets: int, length: int):
    def run(key, table, answers):
        number = key[0].as_py()
        chunk = _Chunk(table, length)
        x = chunk.gathered(read_answer(answers, 1, chunk.different, n_buckets))
        f = x["first"]
        around = chunk.bytes_around(x["place"][f], x["left"][f], x["right"][f])
        gathered = to_buckets(
            number, 2, x["gram"][f], n_buckets, 8, id=x["id"][f], start=x["start"][f], left=x["left"][f], right=x["right"][f], around=around
        )
        s = _strings(chunk, chunk.gathered(read_answer(answers, 3, chunk.different, n_buckets)))
        least = s["order"][s["new"]]
        none = np.zeros((len(least), 0), np.uint8)
        alone = to_buckets(
            number, 4, s["hash"], n_buckets, 8, id=s["id"][least], start=s["start"][least], left=none, right=none, around=s["check"]
        )
        return pa.concat_tables([gathered, alone])

    return run


def repeats(gram: np.ndarray, ids: np.ndarray, starts: np.ndarray, left: np.ndarray, right: np.ndarray, around: np.ndarray, length: int):
    """For each anchor and each o: whether the string that begins o bytes before the anchor also begins earlier."""
    n, side = len(gram), length - K
    by_time = np.lexsort((starts, ids))
    time = np.empty(n, np.int64)
    same = (ids[by_time][1:] == ids[by_time][:-1]) & (starts[by_time][1:] == starts[by_time][:-1])
    time[by_time] = np.cumsum(np.append(True, ~same)) - 1
    out = np.zeros((n, side + 1), bool)
    # Equal surroundings are sorted once, as the first of them.
    whole = np.concatenate([around, left[:, None], right[:, None]], 1)
    _, first, of = np.unique(np.ascontiguousarray(whole).view([("", np.void, whole.shape[1])]).ravel(), return_index=True, return_inverse=True)
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, of, time)
    later = time > least[of]
    o = np.arange(side + 1)
    fits = (o[None] <= left[:, None]) & (length - o[None] <= right[:, None])
    out[later] = fits[later]
    left, right, around = left[first], right[first], around[first]
    # Within one gram only: the gram is the suffix's beginning, so that orders keep them together.
    after, after_common = class_depths(around[:, side:])
    before, before_common = class_depths(around[:, :side])
    repeated = np.zeros((len(first), side + 1), bool)
    for o in range(side + 1):
        able = np.flatnonzero((left >= o) & (right >= length - o))
        if len(able) < 2:
            continue
        a = np.cumsum(after_common < length - o)[after[able]]
        b = np.cumsum(before_common < o)[before[able]] if o else 0
        key = a * (len(first) + 1) + b
        order, new = groups_of(key)
        size = np.diff(np.append(new, len(order)))
        if size.max() > 1:
            earliest = np.minimum.reduceat(least[able][order], new)
            repeated[able[order], o] = least[able][order] > np.repeat(earliest, size)
    rest = ~later
    out[rest] = repeated[of[rest]]
    return out


def _meet_suffixes(length: int):
    side = length - K

    def values(table):
        keys, edges = read_keys(table.column("keys"), 8)
        return keys, edges, read_values(table.column("id"), np.int64), read_values(table.column("start"), np.int64)

    def gathered(table: pa.Table) -> pa.Table:
        keys, edges, ids, start = values(table)
        left, right = (read_values(table.column(c), np.uint8) for c in ("left", "right"))
        around = read_values(table.column("around"), np.uint8).reshape(len(keys), side + length)
        found = np.packbits(repeats(keys, ids, start, left, right, around, length), axis=1)
        blobs = [found[a:b].tobytes() if found[a:b].any() else None for a, b in zip(edges, edges[1:], strict=False)]
        out = pa.table({c: table.column(c) for c in ("chunk", "turn", "bucket")} | {"bits": pa.array(blobs, pa.binary())})
        return out.filter(pa.compute.is_valid(out.column("bits")))

    def alone(table: pa.Table) -> pa.Table:
        keys, edges, ids, start = values(table)
        order, new = _classes(keys, read_values(table.column("around"), np.uint64), ids, start)
        first = np.repeat(order[new], np.diff(np.append(new, len(keys))))
        bits = np.empty(len(keys), bool)
        bits[order] = (ids[order] > ids[first]) | (start[order] > start[first])
        return answer(table, edges, bits)

    def run(table: pa.Table) -> pa.Table:
        parts = [(pa.compute.equal(table.column("turn"), t), f) for t, f in ((2, gathered), (4, alone))]
        return pa.concat_tables([f(rows) for mask, f in parts if (rows := table.filter(mask)).num_rows])

    return run


def _remove(n_buckets: int, length: int):
    side = length - K

    def run(key, table, answers):
        chunk = _Chunk(table, length)
        cover = np.zeros(len(chunk.data) + 1, np.int32)

        def removed(x, found):
            """Cover what the anchors ``x`` remove; ``found``: of the first of each surrounding, by o."""
            head = x["first"][x["of"]]
            later = (x["id"] > x["id"][head]) | (x["start"] > x["start"][head])
            # All strings around a later one: from its first byte to the end of the last string.
            last = np.maximum(length - x["right"].astype(np.int64), 0)
            whole = np.flatnonzero(later & (x["left"] >= last))
            np.add.at(cover, x["place"][whole] - x["left"][whole], 1)
            np.add.at(cover, x["place"][whole] - last[whole] + length, -1)
            rest = np.flatnonzero(~later & found.any(1)[x["of"]])
            for low in range(0, len(rest), 1 << 13):
                part = rest[low : low + (1 << 13)]
                i, o = np.nonzero(found[x["of"][part]])
                begin = x["place"][part][i] - o
                np.add.at(cover, begin, 1)
                np.add.at(cover, begin + length, -1)

        x = chunk.gathered(read_answer(answers, 1, chunk.different, n_buckets))
        found = np.zeros((len(x["first"]), side + 1), bool)
        for a, b, bits in answers_of(answers, 2, x["gram"][x["first"]], n_buckets):
            found[a:b] = np.unpackbits(bits.reshape(b - a, -1), axis=1, count=side + 1)
        removed(x, found)
        x = chunk.gathered(read_answer(answers, 3, chunk.different, n_buckets))
        s = _strings(chunk, x)
        size = np.diff(np.append(s["new"], len(s["order"])))
        first = np.repeat(s["order"][s["new"]], size)
        later = np.repeat(read_answer(answers, 4, s["hash"], n_buckets), size)
        later |= (s["id"][s["order"]] > s["id"][first]) | (s["start"][s["order"]] > s["start"][first])
        found = np.zeros((len(x["first"]), side + 1), bool)
        found[s["anchor"][s["order"]], s["o"][s["order"]]] = later
        removed(x, found)
        gone = np.cumsum(cover, dtype=np.int32)[:-1] > 0
        n, data, offsets = len(chunk.ids), chunk.data, chunk.offsets
        row_edge = np.zeros(len(data) + 1, bool)
        row_edge[offsets] = True
        begins, ends = gone.copy(), gone.copy()
        begins[1:] &= ~gone[:-1] | row_edge[1:-1]
        ends[:-1] &= ~gone[1:] | row_edge[1:-1]
        s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        row = np.searchsorted(offsets, s, side="right") - 1
        runs = pa.StructArray.from_arrays([pa.array(s - offsets[row]), pa.array(e - offsets[row])], ["start", "end"])
        kept_before = np.concatenate([[0], np.cumsum(~gone)])[offsets]
        kept = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(kept_before.astype(np.int64)), pa.py_buffer(data[~gone])])
        size = np.diff(offsets).astype(np.int64)
        return pa.table(
            {
                "doc_id": table.column("id"),
                "n_bytes": size,
                "n_removed": size - np.diff(kept_before),
                "spans": pa.ListArray.from_arrays(np.searchsorted(row, np.arange(n + 1)).astype(np.int32), runs),
                "kept": kept.cast(pa.binary()),
            }
        )

    return run


def dedup(docs: DataFrame, length: int = 100, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept): the bytes left of every document, and the removed runs."""
    if not K <= length <= 255:
        raise ValueError(f"length is {length}: strings of {K} to 255 bytes can be found")
    texts, n = chunked(docs, CHUNK_BYTES)
    by_chunk = texts.groupBy("chunk")
    row, back = "chunk int, turn int, bucket int, keys binary", "chunk int, turn int, bucket int, bits binary"
    first = by_chunk.applyInArrow(_first_turn(n, length), f"{row}, count binary")
    first = by_number(first, "bucket", n).groupBy("bucket").applyInArrow(_meet_grams(hot), back)
    second = by_chunk.cogroup(first.groupBy("chunk")).applyInArrow(
        _second_turn(n, length), f"{row}, id binary, start binary, left binary, right binary, around binary"
    )
    second = by_number(second, "bucket", n).groupBy("bucket").applyInArrow(_meet_suffixes(length), back)
    out = "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"
    return by_chunk.cogroup(first.union(second).groupBy("chunk")).applyInArrow(_remove(n, length), out)
