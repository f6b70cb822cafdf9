"""MinHash near-dedup by improved consistent weighted sampling over TF-IDF shingles.

A document is the bag of its shingles of five words. A shingle weighs its count
times its own inverse document frequency, 1 + ln of documents over documents with
the shingle, at most 1 + ln(RARE): all shingles in fewer than one document of
RARE, or in one document, weigh alike. Frequencies are exact counts over all
documents. Only frequent shingles need a table, which has at most RARE times the
mean number of different shingles in a document. A first pass counts shingles by
a few bits of their hashes; only those in cells with enough of them can be
frequent, and the second pass counts these few exactly.

Each sample of improved consistent weighted sampling agrees for two documents
with the probability of their weighted Jaccard similarity. Samples are cut in
bands; documents that agree in a band are candidates. Candidates are verified by
their weighted Jaccard similarity, worked out from 64-bit hashes of all shingles.

Equal bags are one representative. In a band's bucket every document is first
compared with its least one only; what then is not in one component is compared
tile by tile, by products of matrices: the rest with the largest component and
with itself. So a group of near copies of any size costs one comparison a
member, and one for each document of another component beside it; no candidate
pair between different components is left out, and classes are the components of
all verified links. At the threshold of 0.8 a pair shares a band with a
probability of 0.9994 (14 bands of 4), at 0.9 of 0.999999. Joins on a bucket, its
least document or a bag of shingles are salted.

Defined results: a text of fewer words than five, but not none, is one shingle;
null and empty texts have no shingles, and each is its own class; rows with the
same id are one class if their texts are alike, and share the row's class id
otherwise; ids are of any integer type and returned as long, others are refused
with a TypeError; a null id stays its own class. Extra columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    added_up, blobs, connected_components, gram_hashes, join_groups, mix64, salts_of, slices, span_hashes, stage, text_slices, with_long, words_of,
)

SHINGLE = 5
BANDS, ROWS = 14, 4
RARE = 1000
#: Documents of a bucket in one tile, about; one of more than LOAD shingles counts as several.
TILE, LOAD = 128, 2048
#: Cells of the first count: so many times the frequent shingles that there can be, and bounds.
CELLS, LEAST_CELLS, MOST_CELLS, BLOCKS = 4, 1 << 16, 1 << 24, 256
#: Shingles whose documents a task counts at once.
COUNTED = 1 << 19
#: Documents that one task compares with one least document of a bucket.
STAR = 2048
#: Weights are whole multiples of 1 / UNIT.
UNIT = 1024

_LEVELS = 1 << 16


def _gamma_quantiles() -> np.ndarray:
    """Quantiles of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x), by Newton steps."""
    p = (np.arange(_LEVELS) + 0.5) / _LEVELS
    x = np.where(p < 0.3, np.sqrt(2 * p), 1 - np.log1p(-p))
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-300), 1e-9)
    return x


_GAMMA = _gamma_quantiles()
_R, _INV_R, _LOG_C = _GAMMA.astype(np.float32), (1 / _GAMMA).astype(np.float32), np.log(_GAMMA).astype(np.float32)


def frequencies(docs: DataFrame, grams) -> DataFrame:
    """(gram, df): in how many documents each of ``grams(bytes, offsets) -> (rows, hashes)`` stands; partial counts come from Arrow batches."""

    def counted(parts):
        d, h = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h = h[new]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))[: len(h)]
        df = np.diff(np.append(first, len(h)))
        return pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(df)], ["gram", "df"])

    def run(batches):
        held, n, rows = [], 0, 0
        for _, data, offsets in text_slices(batches):
            d, h = grams(data, offsets)
            held.append((d + rows, h))
            n, rows = n + len(h), rows + len(offsets) - 1
            if n >= COUNTED:
                yield counted(held)
                held, n = [], 0
        if n:
            yield counted(held)

    parts = docs.select("doc_id", "text").mapInArrow(run, "gram long, df long")
    return parts.groupBy("gram").agg(F.sum("df").alias("df"))


def _among(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of ``values`` are among the sorted ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _word_hashes(data: np.ndarray, offsets: np.ndarray):
    starts, ends, of = words_of(data, offsets)
    return span_hashes(data, starts, ends), of


def _rolling(words: np.ndarray, of: np.ndarray, k: int):
    """Rows and hashes of all k words in a row."""
    h = gram_hashes(words, k)
    at = np.flatnonzero(of[: len(h)] == of[k - 1 :]) if len(h) else np.zeros(0, np.int64)
    return of[at], h[at]


def _short(words: np.ndarray, of: np.ndarray, n: int):
    """Rows of fewer words than a shingle, but not none, and the hashes of these words."""
    first = np.searchsorted(of, np.arange(n + 1))
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    total = np.zeros(len(short), np.uint64)
    for i in range(SHINGLE - 1 if len(short) else 0):
        some = count[short] > i
        total[some] = mix64(total[some] + words[first[short][some] + i])
    return short, total


def _hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of all shingles."""
    words, of = _word_hashes(data, offsets)
    row, h = _rolling(words, of, SHINGLE)
    short, total = _short(words, of, len(offsets) - 1)
    return np.concatenate([row, short]), np.concatenate([h, total])


def packed_counts(counts: np.ndarray) -> tuple[bytes, bytes]:
    """(places, counts) of a block of counts: all of them without places, or those above 0 if that is shorter; in the least width that holds the largest."""
    width = np.min_scalar_type(counts.max(initial=0))
    at = np.flatnonzero(counts)
    if len(at) * (2 + width.itemsize) < len(counts) * width.itemsize:
        return at.astype(np.uint16).tobytes(), counts[at].astype(width).tobytes()
    return b"", counts.astype(width).tobytes()


def add_packed(total: np.ndarray, places: bytes, counts: bytes) -> None:
    """Adds a block of ``packed_counts`` to ``total``, whose length is the block's."""
    at = np.frombuffer(places, np.uint16)
    values = np.frombuffer(counts, f"u{len(counts) // (len(at) or len(total))}") if counts else np.zeros(0, np.uint8)
    if len(at):
        total[at] += values
    elif len(values):
        total += values


def full_cells(docs: DataFrame, cells: int, least: float) -> np.ndarray:
    """Which cells, by the low bits of their hashes, have at least ``least`` shingles: a flag a cell.

    Tasks add up tables of their own, and these are added up block by block, a few
    at a time; the driver gets a bit a cell. A task of few shingles sends its cells
    with their places, so that what is sent grows with the texts, not with tasks.
    """
    width = cells // BLOCKS  # at most 65,536, so that a place takes two bytes

    def run(batches):
        counts = np.zeros(cells, np.uint32)
        for _, data, offsets in text_slices(batches):
            _, h = _hashes(data, offsets)
            np.add.at(counts, (h & np.uint64(cells - 1)).astype(np.int64), np.uint32(1))
        # A block at a time: the whole table, as one batch, would stand in memory three times over.
        for block in range(BLOCKS):
            part = counts[block * width : (block + 1) * width]
            if part.any():
                places, values = packed_counts(part)
                row = [pa.array([block], pa.int32()), pa.array([places], pa.binary()), pa.array([values], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, ["block", "places", "counts"])

    def total_of(places, counts):
        total = np.zeros(width, np.uint64)
        for at, part in zip(places, counts, strict=True):
            add_packed(total, at.as_buffer(), part.as_buffer())
        return total

    def add(table):
        places, counts = packed_counts(total_of(table.column("places"), table.column("counts")))
        return {"places": pa.array([places], pa.binary()), "counts": pa.array([counts], pa.binary())}

    def flags(total):
        full = np.packbits(total_of(total.column("places"), total.column("counts")) >= least)
        return {"places": pa.array([b""], pa.binary()), "counts": pa.array([full.tobytes()], pa.binary())}

    parts = docs.select("doc_id", "text").mapInArrow(run, "block int, places binary, counts binary")
    out = np.zeros(cells, bool)
    for r in added_up(parts, add, ["block"], "places binary, counts binary", 256, 2, flags).toLocalIterator():
        out[r.block * width : (r.block + 1) * width] = np.unpackbits(np.frombuffer(r.counts, np.uint8))
    return out


def shingle_weights(docs: DataFrame, rare: int = RARE) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted hashes and weights of the shingles in two documents and one of ``rare`` at least, and the weight of all others."""
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    least = max(2.0, n / rare)
    # Words of six bytes, about: a wrong guess costs time only.
    wanted = int(CELLS * min(rare * size / 6 / max(n, 1), size / 6)) + 1
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << wanted.bit_length()))
    full = np.packbits(full_cells(docs, cells, least))  # every task gets it: a bit a cell

    def able(data, offsets):
        row, h = _hashes(data, offsets)
        cell = (h & np.uint64(cells - 1)).astype(np.int32)
        some = (full[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
        return row[some], h[some]

    rows = frequencies(docs, able).where(F.col("df") >= least).toPandas()
    h, df = rows["gram"].to_numpy(np.int64).view(np.uint64), rows["df"].to_numpy(float)
    order = np.argsort(h)
    weight = lambda df: 1 + np.minimum(np.log((n + 1) / (df + 1)), np.log(rare))
    return h[order], np.rint(weight(df[order]) * UNIT).astype(np.int64), int(round(weight(1.0) * UNIT)) if n else UNIT


def shingles(data: np.ndarray, offsets: np.ndarray, idf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, weight of one) of all shingles of all rows, sorted by row and hash."""
    known, weights, rare = idf
    row, h = _hashes(data, offsets)
    place = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
    w = np.where(known[place] == h, weights[place], rare) if len(known) else np.full(len(h), rare)
    order = np.lexsort((h, row))
    return row[order], h[order], w[order]


def samples(h: np.ndarray, log_weight: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """n samples (columns) of each bag: improved consistent weighted sampling.

    ``first``: where each bag's shingles begin. For each shingle and sample, r
    and c are Gamma(2, 1) and b is uniform, all by the shingle's hash; t is the
    floor of log weight / r + b, and the shingle with the least
    log c - r (t - b + 1) is the sample, with its t.
    """
    out = np.empty((len(first), n), np.uint32)
    # Buffers are made once: most of the work of an operator is here.
    z, shifted = np.empty((2, len(h)), np.uint64)
    parts = z.view(np.uint16).reshape(-1, 4)  # independent 16-bit numbers: b, c and r
    t, a, b, r_of = np.empty((4, len(h)), np.float32)
    tag, key = np.empty(len(h), np.int32), np.empty(len(h), np.int64)
    halves = key.view(np.int32).reshape(-1, 2)
    low = h.astype(np.uint32).view(np.int32)
    for k in range(n):
        np.bitwise_xor(h, np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)), out=z)
        z *= np.uint64(0xD6E8FEB86659FD93)
        np.right_shift(z, np.uint64(32), out=shifted)
        z ^= shifted
        z *= np.uint64(0xBF58476D1CE4E5B9)
        r, c = parts[:, 3].astype(np.intp), parts[:, 2].astype(np.intp)
        np.multiply(parts[:, 1], np.float32(1 / _LEVELS), out=b)
        np.take(_INV_R, r, out=t, mode="clip")
        t *= log_weight
        t += b
        np.floor(t, out=t)
        np.copyto(tag, t, casting="unsafe")
        b -= t
        b -= np.float32(1)
        np.take(_R, r, out=r_of, mode="clip")
        b *= r_of
        np.take(_LOG_C, c, out=a, mode="clip")
        a += b
        # Bits of floats, with those of negative ones turned about, are in their order.
        bits = a.view(np.int32)
        bits ^= (bits >> 31) & 0x7FFFFFFF
        tag *= np.int32(0x1E3779B1)
        tag += low
        halves[:, 1], halves[:, 0] = bits, tag
        out[:, k] = np.minimum.reduceat(key, first).astype(np.uint32)
    return out


def _bags(row: np.ndarray, h: np.ndarray, w: np.ndarray):
    """Different shingles (row, hash, weight of one, count)."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    return row[first], h[first], w[first], np.diff(np.append(first, len(row)))


def signatures(docs: DataFrame, idf, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, bag, weight, bands array<long>) of every document; null for those without shingles."""

    def run(batches):
        for ids, data, offsets in text_slices(batches, 256 << 10):
            n = len(offsets) - 1
            row, h, w, tf = _bags(*shingles(data, offsets, idf))
            some, first = np.unique(row, return_index=True)
            keys = np.zeros((n, bands), np.int64)
            bag, weight = np.zeros((2, n), np.int64)
            if len(some):
                s = samples(h, np.log(tf * w / UNIT).astype(np.float32), first, bands * rows).astype(np.uint64)
                total = np.zeros((len(some), bands), np.uint64)
                for i in range(rows):
                    total = mix64(total + s[:, i::rows] + np.uint64(1))
                keys[some] = total.view(np.int64)
                bag[some] = np.add.reduceat(mix64(h + mix64(tf.astype(np.uint64))), first).view(np.int64)
                weight[some] = np.add.reduceat(tf * w, first)
            bare = np.ones(n, bool)
            bare[some] = False
            lists = pa.ListArray.from_arrays(np.arange(0, n * bands + 1, bands, dtype=np.int32), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(bag, mask=bare), pa.array(weight, mask=bare), lists], ["id", "bag", "weight", "bands"]
            )

    return docs.select(F.col("doc_id").alias("id"), "text").mapInArrow(
        run, "id long, bag long, weight long, bands array<long>"
    )


def weighted_sets(docs: DataFrame, idf) -> DataFrame:
    """(id, elements, weights): sorted 8-byte hashes of each text's shingles and their weights; the j-th of equal shingles is an element of its own.

    So the weight that two documents share is that of their common elements.
    """

    def run(batches):
        for ids, data, offsets in text_slices(batches):
            row, h, w = shingles(data, offsets, idf)
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
            first = np.flatnonzero(new)
            nth = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
            element = mix64(h + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            order = np.lexsort((element, row))
            element, w = element[order], np.minimum(w[order], 65535).astype(np.uint16)
            edges = np.searchsorted(row, np.arange(len(offsets)))
            cut = lambda v: pa.array([v[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, cut(element), cut(w)], ["id", "elements", "weights"])

    return docs.mapInArrow(run, "id long, elements binary, weights binary")


def similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs`` (a, b, n) whose weighted Jaccard similarity reaches ``threshold``; ``n``: pairs of ``a``, at most.

    A document ``a`` of many pairs goes to a task for every STAR of them.
    """

    def run(batches):
        for batch in batches:
            a, b = (np.asarray(batch.column(c), np.int64) for c in ("a", "b"))
            sizes = np.asarray(pa.compute.binary_length(batch.column("y")), np.int64)
            for low, high in slices(sizes, 16 << 20):
                part = batch.slice(low, high - low)
                y, at = blobs(part.column("y"), np.uint64)
                wy, _ = blobs(part.column("wy"), np.uint16)
                wy = wy.astype(np.int64)
                total = np.concatenate([[0], np.cumsum(wy)])
                weight, shared = total[at[1:]] - total[at[:-1]], np.zeros(high - low, np.int64)
                of_a, own = a[low:high], np.zeros(high - low, np.int64)
                # Rows with one a stand together: its set is read once, and all others are looked up in it.
                edges = np.append(np.flatnonzero(np.append(True, of_a[1:] != of_a[:-1])), high - low)
                for i, j in zip(edges, edges[1:], strict=False):
                    x = np.frombuffer(part.column("x")[i].as_py(), np.uint64)
                    own[i:j] = np.frombuffer(part.column("wx")[i].as_py(), np.uint16).sum(dtype=np.int64)
                    hit = _among(x, y[at[i] : at[j]])
                    sums = np.concatenate([[0], np.cumsum(np.where(hit, wy[at[i] : at[j]], 0))])
                    shared[i:j] = sums[at[i + 1 : j + 1] - at[i]] - sums[at[i:j] - at[i]]
                keep = shared >= threshold * (own + weight - shared) - 1e-9
                yield pa.RecordBatch.from_arrays([pa.array(of_a[keep]), pa.array(b[low:high][keep])], ["a", "b"])

    salts = F.ceil(F.col("n") / STAR).cast("int")
    left = sets.select(F.col("id").alias("b"), F.col("elements").alias("y"), F.col("weights").alias("wy"))
    right = pairs.groupBy("a").agg(F.max("n").alias("n")).join(sets.withColumnsRenamed({"id": "a", "elements": "x", "weights": "wx"}), "a")
    right = right.select("a", "x", "wx", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    pairs = pairs.select("a", "b", F.pmod(F.xxhash64("b"), salts.cast("long")).cast("int").alias("salt"))
    both = pairs.join(left, "b").join(right.hint("merge"), ["a", "salt"])
    return both.select("a", "b", "x", "wx", "y", "wy").mapInArrow(run, "a long, b long")


def shared_weights(elements: list[np.ndarray], weights: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """The weight that each two sets share, as a matrix."""
    n = len(elements)
    owner = np.repeat(np.arange(n), [len(e) for e in elements])
    element, place, count = np.unique(np.concatenate(elements), return_inverse=True, return_counts=True)
    weight = np.zeros(len(element))
    weight[place] = np.concatenate(weights)
    often = np.flatnonzero(count > 1)
    column = np.full(len(element), -1)
    column[often] = np.arange(len(often))
    at = column[place]
    owner, at = owner[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((n, n))
    for low in range(0, len(often), step):
        a, b = np.searchsorted(at, [low, low + step])
        has = np.zeros((n, step), np.float64)
        has[owner[a:b], at[a:b] - low] = np.sqrt(weight[often[at[a:b]]])
        out += has @ has.T
    return out


def crossed(placed: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """Links (a, b) between different components in one bucket, from its members with their sets.

    A bucket's largest component and the rest are each cut into tiles by a hash.
    Tiles of the rest meet one another and those of the largest component, which
    never meet among themselves: a stray document beside a million near copies
    sends each of them to one task once. Two tiles are a task's work, whatever the
    bucket's size: their shared weights are one product of matrices, and only links
    come out. A pair that also shares an earlier band is left to that band's bucket.
    """
    tiles = lambda load: F.ceil(load / tile).cast("int")
    is_main = F.col("component") == F.col("main")
    main, rest = tiles(F.col("main_load")), tiles(F.col("load") - F.col("main_load"))
    dealt = lambda n: F.pmod(F.xxhash64("rep"), n.cast("long")).cast("int")
    # Tiles of the largest component are -1, -2, ..., those of the rest 0, 1, ...; a small bucket is one tile.
    small = F.col("load") <= tile
    placed = placed.withColumn("_tile", F.when(small, 0).when(is_main, -1 - dealt(main)).otherwise(dealt(rest)))
    others = F.when(small, F.array(F.lit(0))).when(is_main, F.sequence(F.lit(0), rest - 1)).otherwise(F.sequence(-main, rest - 1))
    placed = placed.withColumn("_other", F.explode(others))
    placed = placed.withColumns({"_first": F.least("_tile", "_other"), "_second": F.greatest("_tile", "_other")})

    def run(table):
        band, first, second = (table.column(c)[0].as_py() for c in ("band", "_first", "_second"))
        rep, weight, component, own = (np.asarray(table.column(c), np.int64) for c in ("rep", "weight", "component", "_tile"))
        n = len(rep)
        keys = np.asarray(table.column("bands").combine_chunks().flatten(), np.int64).reshape(n, -1)
        able = (component[:, None] != component[None]) & (rep[:, None] < rep[None])
        able &= np.minimum(weight[:, None], weight[None]) >= threshold * np.maximum(weight[:, None], weight[None]) - 1
        if first != second:
            able &= own[:, None] != own[None]
        for earlier in range(band):
            able &= keys[:, None, earlier] != keys[None, :, earlier]
        i, j = np.nonzero(able)
        if len(i):
            e = [np.frombuffer(x, np.uint64) for x in table.column("elements").to_pylist()]
            w = [np.frombuffer(x, np.uint16).astype(np.float64) for x in table.column("weights").to_pylist()]
            total = np.array([x.sum() for x in w])
            shared = shared_weights(e, w)[i, j]
            near = shared >= threshold * (total[i] + total[j] - shared) - 1e-6
            i, j = i[near], j[near]
        return pa.table({"a": rep[i], "b": rep[j]})

    return placed.groupBy("band", "key", "_first", "_second").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id, kept): each document's class, known by its least id, which is kept."""
    docs = with_long(docs, "doc_id")
    idf = shingle_weights(docs)
    every = stage(signatures(docs, idf, bands, rows), "minhash-signatures")
    known = every.where("bag is not null and id is not null")
    bags = known.groupBy("bag").agg(F.min("id").alias("rep"), F.max("weight").alias("weight"), salts_of("id").alias("salts"))
    own = join_groups(known.select("id", "bag", "bands"), bags, ["bag"], "id").where("id = rep")
    own = stage(own.select("rep", "weight", "bands").dropDuplicates(["rep"]), "minhash-bags")
    members = own.select("rep", "weight", F.posexplode("bands").alias("band", "key"))
    bucket = ["band", "key"]
    buckets = members.groupBy(*bucket).agg(F.min(F.struct("rep", "weight")).alias("hub"), F.count("*").alias("n"), salts_of("rep").alias("salts"))
    members = stage(join_groups(members, buckets.where("n > 1"), bucket, "rep"), "minhash-members")

    # A similarity is at most the smaller weight over the larger.
    able = F.least("weight", "hub.weight") >= F.greatest("weight", "hub.weight") * threshold - 1
    stars = members.where((F.col("rep") != F.col("hub.rep")) & able)
    stars = stars.groupBy(F.col("hub.rep").alias("a"), F.col("rep").alias("b")).agg(F.max("n").alias("n"))
    # Candidates grow with the documents: the plan is the same, a merge, at every size.
    wanted = members.select(F.col("rep").alias("_id")).distinct().hint("merge")
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(wanted, F.col("id") == F.col("_id"), "left_semi")
    sets = stage(weighted_sets(texts, idf).dropDuplicates(["id"]), "minhash-sets")
    links = stage(similar(stars, sets, threshold), "minhash-links")
    component = connected_components(links, "minhash-components")

    placed = members.join(component, F.col("rep") == F.col("node"), "left").select(
        "band", "key", "rep", "weight", F.coalesce("component", "rep").alias("component")
    )
    load = 1 + F.expr(f"weight div {UNIT * 8 * LOAD}")
    parts = placed.groupBy(*bucket, "component").agg(F.sum(load).alias("load"), salts_of("rep").alias("salts"))
    mixed = parts.groupBy(*bucket).agg(
        F.max_by("component", F.struct("load", "component")).alias("main"), F.max("load").alias("main_load"),
        F.sum("load").alias("load"), F.bit_or("salts").alias("salts"),
    )
    placed = join_groups(placed, mixed.where("main_load < load"), bucket, "rep")
    placed = placed.join(own.select("rep", "bands"), "rep").join(sets, F.col("rep") == F.col("id"))
    more = stage(crossed(placed, threshold), "minhash-more-links")
    if not more.isEmpty():
        component = connected_components(component.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), "minhash-components")
    classes = bags.join(component, F.col("rep") == F.col("node"), "left").select("bag", "salts", F.coalesce("component", "rep").alias("_class"))
    out = join_groups(known.select("id", "bag"), classes, ["bag"], "id").select("id", "_class")
    out = out.union(every.where("bag is null or id is null").select("id", F.lit(None).cast("long")))
    class_id = F.when(F.col("id").isNotNull(), F.coalesce("_class", "id"))
    return out.select(F.col("id").alias("doc_id"), class_id.alias("class_id"), F.coalesce(F.col("id") == class_id, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept; of rows with one id and one text, one."""
    kept = near_duplicates(docs, **options).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    kept = stage(kept, "minhash-kept")
    out = docs.join(kept, docs["doc_id"] == kept["_id"], "left_semi")
    repeated = stage(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "minhash-repeated")
    if not repeated.isEmpty():
        again = out.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        out = out.join(repeated, "doc_id", "left_anti").unionByName(again)
    return out.unionByName(docs.where("doc_id is null"))
