"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are scaled to length 1 and turned to their principal axes, widest first.
They are dealt to ranges of their first coordinate, and those with more vectors
than a tile to several tiles by a hash. Two tiles are compared if
their ranges of it can hold a pair near enough; then the products of the leading
coordinates are accumulated, what the others can still add is bounded by the
norms of the two suffixes, and only pairs that can reach the threshold are
worked out, in the end from the given coordinates in double precision. The bound
never drops a pair that reaches the threshold.

Equal vectors are one representative with a number of copies. A tile pair gives
numbers of links and the edges of a spanning forest, not its pairs, so that a
dense group of any size gives as many edges as members; components come from the
edges of all tile pairs.

Any two tiles may have to meet, as without a bound on the angle's spread nothing
less is exact: the work of unclustered vectors grows with the square of their
number, about 10 ns a pair. A tile holds TILE_BYTES of coordinates at most and no
less where there are vectors enough, so that what is moved, two tiles a pair, is
small beside the work on it. Joins of pairs to tiles are salted: a tile that
meets all others is dealt to many tasks; so is that of equal vectors to what their
representative has found.

Defined results: a vector that is null, empty, zero, or has a null or non-finite
component links with nothing and is its own component; vectors of different
lengths link with nothing of another length; rows with the same id and different
embeddings add up their links; a vector without id links with nothing. Ids are of
any integer type and returned as long; others are refused with a TypeError. Extra
columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import added_up, connected_components, join_groups, salts_of, stage, with_long

#: Bytes of coordinates in a tile, at most; tiles of small inputs are cut finer, for TILES of them.
TILE_BYTES, TILES, LEAST_TILE = 16 << 20, 24, 512
#: Ranges of the first coordinate, at most: larger ones are cut by a hash.
RANGES = 2048
#: Pairs of tiles that one task compares, about.
TASK_PAIRS = 8
#: Slack of bounds against rounding.
EPS = 1e-6


def _matrix(column) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(values.flatten(), np.float64)
    return flat.reshape(len(values), -1) if len(values) else flat.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    # Scaled by the largest component first: squares neither overflow nor vanish.
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal_axes(vectors: DataFrame, size: int) -> np.ndarray:
    """Orthonormal axes, widest spread first, from the products of all unit vectors.

    Tasks add up their own products, and these are added up a few at a time; the
    driver gets one matrix, whatever the number of vectors.
    """

    def products(batches):
        total, n = np.zeros((size, size)), 0
        for b in batches:
            if b.num_rows:
                u = unit(_matrix(b.column("v")))
                total += u.T @ u
                n += 1
        if n:
            yield pa.RecordBatch.from_pydict({"m": [total.ravel()]})

    parts = vectors.select("v").mapInArrow(products, "m array<double>")
    total = added_up(parts, lambda table: {"m": [_matrix(table.column("m")).sum(0)]}, [], "m array<double>", 16, 4)
    row = total.first()
    total = np.array(row.m).reshape(size, size) if row else np.eye(size)
    return np.linalg.eigh(total)[1][:, ::-1].copy()


def near_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, least: float, same: bool):
    """(i, j) of the pairs of unit vectors with cosine >= ``least``, by blocks; i < j in one tile.

    Coordinates come in blocks of 16: after each, pairs are dropped whose sum so
    far plus the product of the suffixes' norms is too small.
    """
    pa_, pb = a @ axes, b @ axes
    d, step = axes.shape[0], 16
    rows = max(16, (1 << 21) // max(len(b), 1))
    # Norms of what follows each block of coordinates, for whole tiles at once.
    rests = [[np.sqrt((p[:, low:] ** 2).sum(1)) for low in range(step, d + step, step)] for p in (pa_, pb)]
    for row in range(0, len(a), rows):
        x = pa_[row : row + rows]
        dot = x[:, :step] @ pb[:, :step].T
        i, j = np.nonzero(dot + np.outer(rests[0][0][row : row + rows], rests[1][0]) >= least - EPS)
        if same:
            i, j = i[i + row < j], j[i + row < j]
        sums = dot[i, j]
        for k, low in enumerate(range(step, d, step), 1):
            if not len(i):
                break
            sums = sums + np.einsum("ij,ij->i", x[i, low : low + step], pb[j, low : low + step])
            able = sums + rests[0][k][row + i] * rests[1][k][j] >= least - EPS
            i, j, sums = i[able], j[able], sums[able]
        for part in range(0, len(i), 1 << 18):
            p, q = i[part : part + (1 << 18)], j[part : part + (1 << 18)]
            near = np.einsum("ij,ij->i", a[row + p], b[q]) >= least
            yield row + p[near], q[near]


def compare(a: np.ndarray, b: np.ndarray, axes: np.ndarray, least: float, same: bool):
    """All of ``near_pairs`` at once."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *near_pairs(a, b, axes, least, same)]
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Places of pairs (of nodes 0 .. n - 1) that join all that the pairs join: fewer than n."""
    # Least-label propagation; the pairs that first give a node its label stay.
    label = np.arange(n)
    kept = []
    while True:
        a, b = label[i], label[j]
        open_ = np.flatnonzero(a != b)
        if not len(open_):
            return np.concatenate(kept) if kept else np.zeros(0, np.int64)
        low, high = np.minimum(a[open_], b[open_]), np.maximum(a[open_], b[open_])
        order = np.lexsort((low, high))
        first = np.ones(len(order), bool)
        first[1:] = high[order][1:] != high[order][:-1]
        pick = order[first]
        kept.append(open_[pick])
        label[high[pick]] = low[pick]
        while not np.array_equal(label, label[label]):
            label = label[label]


def near_duplicates(rows: DataFrame, threshold: float = 0.95, tile: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector; ``tile``: vectors in a tile, if not by TILE_BYTES."""
    rows = with_long(rows, "vec_id")
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.exists(v, lambda x: x != 0)
    fine = fine & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = fine & F.col("vec_id").isNotNull()
    every = rows.select("vec_id", F.when(F.coalesce(fine, F.lit(False)), v).alias("v"))
    every = stage(every.withColumn("key", F.md5(F.array_join("v", ",").cast("binary"))), "embeddings")
    # One representative of equal vectors: the least id, with the number of others.
    usable = every.where("v is not null")
    reps = usable.groupBy("key").agg(
        F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"), F.min_by("v", "vec_id").alias("v"), salts_of("vec_id").alias("salts")
    )
    reps = stage(reps, "embedding-representatives")
    parts = []
    for (size,) in sorted(reps.select(F.size("v")).distinct().toLocalIterator()):
        parts.append(_links(reps.where(F.size("v") == size), size, threshold, tile))
    none = every.sparkSession.createDataFrame([], "rep long, other long, links long")
    found = none
    for p in parts:
        found = found.unionByName(p)
    found = stage(found, "embedding-links")
    links = found.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    edges = found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b"))
    component = connected_components(edges, "embedding-components")
    known = reps.select("key", "salts", "rep", "copies").join(links, "rep", "left")
    known = known.join(component, F.col("rep") == F.col("node"), "left").select(
        "key",
        "salts",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"),
        F.coalesce("component", "rep").alias("_component"),
    )
    out = join_groups(usable.select("vec_id", "key"), known, ["key"], "vec_id").select("vec_id", "_links", "_component")
    none = F.lit(None).cast("long")
    out = out.union(every.where("v is null").select("vec_id", none, none))
    component_id = F.coalesce("_component", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        component_id.alias("component_id"),
        F.coalesce(F.col("vec_id") == component_id, F.lit(True)).alias("kept"),
    )


def sub_tile(tile: int) -> Column:
    """The tile of a vector in a range of ``n`` vectors, dealt by a hash into as many tiles as it needs.

    Equal first coordinates fall in one range, however many they are.
    """
    parts = F.ceil(F.col("n") / tile)
    return F.shiftleft(F.col("range"), 32) + F.pmod(F.xxhash64("rep", "v"), parts)


def tile_pairs(ranges: DataFrame, gap: float, least: float) -> DataFrame:
    """(s, t), once each, of tiles (tile, low, high) whose ranges are ``gap`` apart at most; each meets itself.

    A tile reaches over buckets of the axis, and each other one stands in that of
    its low end. Buckets are ``least`` wide or more, so that a tile of usual width
    reaches over few.
    """
    width = max(gap / 32, least)
    bucket = lambda c: F.floor(c / width)
    reach = F.col("high") + gap
    left = ranges.select(
        F.col("tile").alias("s"), F.col("low").alias("from"), reach.alias("to"), F.explode(F.sequence(bucket(F.col("low")), bucket(reach))).alias("bucket")
    )
    right = ranges.select(F.col("tile").alias("t"), "low", bucket(F.col("low")).alias("bucket"))
    later = (F.col("from") < F.col("low")) | ((F.col("from") == F.col("low")) & (F.col("s") <= F.col("t")))
    return left.join(right, "bucket").where(later & (F.col("low") <= F.col("to"))).select("s", "t")


def _links(reps: DataFrame, size: int, threshold: float, tile: int | None) -> DataFrame:
    """Numbers of links (rep, null, links) and forest edges (rep, other, null) of vectors of one length."""
    axes = principal_axes(reps, size)
    first = axes[:, 0]

    def placed(batches):
        for b in batches:
            x = _matrix(b.column("v"))
            at = unit(x) @ first if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("copies"), b.column("v"), pa.array(at)], ["rep", "copies", "v", "at"])

    at = reps.select("rep", "copies", "v").mapInArrow(placed, "rep long, copies long, v array<double>, at double")
    count = reps.count()
    tile = tile or min(max(1, TILE_BYTES // (8 * size)), max(LEAST_TILE, -(-count // TILES)))
    n_ranges = max(1, min(RANGES, -(-count // tile)))
    cuts = at.select(F.percentile_approx("at", [i / n_ranges for i in range(1, n_ranges)], 10_000)).first()[0] if n_ranges > 1 else []
    cuts = np.array(sorted(set(cuts)))

    def ranged(batches):
        for b in batches:
            t = np.searchsorted(cuts, np.asarray(b.column("at")), side="right").astype(np.int64)
            yield b.append_column("range", pa.array(t))

    at = stage(at.mapInArrow(ranged, "rep long, copies long, v array<double>, at double, range long"), "embedding-ranges")
    at = at.join(F.broadcast(at.groupBy("range").agg(F.count("*").alias("n"))), "range").withColumn("tile", sub_tile(tile))

    def bundled(table):
        order = np.argsort(np.asarray(table.column("rep")))
        x = _matrix(table.column("v"))[order]
        rep, copies = (np.asarray(table.column(c), np.int64)[order] for c in ("rep", "copies"))
        low, high = ([f(np.asarray(table.column("at")))] for f in (np.min, np.max))
        return pa.table(
            {"tile": table.column("tile").slice(0, 1), "low": low, "high": high, "rep": [rep.tobytes()], "copies": [copies.tobytes()], "v": [x.tobytes()]}
        )

    schema = "tile long, low double, high double, rep binary, copies binary, v binary"
    tiles = at.select("tile", "at", "rep", "copies", "v").groupBy("tile").applyInArrow(bundled, schema)
    tiles = stage(tiles, "embedding-bundles")
    # |x - y| <= sqrt(2 - 2 cos), and so are the differences of single coordinates.
    gap = np.sqrt(max(0.0, 2 - 2 * threshold)) + EPS
    pairs = stage(tile_pairs(tiles.select("tile", "low", "high"), gap, 2 / n_ranges), "embedding-pairs")
    tiles = tiles.drop("low", "high")

    def meet(batches):
        for b in batches:
            for r in b.to_pylist():
                a, c = (np.frombuffer(r[k], np.float64).reshape(-1, size) for k in ("v", "v2"))
                ids, others = np.frombuffer(r["rep"], np.int64), np.frombuffer(r["rep2"], np.int64)
                m, w = np.frombuffer(r["copies"], np.int64), np.frombuffer(r["copies2"], np.int64)
                same = r["s"] == r["t"]
                n_a, n_c = np.zeros(len(a), np.int64), np.zeros(len(c), np.int64)
                p = q = np.zeros(0, np.int64)
                for i, j in near_pairs(unit(a), unit(c), axes, threshold, same):
                    n_a += np.bincount(i, w[j], len(a)).astype(np.int64)
                    n_c += np.bincount(j, m[i], len(c)).astype(np.int64)
                    p, q = np.concatenate([p, i]), np.concatenate([q, j])
                    tree = forest(p, q + (0 if same else len(a)), len(a) + (0 if same else len(c)))
                    p, q = p[tree], q[tree]
                x, y = np.flatnonzero(n_a), np.flatnonzero(n_c)
                rep = np.concatenate([ids[x], others[y], ids[p]])
                count = len(x) + len(y)
                other = np.concatenate([np.zeros(count, np.int64), others[q]])
                links = np.concatenate([n_a[x], n_c[y], np.zeros(len(p), np.int64)])
                is_edge = np.arange(len(rep)) >= count
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rep), pa.array(other, mask=~is_edge), pa.array(links, mask=is_edge)], ["rep", "other", "links"]
                )

    n_pairs, n_tiles = pairs.count(), max(1, tiles.count())
    tasks = max(1, -(-n_pairs // TASK_PAIRS))
    # The pairs of one tile are dealt to so many tasks, each of which gets the tile once.
    salts = max(1, -(-n_pairs // (n_tiles * TASK_PAIRS)))
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(salts)).alias("salt")
    salted = tiles.withColumn("salt", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")))
    left = salted.withColumnRenamed("tile", "s").repartition(tasks, "s", "salt")
    right = salted.select(F.col("tile").alias("t"), "salt", F.col("rep").alias("rep2"), F.col("copies").alias("copies2"), F.col("v").alias("v2"))
    with_s = pairs.select("s", "t", salt("t")).repartition(tasks, "s", "salt").join(left.hint("merge"), ["s", "salt"])
    with_s = with_s.withColumn("salt", salt("s")).repartition(tasks, "t", "salt")
    both = with_s.join(right.repartition(tasks, "t", "salt").hint("merge"), ["t", "salt"])
    return both.select("s", "t", "rep", "copies", "v", "rep2", "copies2", "v2").mapInArrow(meet, "rep long, other long, links long")
