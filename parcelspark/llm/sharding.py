"""Sharding by best-fit-decreasing bin packing.

Groups of documents with equal texts are indivisible items. Items sorted by
size enter, each, the bin with the tightest remaining capacity that still holds
it, found in a balanced tree of the bins by remaining capacity.

Best-fit decreasing looks at sizes only, so the packing is computed from the
number of items of each size: Spark counts them and sorts the sizes, one pass over
them packs them, a run of items of one size at a time, and Spark deals the items of
each size to the bins by their rank. Sizes are exact. The driver reads them a
stretch of ``SIZES`` at a time, largest first, and writes what it has packed to a
table, so that it holds the bins, one stretch of sizes and one of runs, whatever
the input. It never holds items.

A group larger than a bin can't stay whole: it is dealt, by a hash of its
document ids, to pieces of about ``split_share`` of the capacity. All other
groups stay together.

Defined results: a null text counts as empty; all empty texts are one group
(and split when that is large); rows with the same id are rows of their own;
an empty table gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, join_groups, running_total, salts_of, stage, union_all

#: Ranks of one size whose bins are looked up together.
STRETCH = 256
#: Sizes that the driver reads, and runs that it writes, together.
SIZES = 1 << 16


class CapacityTree:
    """Bins by remaining capacity in an AVL tree; bins of one capacity share a node."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None  # [capacity, bins, left, right, height]

    @staticmethod
    def _height(t):
        return t[4] if t else 0

    def _level(self, t):
        t[4] = 1 + max(self._height(t[2]), self._height(t[3]))
        lean = self._height(t[2]) - self._height(t[3])
        for side, other, sign in ((2, 3, 1), (3, 2, -1)):
            if lean * sign > 1:
                child = t[side]
                if self._height(child[side]) < self._height(child[other]):
                    t[side] = child = self._turn(child, other, side)
                return self._turn(t, side, other)
        return t

    def _turn(self, t, side, other):
        top = t[side]
        t[side], top[other] = top[other], t
        for x in (t, top):
            x[4] = 1 + max(self._height(x[2]), self._height(x[3]))
        return top

    def add(self, capacity: int, bin_id: int) -> None:
        def into(t):
            if t is None:
                return [capacity, [bin_id], None, None, 1]
            if capacity == t[0]:
                t[1].append(bin_id)
                return t
            side = 2 if capacity < t[0] else 3
            t[side] = into(t[side])
            return self._level(t)

        self.root = into(self.root)

    def tightest(self, size: int):
        """The least capacity that holds ``size``, or None."""
        t, found = self.root, None
        while t:
            if t[0] >= size:
                found, t = t[0], t[2]
            else:
                t = t[3]
        return found

    def widest(self):
        t = self.root
        while t and t[3]:
            t = t[3]
        return t[0] if t else None

    def take(self, capacity: int) -> int:
        """Remove a bin of this capacity, and the node with its last bin."""
        out = []

        def least(t):
            while t[2]:
                t = t[2]
            return t

        def drop(t, key, whole):
            if key != t[0]:
                side = 2 if key < t[0] else 3
                t[side] = drop(t[side], key, whole)
                return self._level(t)
            if not whole:
                out.append(t[1].pop(0))
                if t[1]:
                    return t
            if not t[2] or not t[3]:
                return t[2] or t[3]
            up = least(t[3])
            t[0], t[1] = up[0], up[1]
            t[3] = drop(t[3], up[0], True)
            return self._level(t)

        self.root = drop(self.root, capacity, False)
        return out[0]


def best_fit_decreasing(sizes: dict[int, int], capacity: int, bins: int | None = None) -> list[tuple[int, int, int, int]]:
    """The runs of ``fitted`` for ``sizes``: size -> number of items."""
    return list(fitted(sorted(sizes.items(), reverse=True), capacity, bins))


def fitted(falling: Iterable[tuple[int, int]], capacity: int, bins: int | None = None) -> Iterator[tuple[int, int, int, int]]:
    """Runs (size, first rank, last rank + 1, bin) for (size, number of items), largest sizes first.

    With ``bins``, so many bins are there from the start, and an item that none
    of them can hold goes to the one with most room; else bins are opened as
    they are needed, for few of fixed capacity.
    """
    tree, opened = CapacityTree(), 0
    if bins:
        for b in range(bins):
            tree.add(capacity, b)
        opened = bins
    for size, left in falling:
        rank = 0
        while left:
            room = tree.tightest(size)
            if room is None and bins:
                room, n = tree.widest(), 1
            elif room is None:
                tree.add(max(capacity, size), opened)
                opened += 1
                continue
            else:
                n = min(left, room // size) if size else left
            b = tree.take(room)
            yield size, rank, rank + n, b
            tree.add(room - n * size, b)
            rank, left = rank + n, left - n


def _plan(items: DataFrame, capacity: int, bins: int | None) -> DataFrame:
    """The runs (_size, _from, _to, _bin) for ``items`` by their bytes."""
    spark = items.sparkSession
    sizes = stage(items.groupBy(F.col("bytes").alias("_size")).agg(F.count("*").alias("_n")), "shard-sizes")
    # Ranges of sizes with so many of them each: the driver reads one after the other.
    falling = sizes.repartitionByRange(-(-sizes.count() // SIZES) or 1, F.desc("_size")).sortWithinPartitions(F.desc("_size"))
    runs = fitted(((r["_size"], r["_n"]) for r in falling.toLocalIterator()), capacity, bins)
    parts = []
    while (part := list(islice(runs, SIZES))) or not parts:
        part = spark.createDataFrame(part, "_size long, _from long, _to long, _bin int")
        parts.append(stage(part, "shard-runs"))
    return union_all(parts)


def pack(items: DataFrame, capacity: int, bins: int | None = None) -> DataFrame:
    """``items`` (key, bytes, salts) with the bin of each; keys are distinct."""
    items = items.withColumn("_size", F.col("bytes"))
    n_buckets = buckets_for(items.count())
    items = items.withColumn("_bucket", F.pmod(F.xxhash64("key"), F.lit(n_buckets)).cast("int")).withColumn("_one", F.lit(1))
    ranked = running_total(items, "_size", "_bucket", ["key"], "_one", "_rank")
    # A rank finds its run among those of its stretch: STRETCH at most, however many bins a size is dealt to.
    plan = _plan(items, capacity, bins).withColumn("_stretch", F.explode(F.expr(f"sequence(_from div {STRETCH}, (_to - 1) div {STRETCH})")))
    plan = plan.groupBy("_size", "_stretch").agg(F.array_sort(F.collect_list(F.struct("_from", "_bin"))).alias("_runs"))
    ranked = ranked.withColumn("_stretch", F.expr(f"_rank div {STRETCH}")).join(plan.hint("merge"), ["_size", "_stretch"])
    place = F.size(F.filter("_runs", lambda r: r["_from"] <= F.col("_rank")))
    return ranked.select("key", "salts", F.element_at("_runs", place)["_bin"].alias("bin"))


def _items(rows: DataFrame) -> DataFrame:
    """The items of ``rows`` (key, size, doc_id): their bytes, and the salts of their rows."""
    return rows.groupBy("key").agg(F.sum("size").alias("bytes"), salts_of("doc_id").alias("salts"))


def shard(docs: DataFrame, shards: int = 40, split_share: float = 0.125, overhead: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): all documents in ``shards`` shards of near-equal bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + overhead).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("group"),
    )
    rows = stage(rows, "shard-rows")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    capacity = max(1, -(-total // shards))
    piece = max(1, int(capacity * split_share))
    # A group's rows are of one size, so that this size and their number give its bytes.
    groups = rows.groupBy("group").agg((F.count("*") * F.max("size")).alias("_all")).where(F.col("_all") > capacity)
    pieces = groups.select("group", F.ceil(F.col("_all") / piece).cast("int").alias("_pieces"))
    # Groups larger than a shard are fewer than shards.
    rows = rows.join(F.broadcast(pieces), "group", "left").withColumn(
        "key", F.concat("group", F.lit(":"), F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("_pieces")), F.lit(0)).cast("string"))
    )
    placed = join_groups(rows, pack(_items(rows), capacity, shards), ["key"], "doc_id")
    placed = placed.select("doc_id", "size", "text_crc32", F.col("bin").alias("shard"))
    buckets = buckets_for(count)
    placed = placed.withColumn("_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")).withColumn("_one", F.lit(1))
    return running_total(placed, "shard", "_bucket", ["doc_id", "text_crc32"], "_one", "slot").drop("_bucket", "_one")


def open_shards(docs: DataFrame, capacity: int, overhead: int = 16) -> DataFrame:
    """(doc_id, size, shard): as few shards of ``capacity`` bytes as best-fit decreasing opens.

    Groups of equal texts larger than the capacity are split as in ``shard``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text).cast("long") + overhead).alias("size"), F.md5(text.cast("binary")).alias("group")
    )
    rows = stage(rows, "shard-rows")
    whole = rows.groupBy("group").agg((F.count("*") * F.max("size")).alias("_all")).where(F.col("_all") > capacity)
    whole = whole.select("group", F.ceil(F.col("_all") / (capacity // 2 + 1)).cast("int").alias("_pieces"))
    rows = rows.join(whole, "group", "left").withColumn(
        "key", F.concat("group", F.lit(":"), F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("_pieces")), F.lit(0)).cast("string"))
    )
    return join_groups(rows, pack(_items(rows), capacity), ["key"], "doc_id").select("doc_id", "size", F.col("bin").alias("shard"))


