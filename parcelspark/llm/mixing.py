"""Mixing sources to target weights, in fixed-length blocks of words.

The words of each source, document after document, are packed into blocks of
``block_words``. Every output shard draws how many of its slots each source
gets from a multinomial with the target weights; the draws of a source are then
scaled, cumulatively over the shards, so that they add up to its target. Slot i
of a source is in epoch i // blocks, and a pseudorandom permutation of that
source's block numbers, another in each epoch, says which block it holds; slots
and blocks meet in a join by block number. In an epoch a block is taken once at
most, and targets stop at ``max_repeats`` epochs.

Only built-in functions are used. Nothing depends on partitions or the clock, so
that reruns agree. Sources (not documents) are ranked in one window.

Defined results: a null text has no words and is taken 0 times; a null source is
a source of its own, after all others; rows with the same id are rows of their
own; with no words at all every target is 0. Extra columns are dropped, or kept
by ``mixed_documents``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BUCKET_ROWS, buckets_for, running_total, stage

WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 12
#: Stretches of the drawn range, at most, and slots in one, at least.
STRETCHES, STRETCH = 1 << 16, 4096
#: Most rows of the sources' intervals that are broadcast (some 40 MB).
BROADCAST_ROWS = 1_000_000
#: Slots that one task makes, about.
TASK_SLOTS = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """A permutation of 0 .. n - 1: swap-or-not rounds keyed by ``key``."""

    def swap(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) - at, n)
        bit = F.xxhash64(F.lit("swap"), *key, r, F.greatest(at, other)).bitwiseAND(F.lit(1))
        return F.when(bit == 1, other).otherwise(at)

    return F.aggregate(F.array(*(F.lit(i) for i in range(ROUNDS))), x, swap)


@dataclass(frozen=True)
class Mix:
    """``rows``: a row a document with its place (src, start) in its source; ``sources``:
    src, source, source_size, weight, target, blocks; ``slots``: shard, src, slot, epoch, block."""

    rows: DataFrame
    sources: DataFrame
    slots: DataFrame
    block_words: int

    def segments(self) -> DataFrame:
        """(doc_id, src, start, size, block, first, words): each document's part in each block."""
        size, w = F.col("size"), self.block_words
        rows = self.rows.where("size > 0")
        blocks = F.sequence(F.expr(f"start div {w}"), F.expr(f"(start + size - 1) div {w}"))
        rows = rows.select("doc_id", "src", "start", "size", F.explode(blocks).alias("block"))
        first = F.greatest(F.col("start"), F.col("block") * w)
        last = F.least(F.col("start") + size, (F.col("block") + 1) * w)
        return rows.withColumn("first", first - F.col("start")).withColumn("words", last - first)

    def taken(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken) of every document."""
        takes = self.slots.groupBy("src", "block").agg(F.count("*").alias("times"))
        # Slots come from few rows and look small to the planner, whatever their number.
        parts = self.segments().join(takes.hint("merge"), ["src", "block"])
        taken = parts.groupBy("src", "start", "size").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        taken = self.rows.join(taken.hint("merge"), ["src", "start", "size"], "left")
        return taken.join(self.sources, "src").select(
            "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
        )


def sources_of(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_repeats: int = 3, block_words: int = 64) -> DataFrame:
    """A row a source: rank by code point (null last), size, weight, target and slots.

    Targets share the size of all sources by weight and stop at ``max_repeats``
    times the source's size. Sources stop in the order of that bound over
    weight, so that running sums in this order give the level at which the rest
    shares what is left.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    out = by_source.withColumn("src", rank)
    n = len(weights)
    out = out.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("src") % n + 1).cast("int")))
    out = out.withColumn("_bound", F.col("source_size") * max_repeats)
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    upto = W.orderBy(F.col("_bound") / F.col("weight"), "src").rowsBetween(W.unboundedPreceding, 0)
    total, weight = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    left = weight - F.sum("weight").over(upto)
    out = out.withColumns(
        {"_total": total, "_even": total / weight, "_level": F.when(left > 0, (total - F.sum("_bound").over(upto)) / left)}
    )
    level = F.greatest(F.col("_even"), F.max("_level").over(everything))
    target = F.least(F.col("_bound").cast("double"), level * F.col("weight"))
    out = out.withColumn("target", target).withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.greatest(F.lit(0.0), F.col("target") - epochs * F.col("source_size"))
    slots = F.least(epochs * F.col("blocks") + F.round(rest / block_words), F.col("blocks") * max_repeats)
    return out.withColumn("slots", slots.cast("long")).select(
        "src", "source", "source_size", "weight", "target", "blocks", "slots"
    )


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (1, 2, 3),
    max_repeats: int = 3,
    block_words: int = 64,
    shard_words: int = 1 << 20,
    seed: int = 7,
) -> Mix:
    spark = docs.sparkSession
    sizes = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    sources = stage(sources_of(sizes, weights, max_repeats, block_words), "mix-sources")
    n_buckets = buckets_for(sizes.count())
    names = sources.select("src", F.col("source").alias("_name"))
    rows = sizes.join(names, F.col("source").eqNullSafe(F.col("_name"))).drop("_name", "source")
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(n_buckets)).cast("int"))
    rows = running_total(rows, "src", "_bucket", ["doc_id", "size"], "size", "start").drop("_bucket")

    n_slots, n_sources = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count("*")).first()
    n_shards = max(1, -(-n_slots * block_words // shard_words))
    # Every slot of a shard is one draw; their counts by source are multinomial. A
    # draw finds its source's interval among those that touch the same stretch.
    stretch = max(STRETCH, -(-n_slots // STRETCHES))
    upto = F.sum("slots").over(W.orderBy("src").rowsBetween(W.unboundedPreceding, 0))
    intervals = sources.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("slots")).where("slots > 0")
    intervals = intervals.select("src", "_from", "_to", F.explode(F.expr(f"sequence(_from div {stretch}, (_to - 1) div {stretch})")).alias("_stretch"))
    # A source reaches into two stretches besides those that it fills.
    intervals = intervals.hint("broadcast" if STRETCHES + 2 * n_sources <= BROADCAST_ROWS else "merge")
    drawn = spark.range(n_slots).select(
        F.expr(f"id * {n_shards} div {max(n_slots, 1)}").alias("shard"),
        F.pmod(F.xxhash64(F.lit(seed), F.lit("slot"), "id"), F.lit(max(n_slots, 1))).alias("_u"),
    )
    drawn = drawn.withColumn("_stretch", F.expr(f"_u div {stretch}")).join(intervals, "_stretch").where("_u >= _from and _u < _to")
    counts = drawn.groupBy("src", "shard").agg(F.count("*").alias("n"))
    wanted = sources.where("slots > 0").select("src", "slots", "blocks")
    own = F.pmod(F.xxhash64(F.lit(seed), "src"), F.lit(n_shards))
    counts = wanted.join(counts, "src", "left").select(
        "src", "slots", "blocks", F.coalesce("shard", own).alias("shard"), F.coalesce("n", F.lit(1)).alias("n")
    )
    counts = stage(counts, "mix-counts")
    drawn_all = counts.groupBy("src").agg(F.sum("n").alias("_all"))
    counts = counts.withColumn("_stretch", F.expr(f"shard div {BUCKET_ROWS}"))
    counts = running_total(counts, "src", "_stretch", ["shard"], "n", "_before").join(drawn_all, "src")
    counts = counts.withColumn("_upto", F.col("_before") + F.col("n"))
    scaled = lambda x: F.expr(f"({x} * slots) div _all")
    counts = counts.withColumns({"_from": scaled("(_upto - n)"), "_to": scaled("_upto")}).where("_to > _from")
    # A few rows become all slots: they are dealt out first.
    counts = counts.repartition(max(1, -(-n_slots // TASK_SLOTS)), "src", "shard")
    slots = counts.select("shard", "src", "blocks", F.explode(F.expr("sequence(_from, _to - 1)")).alias("slot"))
    slots = slots.withColumn("epoch", F.expr("slot div blocks"))
    at = permuted(F.expr("slot % blocks"), F.col("blocks"), F.lit(seed), F.col("src"), F.col("epoch"))
    slots = slots.withColumn("block", at).drop("blocks")
    return Mix(rows, sources, slots, block_words)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """What the mix takes, as documents: a row for each document and epoch that takes of it.

    A document taken whole in an epoch keeps its text; one taken in part has the
    words of its taken blocks, joined by one space.
    """
    mixed = mix(docs, **options)
    parts = mixed.segments().join(mixed.slots.select("src", "block", "epoch").hint("merge"), ["src", "block"])
    parts = parts.groupBy("doc_id", "size", "start", "src", "epoch").agg(
        F.array_sort(F.collect_list(F.struct("first", "words"))).alias("parts"), F.sum("words").alias("taken")
    )
    # The row as one column: its names can't clash with those of the mix.
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id"))
    if not rows.groupBy("row.doc_id").count().where("count > 1").isEmpty():
        # Rows with one id are told apart by size and source; with these alike, either place in the source will do.
        rows = rows.withColumn("_n", word_count(F.col("row.text")))
        rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("row.doc_id").orderBy("_n", F.col("row.source").asc_nulls_last())))
        order = W.partitionBy("doc_id").orderBy("size", "src", "start")
        places = mixed.rows.withColumn("of", F.row_number().over(order)).select(
            F.col("src").alias("_src"), F.col("start").alias("_start"), F.col("size").alias("_size"), "of"
        )
        at = (F.col("src") == F.col("_src")) & (F.col("start") == F.col("_start")) & (F.col("size") == F.col("_size"))
        parts = parts.join(places, at)
        same = same & (F.col("nth") == F.col("of"))
    words = F.regexp_extract_all(F.col("row.text"), F.lit(f"({WORD})"), F.lit(0))
    # Bound by an outer lambda, the words are found once for a row and not once for each part.
    some = lambda w: F.flatten(F.transform("parts", lambda p: F.slice(w, p["first"].cast("int") + 1, p["words"].cast("int"))))
    part = F.array_join(F.get(F.transform(F.array(words), some), F.lit(0)), " ")
    text = F.when(F.col("taken") == F.col("size"), F.col("row.text")).otherwise(part)
    out = rows.join(parts.hint("merge"), same).withColumn("new_text", text)
    new = {"text": F.col("new_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("new_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
