"""Benchmark decontamination by winnowing, in built-in functions alone.

A fingerprint is the least hash of a k-gram of words in a sliding window of
``window - k + 1`` of them, so that any span of ``window`` words that a document
shares with a benchmark item holds a fingerprint of both. Documents none of
whose k-grams is a benchmark fingerprint are done after one pass; the
fingerprints of the others are joined to the benchmark's, and each hit is
extended: the windows around it are compared word for word with the item's.

The benchmark is the small side. Its windows are counted, with the bytes of
their words and item ids, before they are broadcast; above ``BROADCAST_ROWS`` or
``BROADCAST_BYTES`` the same joins shuffle.

Defined results: null and empty texts have no words, no hits and are not
contaminated; a null or empty item has no windows; an item of fewer words than
``window`` is one window; an item without id hits words as others do, but has no
name to be listed or counted by; rows with the same id are judged together where
their texts differ (their hits are united) and each returns a row; an empty
benchmark hits nothing. Extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a k-gram.
K = 4
#: Most rows, and bytes of windows and ids, of the benchmark's side that are broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def words(text: Column) -> Column:
    """Lower-cased (A-Z alone) words of a text; none for null."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"({WORD})"), F.lit(0)), F.array().cast("array<string>"))


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _pairs(values: Column, n: int, f) -> Column:
    """``f`` of each value and the one ``n`` further on."""

    def zipped(v: Column) -> Column:
        left = F.greatest(F.size(v) - n, F.lit(0))
        return F.zip_with(F.slice(v, F.lit(1), left), F.slice(v, F.lit(n + 1), left), f)

    return _once(values, zipped)


def grams(tokens: Column) -> Column:
    """Hashes of all K-grams of words, each at its first word."""
    both = lambda a, b: F.xxhash64(a, b)
    return _pairs(_pairs(F.transform(tokens, lambda w: F.xxhash64(w)), 1, both), 2, both)


def fingerprints(hashes: Column, width: int) -> Column:
    """The least hash of each window of ``width`` hashes, once each."""
    low, done = hashes, 1
    while done < width:
        step = min(done, width - done)
        low = _pairs(low, step, lambda a, b: F.least(a, b))
        done += step
    return F.array_distinct(low)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated) of every document.

    A word is hit if an occurrence of one of an item's windows covers it; a
    document is contaminated if one word in ``share``, at least one, is hit.
    """
    width = window - K + 1
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    items = stage(items, "decontaminate-items")
    n = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(0), F.size("w") - n)
    spans = items.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s + 1, n))).alias("span"))
    spans = spans.groupBy("span").agg(F.collect_set("item_id").alias("item_ids"))
    spans = stage(spans, "decontaminate-spans")
    bytes_ = F.sum(F.octet_length(F.array_join("span", " ")) + 16 * F.size("span") + 16 * F.size("item_ids"))
    n_spans, n_bytes = spans.agg(F.count("*"), F.coalesce(bytes_, F.lit(0))).first()
    small = n_spans <= BROADCAST_ROWS and n_bytes <= BROADCAST_BYTES
    held = (lambda df: F.broadcast(df)) if small else (lambda df: df)

    # Fingerprints of whole windows; of a shorter item, its first K-gram or first word.
    whole = lambda span: fingerprints(grams(span), width)
    long = spans.where(F.size("span") == window).select(F.explode(whole(F.col("span"))).alias("mark")).distinct()
    short = spans.where(F.size("span") < window)
    lengths = [r[0] for r in short.select(F.size("span")).distinct().toLocalIterator()]
    n = F.size("span")
    marks = spans.select(F.explode(F.when(n == window, whole(F.col("span"))).when(n >= K, F.slice(grams(F.col("span")), 1, 1))).alias("mark")).distinct()
    first_words = spans.where(n < K).select(F.get("span", F.lit(0)).alias("mark")).distinct()

    # One pass over the texts. Words are those of words(): lower() of a capital sigma depends on its neighbours.
    tokens = F.split(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), GAP)
    edge = lambda i: F.when(F.get("_w", i) == "", 1).otherwise(0)
    n_words = F.size("_w") - edge(F.lit(0)) - F.when(F.size("_w") > 1, edge(F.size("_w") - 1)).otherwise(0)
    seen = docs.select("doc_id", "text", tokens.alias("_w")).withColumn("n_words", n_words.cast("long"))
    if small:
        in_marks = F.coalesce(F.arrays_overlap(grams(F.col("_w")), marks.agg(F.collect_set("mark")).scalar()), F.lit(False))
        if any(m < K for m in lengths):
            in_marks = in_marks | F.arrays_overlap("_w", first_words.agg(F.collect_set("mark")).scalar())
        seen = seen.withColumn("_near", in_marks)
    else:
        parts = seen.select("doc_id", F.explode(F.array_distinct(grams(F.col("_w")))).alias("mark"))
        near = parts.join(marks, "mark", "left_semi").select("doc_id")
        if any(m < K for m in lengths):
            by_word = seen.select("doc_id", F.explode(F.array_distinct("_w")).alias("mark"))
            near = near.union(by_word.join(first_words, "mark", "left_semi").select("doc_id"))
        near = near.distinct().select(F.col("doc_id").alias("near_id"), F.lit(True).alias("_near"))
        seen = seen.drop("_w").join(near, F.col("doc_id").eqNullSafe(F.col("near_id")), "left").withColumn("_near", F.coalesce("_near", F.lit(False)))
    seen = seen.select("doc_id", "n_words", F.when(F.col("_near"), F.col("text")).alias("text"))
    seen = stage(seen, "decontaminate-seen")

    # Equal texts are extended once, and known by a digest: what is exploded never carries a text's words.
    near = seen.where("text is not null").select(F.md5(F.col("text").cast("binary")).alias("key"), "text").dropDuplicates(["key"])
    near = stage(near.select("key", words(F.col("text")).alias("w")), "decontaminate-near")

    def beside(places: DataFrame, value: str) -> DataFrame:
        """``near`` with the sorted places (s, value) of each text."""
        places = places.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("s", value))).alias("places"))
        return near.join(places.hint("merge"), "key")

    # Windows that hold a K-gram with a fingerprint that text and item share.
    hashes = grams(F.col("w"))
    shared = near.select("key", F.explode(fingerprints(hashes, width)).alias("mark")).join(held(long), "mark").distinct()
    at = near.select("key", F.posexplode(hashes).alias("s", "mark")).join(shared.hint("merge"), ["key", "mark"])
    around = lambda p: F.sequence(F.greatest(p["s"] - (window - K), F.lit(0)), F.least(p["s"], F.size("w") - window))
    starts = F.array_distinct(F.flatten(F.transform("places", around)))
    found = beside(at, "mark").where(F.size("w") >= window)
    found = found.select("key", F.explode(F.transform(starts, lambda s: F.struct(s.alias("s"), F.slice("w", s + 1, window).alias("span")))).alias("x"))
    hits = found.select("key", "x.s", "x.span").join(held(spans), "span").select("key", "s", F.lit(window).alias("n"), "item_ids")
    if lengths:
        # Shorter items: their first word is looked up at every word, and the words from there are compared.
        heads = short.select(F.get("span", F.lit(0)).alias("head"), "span", "item_ids")
        at = near.select("key", F.posexplode("w").alias("s", "head")).join(held(heads.select("head").distinct()), "head", "left_semi")
        each = beside(at, "head").select("key", F.explode(F.transform("places", lambda p: F.struct(p["s"], p["head"], F.slice("w", p["s"] + 1, max(lengths)).alias("next")))).alias("x"))
        each = each.select("key", "x.*").join(held(heads), "head").where(F.slice("next", F.lit(1), F.size("span")) == F.col("span"))
        hits = hits.union(each.select("key", "s", F.size("span").alias("n"), "item_ids"))
    texts = seen.where("text is not null").select("doc_id", F.md5(F.col("text").cast("binary")).alias("key")).distinct()
    hits = hits.groupBy("key").agg(F.collect_set(F.struct("s", "n")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("items"))
    # Rows with one id are judged together.
    hits = texts.join(hits.hint("merge"), "key").groupBy("doc_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    )
    reach = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(
            F.greatest(a["end"], x["s"] + x["n"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), x["s"] + x["n"] - F.greatest(a["end"], x["s"]))).cast("long").alias("n"),
        ),
        lambda a: a["n"],
    )
    hits = hits.select("doc_id", reach.alias("n_hit"), F.array_sort(F.transform("items", lambda i: i.cast("string"))).alias("items"))
    hits = hits.withColumnRenamed("doc_id", "hit_id")
    out = seen.select("doc_id", "n_words").join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left")
    out = out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long"))
    out = out.withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        "items",
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated."""
    dirty = decontaminate(docs, benchmark, **options).where("contaminated").select(F.col("doc_id").alias("_id")).distinct()
    dirty = stage(dirty, "decontaminate-dirty")
    return docs.join(dirty, docs["doc_id"].eqNullSafe(dirty["_id"]), "left_anti")
