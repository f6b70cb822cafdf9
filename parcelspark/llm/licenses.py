"""License scans by diagonal voting over word k-grams.

Hashes of all rolling word k-grams of every text are looked up among those of
the templates; each hit is a place (i in the document, j in the template) and
votes for the diagonal i - j. Votes are added up by document, template and
diagonal, neighbouring diagonals (a word put in or left out) are merged, and a
merged span is verified by the share of the template's words that its hits,
whose words are compared and not only their hashes, cover.

Templates are rows of a table (label, text): ``license_texts`` has whole public
licenses and notices, and ``scan`` takes any other table of TEMPLATE_BYTES of text
at most. Their k-grams are the broadcast side, and do not grow with the documents.

Defined results: null and empty texts have no words and no labels; a row is
known by its id and its text, so that rows with the same id are scanned each on
its own, and exact repeats of a row get the same result; texts of any length are
scanned whole. Extra columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import gram_hashes, span_hashes, stage, text_slices, words_of
from .license_texts import TEXTS

K = 3

# Phrases whose every place counts, and their labels.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

#: Bytes of templates that are sent to tasks, at most.
TEMPLATE_BYTES = 16 << 20

_GAP = np.ones(256, bool)
_GAP[ord("0") : ord("9") + 1] = _GAP[ord("a") : ord("z") + 1] = _GAP[ord("A") : ord("Z") + 1] = _GAP[128:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _tokens(data: np.ndarray, offsets: np.ndarray):
    data = _LOWER[data]
    starts, ends, of = words_of(data, offsets, _GAP)
    return data, starts, ends, of


def _text_tokens(text: str):
    raw = np.frombuffer(text.encode(), np.uint8)
    return _tokens(raw, np.array([0, len(raw)]))


def template_grams(templates) -> list[tuple[int, str, int, int, int, str]]:
    """(template, label, number of words, j, hash, gram) of every template position."""
    out = []
    for t, (label, text) in enumerate(templates):
        data, starts, ends, _ = _text_tokens(text)
        words = [bytes(data[s:e]).decode() for s, e in zip(starts, ends, strict=True)]
        for j, h in enumerate(gram_hashes(span_hashes(data, starts, ends), K)):
            out.append((t, label, len(words), j, int(h.astype(np.int64)), " ".join(words[j : j + K])))
    return out


def gram_hits(docs: DataFrame, grams: list) -> DataFrame:
    """(doc_id, text_hash, n_words, hits array<struct<i, hash, gram>>): the rolling k-grams of each text that a template has."""
    known = np.unique(np.array([g[4] for g in grams], np.int64).view(np.uint64))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    hit = pa.struct([("i", pa.int32()), ("hash", pa.int64()), ("gram", pa.string())])

    def run(batches):
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column("text")], ["at", "text"])
            for at, data, offsets in text_slices([texts]):
                data, starts, ends, of = _tokens(data, offsets)
                hashes = gram_hashes(span_hashes(data, starts, ends), K)
                found = np.flatnonzero(np.isin(hashes, known))
                found = found[of[found] == of[found + K - 1]] if len(found) else found
                first = np.searchsorted(of, np.arange(len(offsets)))
                hits = [
                    {"i": int(p - first[of[p]]), "hash": int(hashes[p].astype(np.int64)), "gram": b" ".join(bytes(data[starts[q] : ends[q]]) for q in range(p, p + K)).decode()}
                    for p in found
                ]
                lists = np.searchsorted(of[found], np.arange(len(offsets))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(at),
                        batch.column("text_hash").take(at),
                        pa.array(np.diff(first).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(lists), pa.array(hits, hit)),
                    ],
                    ["doc_id", "text_hash", "n_words", "hits"],
                )

    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, n_words long, hits array<struct<i: int, hash: long, gram: string>>")


def spans(hits: DataFrame, grams: list, slack: int = 2) -> DataFrame:
    """(doc_id, text_hash, template, label, start, end, share): merged diagonals and the share of template words they cover."""
    spark = hits.sparkSession
    positions = spark.createDataFrame(grams, "template int, label string, length int, j int, hash long, gram string")
    each = hits.select("doc_id", "text_hash", F.explode("hits").alias("x")).select("doc_id", "text_hash", "x.*").distinct()
    votes = each.join(F.broadcast(positions), ["hash", "gram"])
    row = ["doc_id", "text_hash", "template", "label", "length"]
    diagonal = votes.groupBy(*row, (F.col("i") - F.col("j")).alias("d")).agg(
        F.min("i").alias("start"), (F.max("i") + K).alias("end"), F.collect_set("j").alias("js")
    )
    # A diagonal continues the one before it if it is near and its span begins near that one's end.
    by = W.partitionBy("doc_id", "text_hash", "template").orderBy("d")
    apart = (F.col("d") - F.lag("d").over(by) > slack) | (F.col("start") > F.lag("end").over(by) + slack)
    run = F.sum(F.when(F.coalesce(apart, F.lit(True)), 1).otherwise(0)).over(by.rowsBetween(W.unboundedPreceding, 0))
    merged = diagonal.withColumn("run", run).groupBy(*row, "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.flatten(F.collect_list("js")).alias("js")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("js", lambda j: F.sequence(j, j + K - 1)))))
    return merged.withColumn("share", covered / F.col("length")).drop("js", "run", "length")


def places(hits: DataFrame, grams: list) -> DataFrame:
    """(doc_id, text_hash, template, label, start): places at which all words of a template stand in a row."""
    spark = hits.sparkSession
    positions = spark.createDataFrame(grams, "template int, label string, length int, j int, hash long, gram string")
    each = hits.select("doc_id", "text_hash", F.explode("hits").alias("x")).select("doc_id", "text_hash", "x.*").distinct()
    votes = each.join(F.broadcast(positions), ["hash", "gram"])
    whole = votes.groupBy("doc_id", "text_hash", "template", "label", "length", (F.col("i") - F.col("j")).alias("start")).count()
    return whole.where(F.col("count") == F.col("length") - K + 1).drop("count", "length")


def license_table(spark: SparkSession) -> DataFrame:
    """The templates as a table (label, text)."""
    return spark.createDataFrame(list(TEXTS), "label string, text string")


def scan(docs: DataFrame, templates: DataFrame | None = None, phrases=PHRASES, least_share: float = 0.75) -> DataFrame:
    """Per document: words, places of phrases, labels from both, and the best verified share as its score."""
    templates = license_table(docs.sparkSession) if templates is None else templates
    templates = templates.where("text is not null").select("label", "text")
    if (templates.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > TEMPLATE_BYTES:
        raise ValueError(f"more than {TEMPLATE_BYTES} bytes of templates: scan the documents with a part of them at a time")
    known = [tuple(r) for r in templates.collect()]
    short = [label for label, text in (*phrases, *known) if len(_text_tokens(text)[1]) < K]
    if short:
        raise ValueError(f"templates of fewer than {K} words have no gram: {short}")
    base, more = template_grams(phrases), template_grams(known)
    rows = stage(gram_hits(docs, base + more), "license-hits")
    hits = rows.where(F.size("hits") > 0)
    exact = places(hits, base).groupBy("doc_id", "text_hash").agg(
        F.count("*").alias("n_base"), F.min("start").alias("first_word"), F.max("start").alias("last_word"), F.collect_set("label").alias("base")
    )
    near = spans(hits, more).where(F.col("share") >= least_share).groupBy("doc_id", "text_hash").agg(
        F.collect_set("label").alias("more"), F.max("share").alias("share")
    )
    none = F.array().cast("array<string>")
    out = rows.drop("hits")
    for i, found in enumerate((exact, near)):
        found = found.withColumnsRenamed({"doc_id": f"_id{i}", "text_hash": f"_hash{i}"})
        same = F.col("doc_id").eqNullSafe(F.col(f"_id{i}")) & F.col("text_hash").eqNullSafe(F.col(f"_hash{i}"))
        out = out.join(found, same, "left")
    joined = lambda *lists: F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.coalesce(x, none) for x in lists)))), ",")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        joined(F.col("base")).alias("base_labels"),
        joined(F.col("base"), F.col("more")).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.least(F.coalesce("share", F.lit(0.0)), F.lit(1.0))).alias("score"),
    )
