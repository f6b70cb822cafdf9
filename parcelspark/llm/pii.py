"""Personal data: fixed patterns, and bootstrapped contextual extraction.

Emails, IP addresses, card and phone numbers are found by fixed patterns. They
seed the bootstrap: what stands around an identifier-like string are its lexical
patterns, and each pattern is linked to the different strings (instances) that
stand in it. Patterns are the two words on the left, on the right, or one on each
side; one word on either side with the string's shape; and a label before it
("name:", "name =", "name#") with its shape. Round by round, a pattern is worth
the lower bound (Wilson's, at Z) of the share of its instances that score for a
kind (seeds have 1; an unknown string counts as UNKNOWN against it, a seed of
another kind fully), and an instance is worth the chance that at least one of its
trusted patterns is right. Strings that no fixed pattern finds, but that score
high, are spans of that kind too.

The pattern-instance graph is a table of Spark; sums are combined before every
shuffle, and every round cuts the lineage. A pattern of very many strings, and a
string of very many patterns or places, are dealt by salts to many tasks, and
neither is broadcast. A pattern needs several different
seeds to be trusted. Contexts of all texts count, and words of any length.

Defined results: null and empty texts have no spans; positions are code points;
a row is known by its id and text, so that rows with the same id are scanned
each on its own and exact repeats get the same result. Extra columns are dropped.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, salts_of, stage

#: Normal quantile of a pattern's lower bound, and what an unknown instance counts against a pattern.
Z, UNKNOWN = 1.64, 0.5
#: Characters of a word that a pattern holds as it is.
LONG = 64
KINDS = ("email", "ip", "card", "phone")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does: the look-behind says so, and
# keeps the search linear in very long runs.
_IP = re.compile(r"[0-9](?<![0-9]{2})[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?<![0-9]{2})(?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Strings that may be identifiers: numbers with separators, and words with an at sign.
_NUMBER = re.compile(r"\(?[0-9](?<![0-9]{2})(?:[\x20().-]{0,2}[0-9])++")
#: Of any length; a match can only begin where a run does, so that the search is linear.
_AT = re.compile(r"(?<![^\s@])[^\s@]++@[^\s@]++")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str):
    done = low = 0
    at = text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(_LOCAL))
        found = _DOMAIN.match(text, at) if start < at else None
        done = found.end() if found else at + 1
        if found:
            yield start, done
        low = done
        at = text.find("@", done)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def find(text: str) -> list[tuple[int, int, int]]:
    """(place of the kind in KINDS, start, end) of all matches of the fixed patterns, kind by kind."""
    out = [(0, s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def spans_text(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


_WORD = re.compile(r"\w+")
_LABEL = re.compile(r"\s*[:=#]\s*[\"'(]*")


def shape(value: str) -> str:
    """A string's kinds of characters: runs of digits with their length, runs of letters, and all others as they are."""
    digits = re.sub(r"[0-9]+", lambda m: f"9{len(m[0])}", re.sub(r"[^\W0-9_]+", "a", value))
    return digits if len(digits) <= LONG else _short(digits)


def _short(word: str) -> str:
    """The word, or what stands for a very long one."""
    return word if len(word) <= LONG else "#" + hashlib.md5(word.encode()).hexdigest()


class Contexts:
    """The words of a text, and the patterns around a string in it."""

    def __init__(self, text: str):
        self.text = text
        self.words = [m.span() for m in _WORD.finditer(text)]
        self.starts = [s for s, _ in self.words]

    def around(self, start: int, end: int) -> list[str]:
        low, high = bisect.bisect_left(self.starts, start), bisect.bisect_left(self.starts, end)
        word = lambda i: _short(self.text[slice(*self.words[i])].lower())
        left = [word(i) for i in range(max(0, low - 2), low)]
        right = [word(i) for i in range(high, min(high + 2, len(self.words)))]
        kind = shape(self.text[start:end])
        out = []
        if left:
            out.append(f"l1 {left[-1]} {kind}")
            if _LABEL.fullmatch(self.text, self.words[low - 1][1], start):
                out.append(f"label {left[-1]} {kind}")
        if right:
            out.append(f"r1 {right[0]} {kind}")
        if len(left) == 2:
            out.append("l2 " + " ".join(left))
        if left and right:
            out.append(f"lr {left[-1]} {right[0]}")
        if len(right) == 2:
            out.append("r2 " + " ".join(right))
        return out


def candidates(text: str, base: list) -> list[dict]:
    """Identifier-like strings with their contexts; a seed has its kind, others -1."""
    found = [(s, e, k) for k, s, e in base]
    taken = [(s, e) for _, s, e in base]
    taken.sort()
    for finder in (_NUMBER, _AT):
        place = 0
        for m in finder.finditer(text):
            s, e = m.span()
            if finder is _NUMBER and not 7 <= len(_digits(m[0])) <= 19:
                continue
            while place < len(taken) and taken[place][1] <= s:
                place += 1
            if place < len(taken) and taken[place][0] < e:
                continue
            if (s and text[s - 1].isalnum()) or (e < len(text) and text[e].isalnum()):
                continue
            found.append((s, e, -1))
    contexts = Contexts(text) if found else None
    return [{"start": s, "end": e, "kind": k, "value": text[s:e], "patterns": contexts.around(s, e)} for s, e, k in found]


_ENTITY = "start: int, end: int, kind: int, value: string, patterns: array<string>"


def entities(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, found array<struct>): the fixed patterns' matches and other candidates of every whole text."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    entity = pa.struct(
        [("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))]
    )

    def run(batches):
        for batch in batches:
            found = []
            for text in batch.column("text"):
                text = text.as_py()
                found.append(candidates(text, find(text)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(found, pa.list_(entity))], ["doc_id", "text_hash", "found"]
            )

    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, found array<struct<{_ENTITY}>>")


def lower_bound(share: Column, n: Column, z: float = Z) -> Column:
    """Wilson's lower bound of a share of ``n``."""
    return (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def bootstrap(found: DataFrame, rounds: int = 3, least_seeds: int = 5, trust: float = 0.7, least_score: float = 0.9) -> DataFrame:
    """(value, kind): strings that trusted patterns discover, from (value, kind, patterns) of all entities.

    A pattern is trusted for a kind from ``least_seeds`` different seeds and a
    worth of ``trust`` on, and a string found from a score of ``least_score`` on.
    """
    edges = found.select("value", F.explode("patterns").alias("pattern")).distinct()
    edges = stage(edges, "pii-edges")
    # A string of many patterns, and a pattern of many strings, are many tasks' work.
    held = stage(edges.groupBy("value").agg(salts_of("pattern").alias("salts")), "pii-held")
    around = lambda strings: join_groups(edges, strings.join(held.hint("merge"), "value"), ["value"], "pattern")
    seeds = found.where("kind >= 0").select("value", "kind").distinct().withColumn("score", F.lit(1.0))
    scores = seeds = stage(seeds, "pii-seeds")
    # Patterns without enough seeds of a kind are never trusted: they are left out once and for all.
    able = around(seeds).groupBy("pattern", "kind").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= least_seeds)
    size = edges.groupBy("pattern").agg(F.count("*").alias("n"), salts_of("value").alias("salts"))
    able = stage(able.join(size.hint("merge"), "pattern"), "pii-able")
    edges = stage(join_groups(edges, able.select("pattern", "salts").distinct(), ["pattern"], "value"), "pii-edges")
    n_seeds = around(seeds.select("value").distinct()).groupBy("pattern").agg(F.count("*").alias("n_seeds"))
    able = stage(able.join(n_seeds.hint("merge"), "pattern"), "pii-able")
    for _ in range(rounds):
        got = around(scores).groupBy("pattern", "kind").agg(F.sum("score").alias("got"))
        worth = got.join(able.hint("merge"), ["pattern", "kind"])
        unknown = F.col("n") - F.col("n_seeds") - (F.col("got") - F.col("seeds"))
        judged = F.col("n_seeds") + (F.col("got") - F.col("seeds")) + UNKNOWN * unknown
        worth = worth.withColumn("worth", lower_bound(F.col("got") / judged, judged)).where(F.col("worth") >= trust)
        doubts = join_groups(edges, worth.select("pattern", "kind", "worth", "salts"), ["pattern"], "value")
        doubt = doubts.groupBy("value", "kind").agg(F.sum(F.log1p(-F.col("worth"))).alias("doubt"))
        new = doubt.select("value", "kind", F.round(1 - F.exp("doubt"), 9).alias("score"))
        scores = stage(new.union(seeds).groupBy("value", "kind").agg(F.max("score").alias("score")), "pii-scores")
    best = scores.where(F.col("score") >= least_score).groupBy("value").agg(F.min_by("kind", F.struct(-F.col("score"), F.col("kind"))).alias("kind"))
    return best.join(seeds.select("value").distinct().hint("merge"), "value", "left_anti")


def scan(docs: DataFrame, **options) -> DataFrame:
    """Per document: counts by kind, base spans and all spans as text."""
    rows = stage(entities(docs), "pii-entities")
    each = rows.where(F.size("found") > 0).select("doc_id", "text_hash", F.explode("found").alias("x")).select("doc_id", "text_hash", "x.*")
    named = bootstrap(each, **options).withColumnRenamed("kind", "new_kind")
    strings = each.where("kind < 0")
    stands = strings.groupBy("value").agg(salts_of("doc_id").alias("salts"))
    more = join_groups(strings, named.join(stands.hint("merge"), "value"), ["value"], "doc_id").distinct()
    more = more.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set(F.struct(F.col("new_kind").alias("kind"), "start", "end"))).alias("more")
    )
    more = more.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    base = F.transform(F.filter("found", lambda x: x["kind"] >= 0), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    out = rows.select("doc_id", "text_hash", base.alias("base"))
    out = out.join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    every = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    names = F.array(*(F.lit(k) for k in KINDS))
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return out.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), text(F.col("base")).alias("base_spans"), text(every).alias("spans"))


