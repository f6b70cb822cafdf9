"""Byte-level BPE through a lexicon of frequent words, and back.

Texts are cut into words as the tokenizers library does for such vocabularies: by
contractions, runs of letters, of digits and of other signs, each with one space
before it, and white space. The rules are applied to all characters of a slice of
texts at once; what is a letter, a digit or white space is asked once of the
library's own expressions, so that the Unicode version is the same. Added tokens
are found first and stand between words.

A first pass counts the words of all texts, and the most frequent ones, LEXICON at
most, of LONGEST bytes at most, become a minimal acyclic transducer whose outputs
lead to their ids (see ``lexicon``). It is written to the shared folder, handed to
every machine by Spark and mapped into memory there. The second pass sends all
words of a slice through the transducer; those it lacks are merged by the rules,
each different one of a slice once. The size of the lexicon changes speed, never
results.

Texts are read in slices of 2 MB; a longer one is cut where white space follows
another ASCII character, which is a border of words whatever stands around it.

Defined results: null and empty texts have no tokens; bytes that are no UTF-8 are
replaced by U+FFFD, as the library would be given them; rows with one id are rows
each; ids are of any integer type and returned as long, others are refused with a
TypeError; an empty table gives no rows. Ids that the vocabulary lacks decode to
nothing. Extra columns are dropped.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir
from .common import slices, stage, text_bytes, with_long
from .lexicon import LONGEST, compiled, mapped, merged_words, places, read_vocabulary

#: Words in the lexicon, at most.
LEXICON = 1 << 16
#: Bytes of text worked on at once, and different words a task counts before it passes them on.
SLICE_BYTES, COUNTED = 2 << 20, 1 << 18
#: Tokens decoded at once.
DECODED = 1 << 19

LETTER, DIGIT, SPACE, SIGN = range(4)
_BLANK, _QUOTE = 0x20, 0x27
#: What follows the sign ' in a contraction (fixed values).
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def character_classes() -> np.ndarray:
    """LETTER, DIGIT, SPACE or SIGN of every code point, by the expressions of the tokenizers library."""
    from tokenizers import Regex, pre_tokenizers

    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000])
    text = "".join(map(chr, points.tolist()))
    classes = np.full(0x110000, SIGN, np.uint8)
    for kind, expression in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
        # What is left between matches that are taken out.
        rest = np.zeros(len(points), bool)
        for _, (a, b) in pre_tokenizers.Split(Regex(expression), "removed").pre_tokenize_str(text):
            rest[a:b] = True
        classes[points[~rest]] = kind
    return classes


def word_starts(points: np.ndarray, kinds: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where words begin among the characters of texts that begin at ``edges`` (the last is the end)."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    begin = np.zeros(n + 1, bool)
    begin[edges] = True
    start = begin[:-1].copy()
    start[1:] |= kinds[1:] != kinds[:-1]
    # Of white space before a word the last character is left to it: a blank joins it, others stand alone.
    white = kinds == SPACE
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~begin[1:-1])
    start[last] = True
    start[last[points[last] == _BLANK] + 1] = False
    # Contractions begin at a sign ' that begins a word.
    quote = np.flatnonzero((points == _QUOTE) & start)
    ahead = lambda k: np.where(quote + k < n, points[np.minimum(quote + k, n - 1)], 0)
    within = np.ones(len(quote), bool)
    for k, letters in ((1, {c for c in CONTRACTIONS if len(c) == 1}), (2, {c for c in CONTRACTIONS if len(c) == 2})):
        within &= ~begin[np.minimum(quote + k, n)]
        for c in letters:
            hit = within.copy()
            for j, letter in enumerate(c):
                hit &= ahead(j + 1) == ord(letter)
            at = quote[hit]
            start[at + 1] = False
            after = at + 1 + k
            start[after[after < n]] = True
    return np.flatnonzero(start)


def _utf8(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, str | None]:
    """Texts' bytes as valid UTF-8, with offsets, and all of them as one string where there are other than ASCII characters."""
    if not (data & 0x80).any():
        return data, offsets, None
    raw = data.tobytes()
    try:
        whole = raw.decode()
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        if not ((data[inner] & 0xC0) == 0x80).any():
            return data, offsets, whole
    except UnicodeDecodeError:
        pass
    texts = [raw[a:b].decode(errors="replace").encode() for a, b in zip(offsets, offsets[1:], strict=False)]
    joined = b"".join(texts)
    return np.frombuffer(joined, np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]), joined.decode()


class Cutter:
    """Cuts texts into words and added tokens."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.classes = np.asarray(arrays["classes"])
        edges, pieces = arrays["piece_edges"], arrays["piece_bytes"].tobytes()
        self.special = {pieces[edges[i] : edges[i + 1]]: int(i) for i in arrays["special"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.find = re.compile(b"|".join(map(re.escape, longest_first))).finditer if longest_first else lambda _: ()

    def cut(self, data: np.ndarray, offsets: np.ndarray):
        """(bytes, offsets, starts, ends, ids): words in bytes, and the id of those that are added tokens, else -1."""
        data, offsets, text = _utf8(data, offsets)
        found = []
        for m in self.find(data.tobytes()):
            row = np.searchsorted(offsets, m.start(), side="right") - 1
            if m.end() <= offsets[row + 1]:  # else it only arises where two texts meet
                found.append((m.start(), m.end(), self.special[m.group()]))
        edges = np.union1d(offsets, np.array([e for a, b, _ in found for e in (a, b)], np.int64)) if found else offsets
        if text is None:
            starts = word_starts(data, self.classes[data], edges)
        else:
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            lead = np.flatnonzero((data & 0xC0) != 0x80)
            starts = lead[word_starts(points, self.classes[points], np.searchsorted(lead, edges))]
        ids = np.full(len(starts), -1, np.int64)
        if found:
            keep = np.ones(len(starts), bool)
            for a, b, i in found:
                low, high = np.searchsorted(starts, [a, b])
                keep[low + 1 : high] = False
                ids[low] = i
            starts, ids = starts[keep], ids[keep]
        return data, offsets, starts, np.append(starts[1:], len(data))[: len(starts)], ids


_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def parts(column, limit: int = SLICE_BYTES):
    """A column of texts as (first row, bytes, offsets), ``limit`` bytes at most; a longer text comes in parts of its own."""
    data, offsets = text_bytes(column)
    for a, b in slices(np.diff(offsets), limit):
        low, high = int(offsets[a]), int(offsets[b])
        if b - a > 1 or high - low <= limit:
            yield a, data[low:high], offsets[a : b + 1] - low
            continue
        while low < high:
            end = min(low + limit, high)
            while end < high:
                near = data[end - 1 : min(end + limit, high)]
                at = np.flatnonzero(_WHITE[near[1:]] & ~_WHITE[near[:-1]] & (near[:-1] < 0x80))
                if len(at):
                    end += int(at[0])
                    break
                end = min(end + limit, high)
            yield a, data[low:end], np.array([0, end - low])
            low = end


def _counts(cutter: Cutter):
    """(word, n) of a task's words of LONGEST bytes at most; a word comes more than once where there are very many."""

    def batch(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    def run(batches):
        seen: Counter = Counter()
        for b in batches:
            for _, data, offsets in parts(b.column(0)):
                data, _, starts, ends, ids = cutter.cut(data, offsets)
                own = (ids < 0) & (ends - starts <= LONGEST)
                raw = data.tobytes()
                seen.update([raw[a:e] for a, e in zip(starts[own].tolist(), ends[own].tolist(), strict=True)])
                if len(seen) > COUNTED:
                    yield batch(seen)
                    seen.clear()
        if seen:
            yield batch(seen)

    return run


def frequent_words(docs: DataFrame, cutter: Cutter, most: int = LEXICON) -> list[bytes]:
    """The frequent words of all texts, ``most`` at most, by falling frequency.

    Frequencies are rounded down to eight significant bits, and words of a level come
    all or none, so that the driver gets the number of words at each of some
    thousand levels, and then the chosen words.
    """
    counts = docs.select("text").mapInArrow(_counts(cutter), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = counts.where("n > 1").withColumn("bits", F.expr("greatest(0, length(bin(n)) - 8)"))
    counts = stage(counts.select("word", "n", F.expr("shiftleft(shiftright(n, bits), bits)").alias("level")), "word-counts")
    least, total = None, 0
    for row in counts.groupBy("level").agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():
        total += row.words
        if total > most:
            break
        least = row.level
    if least is None:
        return []
    words = counts.where(F.col("level") >= least).select("word", "n").collect()
    return [bytes(r.word) for r in sorted(words, key=lambda r: (-r.n, bytes(r.word)))]


def hand_out(spark: SparkSession, content: bytes) -> str:
    """Write a file to the shared folder and have Spark give it to every machine; the name under which workers find it."""
    name = f"lexicon-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(sc._jsc.hadoopConfiguration()).create(where)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    sc.addFile(path)
    return name


@cache
def _lexicon(name: str) -> dict[str, np.ndarray]:
    return mapped(SparkFiles.get(name))


def build(docs: DataFrame, vocabulary: str | None = None, most: int = LEXICON) -> str:
    """The lexicon of ``docs`` for the file ``vocabulary``, handed out to all machines; returns its name."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    arrays = read_vocabulary(vocabulary)
    classes = character_classes()
    words = frequent_words(docs, Cutter(arrays | {"classes": classes}), most)
    return hand_out(docs.sparkSession, compiled(arrays, words, classes))


def _gathered(pool: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Stretches of ``pool``, one after the other."""
    end = np.cumsum(length)
    total = int(end[-1]) if len(end) else 0
    return pool[np.repeat(begin - (end - length), length) + np.arange(total)] if total else pool[:0]


def token_ids(arrays: dict[str, np.ndarray], cutter: Cutter, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, and the n + 1 offsets of texts in them."""
    data, offsets, starts, ends, special = cutter.cut(data, offsets)
    place = places(arrays, data, starts, ends - starts)
    place[special >= 0] = -1
    begin, length = np.zeros(len(starts), np.int64), np.ones(len(starts), np.int64)
    known = place >= 0
    edges, pool = arrays["word_edges"], arrays["word_ids"]
    begin[known] = edges[place[known]]
    length[known] = edges[place[known] + 1] - begin[known]
    size = len(pool)
    unseen = np.flatnonzero(~known & (special < 0))
    raw, words = data.tobytes(), {}
    which = np.array([words.setdefault(raw[a:e], len(words)) for a, e in zip(starts[unseen].tolist(), ends[unseen].tolist(), strict=True)], np.int64)
    more = merged_words(arrays, list(words))
    counts = np.array([len(m) for m in more], np.int64)
    begin[unseen] = size + (np.cumsum(counts) - counts)[which]
    length[unseen] = counts[which]
    size += int(counts.sum())
    added = np.flatnonzero(special >= 0)
    begin[added] = size + np.arange(len(added))
    ids = _gathered(np.concatenate([pool, *more, special[added]]), begin, length)
    tokens = np.concatenate([[0], np.cumsum(length)])
    return ids.astype(np.uint32), tokens[np.searchsorted(starts, offsets)]


def piece_bytes(arrays: dict[str, np.ndarray], ids: np.ndarray) -> bytes:
    """What ``ids`` stand for, one after the other."""
    edges, out = arrays["piece_edges"], []
    for low in range(0, len(ids), DECODED):
        i = ids[low : low + DECODED].astype(np.int64)
        i = i[i < len(edges) - 1]
        out.append(_gathered(arrays["piece_bytes"], edges[i], edges[i + 1] - edges[i]).tobytes())
    return b"".join(out)


def _encoded(name: str, decode: bool):
    """Rows of (doc_id, n_tokens, ids[, decoded]); a row's parts are put together before the next row."""

    def run(batches):
        arrays = _lexicon(name)
        cutter = Cutter(arrays)
        for b in batches:
            ids, at, held, size = b.column(0), 0, [], 0

            def rows(ids=ids):
                columns = [ids.slice(at, len(held)), pa.array([len(x) // 4 for x in held], pa.int64()), pa.array(held, pa.binary())]
                names = ["doc_id", "n_tokens", "ids"]
                if decode:
                    columns.append(pa.array([piece_bytes(arrays, np.frombuffer(x, np.uint32)).decode(errors="replace") for x in held], pa.string()))
                    names.append("decoded")
                return pa.RecordBatch.from_arrays(columns, names)

            open_row: list[bytes] = []
            for first, data, offsets in parts(b.column(1)):
                if first > at + len(held):  # the long text before is whole
                    held.append(b"".join(open_row))
                    open_row = []
                if size + len(data) > SLICE_BYTES and held:
                    yield rows()
                    at, held, size = at + len(held), [], 0
                found, edges = token_ids(arrays, cutter, data, offsets)
                size += len(data)
                if len(offsets) == 2 and (len(data) >= SLICE_BYTES or open_row):
                    open_row.append(found.astype("<u4").tobytes())
                    continue
                held += [found[a:e].astype("<u4").tobytes() for a, e in zip(edges, edges[1:], strict=False)]
            if open_row:
                held.append(b"".join(open_row))
            if held:
                yield rows()

    return run


def encode(docs: DataFrame, lexicon: str, decode: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) of every text, ids as little-endian 32-bit numbers; ``decode`` adds the text they give."""
    docs = with_long(docs, "doc_id").select("doc_id", "text")
    return docs.mapInArrow(_encoded(lexicon, decode), "doc_id long, n_tokens long, ids binary" + (", decoded string" if decode else ""))


def decode(rows: DataFrame, lexicon: str) -> DataFrame:
    """(doc_id, decoded) of rows (doc_id, ids) as ``encode`` makes them; null ids give an empty text."""

    def run(batches):
        arrays = _lexicon(lexicon)
        for b in batches:
            texts = [piece_bytes(arrays, np.frombuffer(x or b"", "<u4")).decode(errors="replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")
