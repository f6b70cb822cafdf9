"""Quality classifier: regularised quadratic discriminant over document statistics.

Every document gives a short vector of statistics of its whole text. Each class
of labelled documents has a mean and a covariance shrunk towards its diagonal;
a document's score is the logistic of the difference of the two Gaussian log
densities, whose Mahalanobis distances use Cholesky factors computed once.

The counts, sums and products that the fit needs are added up by Spark over all
labelled rows; only two fixed-size moment matrices reach the driver.

Defined results: a null text counts as empty; an empty text has the statistics
of no words and gets a score like any other; rows with the same id are scored
each on its own; labels that are null, or other than 0 and 1, are ignored, as
is a label whose document is missing; with one class only, or none, every score
is that class's share (0.5 without labels). Extra columns are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import span_hashes, stage, text_slices, words_of

STATISTICS = (
    "log_bytes", "log_words", "word_length", "short_words", "long_words", "upper", "digits", "bars", "bangs", "symbols",
    "stops", "line_breaks", "beyond_ascii", "distinct_words", "echoed_words", "repeated_lines", "plain_words", "line_length",
)
D = len(STATISTICS)

_UPPER, _DIGIT, _BAR, _BANG, _SYMBOL, _STOP, _BREAK, _HIGH = range(8)
#: Usual shares of these kinds of bytes in prose, and how much reading they stand for.
USUAL_BYTES = {_UPPER: 0.02, _DIGIT: 0.002, _BAR: 0.0005, _BANG: 0.0005, _SYMBOL: 0.001, _STOP: 0.02, _BREAK: 0.006, _HIGH: 0.03}
PRIOR_WORDS, PRIOR_BYTES, PRIOR_LINES = 20, 120, 1
_KIND = np.full(256, 8, np.uint8)
_KIND[ord("A") : ord("Z") + 1] = _UPPER
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_KIND[ord("|")] = _BAR
_KIND[ord("!")] = _BANG
_KIND[[ord(c) for c in "#$%&*~^<>{}[]=_\\@+/"]] = _SYMBOL
_KIND[[ord(c) for c in ".,;:?"]] = _STOP
_KIND[ord("\n")] = _BREAK
_KIND[128:] = _HIGH
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[ord("A") : ord("Z") + 1] = _LETTER[128:] = True
_NOT_BREAK = np.zeros(256, bool)
_NOT_BREAK[ord("\n")] = True


def _distinct(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Number of different hashes in each row."""
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return np.bincount(r[new], minlength=n).astype(float)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Transformed statistics, a row a document."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    row = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(row * 9 + _KIND[data], minlength=9 * n).reshape(n, 9).astype(float)
    starts, ends, of = words_of(data, offsets)
    length = ends - starts
    words = np.bincount(of, minlength=n).astype(float)
    # Shares are drawn to usual values as if PRIOR_WORDS, or PRIOR_BYTES, more had been read: those of a few words say little.
    per_word = lambda mask, usual: (np.bincount(of[mask], minlength=n) + usual * PRIOR_WORDS) / (words + PRIOR_WORDS)
    hashes = span_hashes(data, starts, ends)
    echo = np.zeros(len(starts), bool)
    echo[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    plain = letters[ends] - letters[starts] >= length - 1
    l_starts, l_ends, l_of = words_of(data, offsets, _NOT_BREAK)
    lines = np.bincount(l_of, minlength=n).astype(float)
    other_lines = _distinct(l_of, span_hashes(data, l_starts, l_ends), n)
    share = lambda k: np.log((kinds[:, k] + USUAL_BYTES[k] * PRIOR_BYTES) / (size + PRIOR_BYTES))
    return np.column_stack(
        [
            np.log1p(size),
            np.log1p(words),
            np.log1p((size - kinds[:, _BREAK] + 6 * PRIOR_WORDS) / (words + PRIOR_WORDS)),
            per_word(length <= 3, 0.4),
            per_word(length >= 14, 0.04),
            *(share(k) for k in (_UPPER, _DIGIT, _BAR, _BANG, _SYMBOL, _STOP, _BREAK)),
            np.sqrt((kinds[:, _HIGH] + USUAL_BYTES[_HIGH] * PRIOR_BYTES) / (size + PRIOR_BYTES)),
            np.log((_distinct(of, hashes, n) + PRIOR_WORDS) / (words + PRIOR_WORDS)),
            np.log(per_word(echo, 0.01)),
            np.log((other_lines + 2) / (lines + 2)),
            per_word(plain, 0.97),
            np.log1p((size + 150 * PRIOR_LINES) / (lines + PRIOR_LINES)),
        ]
    )


def with_statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, x array<double>): the statistics of every document."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for ids, data, offsets in text_slices(batches):
            flat = statistics(data, offsets).ravel()
            x = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, D, dtype=np.int32), pa.array(flat))
            yield pa.RecordBatch.from_arrays([ids, x], ["id", "x"])

    return rows.mapInArrow(run, f"id {kind}, x array<double>")


@dataclass(frozen=True)
class QuadraticDiscriminant:
    """Per class: share, mean and the inverse Cholesky factor of the covariance."""

    shares: tuple
    means: tuple
    factors: tuple
    log_dets: tuple
    temper: float

    @classmethod
    def fit(cls, labelled: DataFrame, shrink: float = 0.05, temper: float = 1.0) -> QuadraticDiscriminant:
        """``labelled`` has (x, label). ``shrink``: weight of the covariance's diagonal.

        ``temper`` scales the log-density difference; statistics are correlated
        in ways that Gaussians miss, and a value below 1 keeps scores graded.
        """

        def moments(batches):
            total = {c: np.zeros((D + 1, D + 1)) for c in (0, 1)}
            for batch in batches:
                x = np.asarray(batch.column("x").flatten()).reshape(-1, D)
                y = np.asarray(batch.column("label"))
                x = np.column_stack([np.ones(len(x)), x])
                for c in total:
                    total[c] += x[y == c].T @ x[y == c]
            yield pa.RecordBatch.from_pydict(
                {
                    "label": np.repeat(np.array([0, 1], np.int32), (D + 1) ** 2),
                    "i": np.tile(np.arange((D + 1) ** 2, dtype=np.int32), 2),
                    "v": np.concatenate([total[0].ravel(), total[1].ravel()]),
                }
            )

        parts = labelled.where("label in (0, 1)").select("x", F.col("label").cast("int").alias("label"))
        parts = parts.mapInArrow(moments, "label int, i int, v double")
        # Added as whole multiples of 2**-16: the sum is the same in any order.
        exact = F.sum(F.round(F.col("v") * 65536).cast("decimal(38,0)")).cast("double") / 65536
        sums = np.zeros((2, (D + 1) ** 2))
        for row in parts.groupBy("label", "i").agg(exact.alias("v")).toLocalIterator():
            sums[row.label, row.i] = row.v
        sums = sums.reshape(2, D + 1, D + 1)
        counts = sums[:, 0, 0]
        shares = tuple((counts + 0.5) / (counts.sum() + 1)) if counts.all() else tuple((counts > 0) if counts.any() else (0.5, 0.5))
        pooled = sums.sum(0)
        spread = np.diag(pooled)[1:] / max(counts.sum(), 1) - (pooled[0, 1:] / max(counts.sum(), 1)) ** 2
        means, factors, log_dets = [], [], []
        for c in (0, 1):
            n = max(counts[c], 1)
            mean = sums[c, 0, 1:] / n
            cov = sums[c, 1:, 1:] / n - np.outer(mean, mean)
            # A floor from both classes keeps statistics that are constant in one finite.
            weight = min(1.0, shrink + D / (n + D))
            cov = (1 - weight) * cov + weight * np.diag(np.maximum(np.diag(cov), 0))
            cov += np.diag(0.05 * np.maximum(spread, 0) + 1e-4)
            root = np.linalg.cholesky(cov)
            means.append(mean)
            factors.append(np.linalg.inv(root))
            log_dets.append(2 * np.log(np.diag(root)).sum())
        return cls(shares, tuple(means), tuple(factors), tuple(log_dets), temper if counts.all() else 0.0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Posterior probability of label 1, a value a row."""
        if min(self.shares) == 0:
            return np.full(len(x), float(self.shares[1]))
        log = [-0.5 * (((x - m) @ f.T) ** 2).sum(1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.log_dets, strict=True)]
        odds = self.temper * (log[1] - log[0]) + np.log(self.shares[1] / self.shares[0])
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` (id, x) as (id, score)."""
        model = self

        def run(batches):
            for b in batches:
                x = np.asarray(b.column("x").flatten()).reshape(-1, D)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(model.scores(x), pa.float64())], ["id", "score"])

        kind = rows.schema["id"].dataType.simpleString()
        return rows.select("id", "x").mapInArrow(run, f"id {kind}, score double")


def held_out(id_column: Column, folds: int = 5) -> Column:
    return F.crc32(id_column.cast("string").cast("binary")) % folds == 0


def fitted(docs: DataFrame, labels: DataFrame, rows: DataFrame | None = None, **fit) -> QuadraticDiscriminant:
    """The model of all labelled documents that aren't held out; labels are joined to statistics, never to texts."""
    rows = with_statistics(docs) if rows is None else rows
    labels = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("label")).where(~held_out(F.col("_id")))
    return QuadraticDiscriminant.fit(rows.join(labels, F.col("id") == F.col("_id")), **fit)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **fit) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document. Labels of held-out documents are not used."""
    rows = stage(with_statistics(docs), "quality-statistics")
    scored = fitted(docs, labels, rows, **fit).score(rows)
    return scored.select(
        F.col("id").alias("doc_id"),
        F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **fit) -> DataFrame:
    """The rows of ``docs``, whole, that the classifier accepts: scored and dropped where they are read."""
    model = fitted(docs, labels, **fit)

    def run(batches):
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column("text")], ["at", "text"])
            scores = [model.scores(statistics(data, offsets)) for _, data, offsets in text_slices([pair], 512 << 10)]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) >= threshold))

    return docs.mapInArrow(run, docs.schema)
