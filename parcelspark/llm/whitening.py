"""Embedding whitening from an exact scatter matrix in residue numbers.

Entries become integers x = floor(64 c) + 1000000. With n vectors and the sums S,
each row is centred as n x - S, which is still whole. Every task takes the
centred rows modulo several primes and multiplies them, for each prime, as
matrices of doubles whose products stay below 2**53 and so are exact. Tasks'
products are added up modulo the primes, a few tasks at a time, and the driver
puts the residues of one matrix together by the Chinese remainder theorem. So many
primes are taken that the true sums, bounded by n and the entries' extremes, are
found without error, whatever the offset and the number of rows. The covariance
is that matrix over n cubed, rounded once to double, and decomposed in double
precision. Whitened vectors are centred, projected and scaled; their own
covariance is worked out by a further pass, centred in each task before products
are formed, and compared with the identity.

What leaves the tasks are matrices of the vectors' length, cut in stripes of 1 MB
at most; the driver holds one matrix of whole numbers.

Defined results: null vectors and vectors with null or non-finite entries are
dropped, and so are vectors of another length than most usable ones have (see
``vectors``). A null id stays null; rows with one id are rows each. A component
without variance (equal vectors, fewer vectors than components) can't be scaled:
its whitened values are null, and the identity is compared over the others; with
no variance at all, shares and error are null. A deviation beyond a long is null.
An empty table gives no rows. Extra columns are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added_up
from .vectors import BLOCK, Extent, embeddings_with, extent, usable_rows, whole_numbers

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Integers of vectors have fewer bits than this.
BITS = 45
#: Residues lie within half a prime of 0: BLOCK products of two of them stay below 2**53.
PRIME_BITS = 21
#: Bytes of a stripe of a matrix; tasks added up at once, and how often.
STRIPE_BYTES, FAN, LEVELS = 1 << 20, 64, 2

OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def primes(above: int) -> list[int]:
    """The largest primes of PRIME_BITS bits, as many as make a product larger than ``above``."""
    top = 1 << PRIME_BITS
    sieve = np.ones(top, bool)
    sieve[:2] = False
    for i in range(2, int(top**0.5) + 1):
        if sieve[i]:
            sieve[i * i :: i] = False
    out: list[int] = []
    for p in np.flatnonzero(sieve)[::-1].tolist():
        out.append(p)
        if prod(out) > above:
            break
    return out


def from_residues(residues: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """The whole numbers, of least absolute value, that have these residues (object array)."""
    whole = prod(moduli)
    total = 0
    for r, p in zip(residues, moduli, strict=True):
        rest = whole // p
        total = total + r.astype(object) * (rest * pow(rest, -1, p))
    total = total % whole
    return np.where(total > whole // 2, total - whole, total)


@dataclass(frozen=True)
class Centre:
    """n x - S in parts that fit a long: x - ``floor`` and S - n ``floor``, with ``floor`` below the mean."""

    n: int
    size: int
    floor: np.ndarray
    rest: list[int]

    @classmethod
    def of(cls, e: Extent) -> Centre:
        floor = [s // e.n for s in e.sums]
        return cls(e.n, e.size, np.array(floor, np.int64), [s - e.n * f for s, f in zip(e.sums, floor, strict=True)])

    def rows(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Places of usable vectors and x - floor of each."""
        at, x = usable_rows(column, self.size)
        return at, whole_numbers(x, SCALE, SHIFT) - self.floor

    def modulo(self, x: np.ndarray, p: int) -> np.ndarray:
        """n x - S modulo ``p``, as doubles within half of it of 0."""
        r = (x % p * (self.n % p) - np.array([v % p for v in self.rest], np.int64)) % p
        return np.where(r > p // 2, r - p, r).astype(np.float64)

    def doubles(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, rounded once."""
        return x - np.array([r / self.n for r in self.rest])

    def deviation(self, x: np.ndarray, largest: int) -> pa.Array:
        """Exact sums of (n x - S) squared; ``largest`` bounds the sums."""
        if largest < 1 << 63:
            d = x * self.n - np.array(self.rest, np.int64)
            return pa.array((d * d).sum(1))
        d = x.astype(object) * self.n - np.array(self.rest, object)
        return pa.array([v if v < 1 << 63 else None for v in (d * d).sum(1)], pa.int64())


def _residue_products(centre: Centre, moduli: list[int], stripe: int):
    """A task's products of centred rows, modulo each prime, in stripes of ``stripe`` rows of the matrix."""

    def run(batches):
        total = {p: np.zeros((centre.size, centre.size), np.int64) for p in moduli}
        some = False
        for b in batches:
            _, x = centre.rows(b.column(0))
            for low in range(0, len(x), BLOCK):
                some = True
                for p in moduli:
                    r = centre.modulo(x[low : low + BLOCK], p)
                    total[p] = (total[p] + (r.T @ r).astype(np.int64)) % p
        for p in moduli if some else ():
            for low in range(0, centre.size, stripe):
                yield pa.RecordBatch.from_pydict(
                    {"prime": pa.array([p], pa.int32()), "low": pa.array([low], pa.int32()), "r": [total[p][low : low + stripe].ravel()]}
                )

    return run


def _residues_added(table: pa.Table) -> dict:
    p = table.column("prime")[0].as_py()
    r = np.asarray(table.column("r").combine_chunks().flatten(), np.int64).reshape(table.num_rows, -1)
    return {"r": [r.sum(0) % p]}


def exact_scatter(rows: DataFrame, e: Extent, centre: Centre) -> np.ndarray:
    """The sums of products of n x - S over all usable vectors, exactly (object matrix)."""
    moduli = primes(2 * e.n * _largest(e) ** 2 + 1)
    stripe = max(1, STRIPE_BYTES // (8 * e.size))
    parts = rows.select("embedding").mapInArrow(_residue_products(centre, moduli, stripe), "prime int, low int, r array<long>")
    sums = {p: np.zeros((e.size, e.size), np.int64) for p in moduli}
    for row in added_up(parts, _residues_added, ["prime", "low"], "r array<long>", FAN, LEVELS).toLocalIterator():
        sums[row.prime][row.low : row.low + stripe] = np.array(row.r, np.int64).reshape(-1, e.size)
    return from_residues([sums[p] for p in moduli], moduli)


def _largest(e: Extent) -> int:
    """The largest absolute entry of n x - S."""
    return max(max(e.n * h - s, s - e.n * w) for s, w, h in zip(e.sums, e.low, e.high, strict=True))


@dataclass(frozen=True)
class Whitening:
    """A fit: principal axes, widest first, with their eigenvalues."""

    extent: Extent
    centre: Centre
    axes: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def scaled(self) -> np.ndarray:
        """Which components have a variance above rounding."""
        return self.values > self.extent.size * np.finfo(float).eps * max(self.values[0], 0.0)

    @property
    def explained(self) -> list[float | None]:
        return [v / self.trace if self.trace > 0 else None for v in self.values.tolist()]

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened vectors of rows x - floor; NaN in components without a scale."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.scaled, 1 / np.sqrt(self.values), np.nan)
        return self.centre.doubles(x) @ self.axes * scale


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all usable vectors in ``rows`` (vec_id, embedding); None if there are none."""
    e = extent(rows, SCALE, SHIFT, lambda _: BITS)
    if e is None:
        return None
    centre = Centre.of(e)
    scatter, cubed = exact_scatter(rows, e, centre), e.n**3
    covariance = np.array([[v / cubed for v in row] for row in scatter.tolist()])
    values, axes = np.linalg.eigh(covariance)
    k = min(components, e.size)
    trace = sum(scatter[i][i] for i in range(e.size)) / cubed
    return Whitening(e, centre, axes[:, ::-1][:, :k].copy(), values[::-1][:k].copy(), trace)


def _moments(model: Whitening):
    """A task's number of vectors, means of whitened components and centred products."""

    def run(batches):
        parts = []
        for b in batches:
            _, x = model.centre.rows(b.column(0))
            for low in range(0, len(x), BLOCK):
                w = model.apply(x[low : low + BLOCK])[:, model.scaled]
                mean = w.mean(0)
                parts.append((len(w), mean, ((w - mean).T @ (w - mean)).ravel()))
        if parts:
            n, mean, products = _joined(parts)
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "mean": [mean], "products": [products]})

    return run


def _joined(parts: list[tuple]) -> tuple:
    """Numbers, means and centred products of parts, as of all their rows together."""
    n = sum(p[0] for p in parts)
    mean = sum(p[0] / n * p[1] for p in parts)
    products = sum(p[2] + p[0] * np.outer(p[1] - mean, p[1] - mean).ravel() for p in parts)
    return n, mean, products


def _moments_added(table: pa.Table) -> dict:
    parts = [(n, np.array(m), np.array(p)) for n, m, p in zip(*(table.column(c).to_pylist() for c in ("n", "mean", "products")), strict=True)]
    n, mean, products = _joined(parts)
    return {"n": pa.array([n], pa.int64()), "mean": [mean], "products": [products]}


def identity_error(rows: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance less the identity."""
    if not model.scaled.any():
        return None
    schema = "n long, mean array<double>, products array<double>"
    parts = rows.select("embedding").mapInArrow(_moments(model), schema)
    row = added_up(parts, _moments_added, [], schema, FAN, LEVELS).first()
    k = int(model.scaled.sum())
    return float(np.abs(np.array(row.products).reshape(k, k) / row.n - np.eye(k)).max())


def transformed(rows: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened array<double>) of every usable vector."""
    largest = model.extent.size * _largest(model.extent) ** 2

    def run(batches):
        for b in batches:
            at, x = model.centre.rows(b.column(1))
            for low in range(0, len(x), BLOCK):
                part = x[low : low + BLOCK]
                w = model.apply(part)
                values = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
                offsets = np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at[low : low + BLOCK])), model.centre.deviation(part, largest), pa.ListArray.from_arrays(offsets, values)],
                    ["vec_id", "deviation", "whitened"],
                )

    return rows.select("vec_id", "embedding").mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for every usable vector and each of its first ``components`` whitened components (see OUT)."""
    rows = embeddings_with(rows)
    model = fit(rows, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], OUT)
    error = identity_error(rows, model)
    shares = F.array(*(F.lit(v).cast("double") for v in model.explained))
    return (
        transformed(rows, model)
        .select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
        .select(
            "vec_id",
            (F.col("at") + 1).cast("int").alias("component"),
            F.lit(model.extent.n).cast("long").alias("n"),
            "deviation",
            "whitened",
            F.element_at(shares, F.col("at") + 1).alias("explained"),
            F.lit(error).cast("double").alias("identity_error"),
        )
    )
