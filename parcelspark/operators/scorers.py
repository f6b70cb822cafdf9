"""From images to class maps with any model, given as a scorer.

A scorer maps an image (bands, height, width) to class scores (classes, height,
width). It is made by its factory once in every Python worker, and kept there for
later tasks of the same factory, whichever frame they score. Weights that come with a broadcast (``with_weights``)
are sent to a machine once. A scorer with ``batched = True`` gets stacks of images
of one size, (n, bands, height, width), and gives stacks of scores.
"""

from __future__ import annotations

import hashlib
import importlib
from collections.abc import Callable
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from . import metrics

Scorer = Callable[[np.ndarray], np.ndarray]

# Reflectance scales of the two image sources, and the ground size of their pixels in metres.
SCALES = {"3m": 10000.0, "10m": 3000.0}
METRES = {"3m": 3.0, "10m": 10.0}


#: Images of a stack, at most.
STACK = 8
#: The scorer of the last factory that this worker has worked for, by the factory's digest.
_MADE: dict[str, Scorer] = {}


def softmax(scores: np.ndarray, classes: int = 0) -> np.ndarray:
    powers = np.exp(scores - scores.max(classes, keepdims=True))
    return powers / powers.sum(classes, keepdims=True)


def made_once(digest: str, factory: Callable[[], Scorer]) -> Scorer:
    """The scorer of a factory, made if this worker has not made it yet."""
    if digest not in _MADE:
        _MADE.clear()
        _MADE[digest] = factory()
    return _MADE[digest]


def with_weights(spark: SparkSession, make: Callable[[object], Scorer], weights) -> Callable[[], Scorer]:
    """A factory that gives ``make`` the weights from a broadcast, of the model's size whatever the data."""
    sent = spark.sparkContext.broadcast(weights)
    return lambda: make(sent.value)


def stacked(scorer: Scorer) -> Scorer:
    """``scorer`` for stacks of images, one by one if it does not take them itself."""
    if getattr(scorer, "batched", False):
        return scorer
    return lambda images: np.stack([scorer(image) for image in images])


def padded_size(h: int, w: int, least: int = 0, unit: int = 32) -> tuple[int, int]:
    return max(-(-h // unit) * unit, least), max(-(-w // unit) * unit, least)


def padded(image: np.ndarray, least: int = 0, unit: int = 32, fill: float = 0) -> np.ndarray:
    """Padded below and to the right to whole units of at least ``least``."""
    sizes = padded_size(*image.shape[-2:], least, unit)
    gaps = [(0, 0)] * (image.ndim - 2) + [(0, s - n) for s, n in zip(sizes, image.shape[-2:], strict=True)]
    return np.pad(image, gaps, constant_values=fill)


def over_symmetries(scorer: Scorer, image: np.ndarray) -> np.ndarray:
    """Class probabilities, the mean over the eight flips and turns of the image (or stack), each turned back."""
    total = 0.0
    for turns in range(4):
        for flip in (False, True):
            seen = np.rot90(image, turns, (-2, -1))
            seen = seen[..., ::-1] if flip else seen
            found = softmax(scorer(np.ascontiguousarray(seen)), -3)
            found = found[..., ::-1] if flip else found
            total = total + np.rot90(found, -turns, (-2, -1))
    return total / 8


def _scored(rasters: DataFrame, factory: Callable[[], Scorer], source: str, symmetries: bool, least: int, out: str, kind: str, result) -> DataFrame:
    """``rasters`` without images, with ``result`` of the class probabilities of every image as ``out``.

    Images are scaled, padded, scored and cut back to their size.
    """
    if source not in SCALES:
        raise ValueError(f"source is one of {sorted(SCALES)}, not {source!r}")
    scale = SCALES[source]
    kept = [c for c in rasters.columns if c not in ("image", out)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rasters.select(*kept).schema) + f", `{out}` array<{kind}>"
    arrow = {"int": pa.int32(), "double": pa.float64()}[kind]

    digest = hashlib.blake2b(cloudpickle.dumps(factory), digest_size=16).hexdigest()

    def run(batches):
        scorer = stacked(made_once(digest, factory))
        for batch in batches:
            sizes = list(zip(*(batch.column(c).to_pylist() for c in ("bands", "h", "w")), strict=True))
            # Images of one padded size go together, a few at a time.
            by_size = sorted(range(batch.num_rows), key=lambda r: (sizes[r][0], *padded_size(*sizes[r][1:], least)))
            for _, rows in groupby(by_size, key=lambda r: (sizes[r][0], *padded_size(*sizes[r][1:], least))):
                rows = list(rows)
                for low in range(0, len(rows), STACK):
                    part = rows[low : low + STACK]
                    images = [np.asarray(batch.column("image")[r].values, np.float32).reshape(sizes[r]) / scale for r in part]
                    images = np.stack([padded(image, least) for image in images])
                    p = over_symmetries(scorer, images) if symmetries else softmax(scorer(images), 1)
                    found = [result(q[:, : sizes[r][1], : sizes[r][2]]).ravel() for q, r in zip(p, part, strict=True)]
                    taken = batch.take(pa.array(part))
                    yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in kept), pa.array(found, pa.list_(arrow))], [*kept, out])

    return rasters.select(*kept, "image").mapInArrow(run, schema)


def classified(
    rasters: DataFrame, factory: Callable[[], Scorer], source: str = "3m", symmetries: bool = True, least: int = 0, out: str = "pred"
) -> DataFrame:
    """``rasters`` (country, patch_id, h, w, bands, image, ...) with the class of every pixel as ``out``."""
    return _scored(rasters, factory, source, symmetries, least, out, "int", lambda p: p.argmax(0).astype(np.int32))


def probabilities(
    rasters: DataFrame, factory: Callable[[], Scorer], source: str = "3m", symmetries: bool = True, least: int = 0, out: str = "p"
) -> DataFrame:
    """``rasters`` with the probabilities of every class, class by class, as ``out``."""
    return _scored(rasters, factory, source, symmetries, least, out, "double", lambda p: p.astype(float))


def evaluated(
    samples: DataFrame, factory: Callable[[], Scorer], source: str = "3m", symmetries: bool = True, watershed: bool = True,
    checkpoint: str = "", least: int = 512, h: float = 2.0,
) -> DataFrame:
    """From images to metrics: a row for every country of ``samples`` (country, patch_id, h, w, bands, image, gt).

    Images are padded to ``least`` pixels a side. Without ``symmetries`` one is
    scored once as it stands; without ``watershed`` (from maxima of height ``h``) its
    columns are null. Distances are in metres of the source.
    """
    found = classified(samples, factory, source, symmetries, least)
    return metrics.country_metrics(found, watershed, METRES[source], checkpoint, h)


def first_that_works(*factories: Callable[[], Scorer]) -> Callable[[], Scorer]:
    """A factory that tries others in order: the next one where weights do not fit a kind of model."""

    def make() -> Scorer:
        for factory in factories[:-1]:
            try:
                return factory()
            except (RuntimeError, KeyError, TypeError):
                pass
        return factories[-1]()

    return make


def named_factory(name: str) -> Callable[[], Scorer]:
    """The scorer factory that ``module:function`` names."""
    module, _, function = name.partition(":")
    if not function:
        raise ValueError(f"{name!r} is not module:function")
    return getattr(importlib.import_module(module), function)


def threshold_scorer(threshold: float, band: int = 0) -> Callable[[], Scorer]:
    """A stand-in for a model: field where a band is above a threshold."""

    def make() -> Scorer:
        return lambda image: np.stack([np.full(image.shape[1:], threshold), image[band]])

    return make


#: A factory by name, for trying the commands without a model.
bright = threshold_scorer(0.5)


def bright_by_weights(weights: bytes) -> Scorer:
    """The same with its threshold, as text, for weights."""
    return threshold_scorer(float(weights))()
