"""Random changes of training samples, the same for a sample wherever its row stands.

Changes are column functions; draws are too, hashes of the seed, the epoch, the
sample and a name, so that neither partitions nor retries change them. Gates are
drawn for each sample. Only what resamples an image (rotations, shears, resized
crops) goes through Arrow, as one helper with a matrix a row.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rasters as R

IGNORE = 3

#: A number in [low, high) of a sample, by a name and, where a sample draws many, by ``index``.
Draw = Callable[..., Column]


def hashed(seed: int, epoch: int) -> Draw:
    """Draws by hashes of seed, epoch, sample, name and index."""

    def draw(name: str, low: float = 0.0, high: float = 1.0, index: Column | None = None) -> Column:
        key = [F.lit(seed), F.lit(epoch), F.col("patch_id").cast("string"), F.lit(name)]
        return R.uniform(low, high, *key, *([] if index is None else [index]))

    return draw


# ---------------------------------------------------------------- resampling


def warped(image: np.ndarray, matrix: np.ndarray, size: tuple[int, int], nearest: bool, fill: float = 0) -> np.ndarray:
    """An image (bands, h, w) seen through ``matrix``: target (y, x, 1) to source (y, x), about pixel centres."""
    h, w = image.shape[-2:]
    y, x = np.mgrid[: size[0], : size[1]]
    at = matrix @ np.stack([y.ravel(), x.ravel(), np.ones(y.size)])
    out = np.full((image.shape[0], y.size), fill, float)
    if nearest:
        v, u = (np.rint(c).astype(int) for c in at)
        inside = (v >= 0) & (v < h) & (u >= 0) & (u < w)
        out[:, inside] = image[:, v[inside], u[inside]]
        return out.reshape(-1, *size)
    v, u = (np.floor(c + 1e-9).astype(int) for c in at)
    dv, du = at[0] - v, at[1] - u
    total = np.zeros_like(out)
    for oy, ox, weight in ((0, 0, (1 - dv) * (1 - du)), (0, 1, (1 - dv) * du), (1, 0, dv * (1 - du)), (1, 1, dv * du)):
        yy, xx = v + oy, u + ox
        inside = (yy >= 0) & (yy < h) & (xx >= 0) & (xx < w)
        value = np.full_like(out, fill)
        value[:, inside] = image[:, yy[inside], xx[inside]]
        total += value * weight
    return total.reshape(-1, *size)


def resampled(samples: DataFrame, matrix: Column) -> DataFrame:
    """``samples`` with image and mask seen through ``matrix`` (six numbers, row by row), bilinear and nearest; null leaves a row as it is."""
    samples = samples.withColumn("_matrix", matrix)
    kept = [c for c in samples.columns if c not in ("image", "mask", "_matrix")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.select(*kept).schema)

    def run(batches):
        for batch in batches:
            images, masks = [], []
            for r in range(batch.num_rows):
                bands, h, w = (batch.column(c)[r].as_py() for c in ("bands", "h", "w"))
                image, mask = (np.asarray(batch.column(c)[r].values) for c in ("image", "mask"))
                through = batch.column("_matrix")[r].as_py()
                if through is not None:
                    through = np.reshape(through, (2, 3))
                    image = warped(image.reshape(bands, h, w), through, (h, w), nearest=False).ravel()
                    mask = warped(mask.reshape(1, h, w), through, (h, w), nearest=True, fill=IGNORE).ravel()
                images.append(image)
                masks.append(mask.astype(np.int32))
            columns = [*(batch.column(c) for c in kept), pa.array(images, pa.list_(pa.float64())), pa.array(masks, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "image", "mask"])

    return samples.mapInArrow(run, f"{schema}, image array<double>, mask array<int>")


def about_centre(linear: list) -> Column:
    """The matrix of a linear map of (y, x), four columns row by row, that leaves the middle of the image where it is."""
    a, b, c, d = linear
    y, x = (F.col("h") - 1) / 2, (F.col("w") - 1) / 2
    return F.array(a, b, y - a * y - b * x, c, d, x - c * y - d * x)


def rotation(degrees: Column) -> Column:
    angle = F.radians(degrees)
    return about_centre([F.cos(angle), -F.sin(angle), F.sin(angle), F.cos(angle)])


def shear(degrees: Column) -> Column:
    return about_centre([F.lit(1.0), F.lit(0.0), F.tan(F.radians(degrees)), F.lit(1.0)])


def crop_resized(top: Column, left: Column, height: Column, width: Column) -> Column:
    """The matrix that shows a part of an image at the size of the whole."""
    a, b = height / F.col("h"), width / F.col("w")
    return F.array(a, F.lit(0.0), top + (a - 1) / 2, F.lit(0.0), b, left + (b - 1) / 2)


# ---------------------------------------------------------------- the plan


@dataclass(frozen=True)
class Plan:
    """Which changes are on, and how likely each is. The order is that of ``augmented``."""

    scale: float = 10000.0
    random_scale: bool = False
    rotate: float = 0.5
    flip: float = 0.5
    sharpen: float = 0.5
    small_rotate: float = 0.0
    shear: float = 0.0
    gamma: float = 0.0
    affine: float = 0.0
    blur: float = 0.0
    noise: float = 0.0
    resized_crop: float = 0.5
    drop_window: float = 0.0
    jitter: float = 0.0
    jitter_pixels: int = 2

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Plan:
        """The plan in a JSON file; a name that it does not know is a TypeError."""
        text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
        return cls(**json.loads(text))


#: A change of one's own: samples and their draws to changed samples with the same columns.
Change = Callable[[DataFrame, Draw], DataFrame]


def _crop(draw: Draw) -> Column:
    h, w = F.col("h"), F.col("w")
    area, shape = draw("area", 0.3, 0.9) * h * w, F.exp(draw("shape", math.log(0.75), math.log(1.33)))
    height, width = F.least(h.cast("double"), F.sqrt(area / shape)), F.least(w.cast("double"), F.sqrt(area * shape))
    return crop_resized(draw("top") * (h - height), draw("left") * (w - width), height, width)


def noisy(image: Column, draw: Draw, deviation: float = 0.015) -> Column:
    """Normal noise, by the polar form of two draws a value."""
    far = lambda i: F.sqrt(-2 * F.log(1 - draw("noise far", index=i)))
    return F.transform(image, lambda v, i: v + deviation * far(i) * F.cos(2 * math.pi * draw("noise turn", index=i)))


def augmented(
    rasters: DataFrame, epoch: int, seed: int = 7, plan: Plan | None = None, training: bool = True, changes: Sequence[Change] = (), draw: Draw | None = None
) -> DataFrame:
    """``rasters`` (patch_id, h, w, bands, image, mask, ...) changed for training; else only scaled.

    ``changes`` come after those of the plan, in their order, in training; they
    keep the sizes of image and mask. ``draw`` takes the place of hashed draws.
    """
    plan, draw = plan or Plan(), draw or hashed(seed, epoch)
    h, w, image, mask = (F.col(c) for c in ("h", "w", "image", "mask"))
    out = rasters.withColumn("image", R.scaled(image, plan.scale))
    if training:
        out = _changed(out, plan, draw, h, w, image, mask)
        for change in changes:
            out = change(out, draw)
    return out.withColumns({"image": image.cast("array<float>"), "mask": mask.cast("array<int>")})


def _changed(out: DataFrame, plan: Plan, draw: Draw, h: Column, w: Column, image: Column, mask: Column) -> DataFrame:
    on = lambda name, p: draw(f"{name} gate") < p

    def change(likely: float, name: str, new: Column, what: str = "image") -> None:
        nonlocal out
        if likely > 0:
            out = out.withColumn(what, F.when(on(name, likely), new).otherwise(F.col(what)))

    def through(likely: float, name: str, matrix: Column) -> None:
        nonlocal out
        if likely > 0:
            out = resampled(out, F.when(on(name, likely), matrix))

    if plan.random_scale:
        out = out.withColumn("image", R.affine(image, 1 / draw("scale", 0.5, 1.5), 0.0))
    through(plan.rotate, "rotate", rotation(draw("angle", -90, 90)))
    for name, down in (("flip x", False), ("flip y", True)):
        change(plan.flip, name, R.flipped(image, h, w, down))
        change(plan.flip, name, R.flipped(mask, h, w, down), "mask")
    change(plan.sharpen, "sharpen", R.sharpened(image, h, w, draw("sharpness", 0.0, 0.5)))
    through(plan.small_rotate, "small rotate", rotation(draw("small angle", -30, 30)))
    through(plan.shear, "shear", shear(draw("shear", -5, 5)))
    change(plan.gamma, "gamma", R.by_band(image, h, w, lambda v, b: F.pow(F.greatest(v, F.lit(1e-6)), draw("exponents", 0.8, 1.2, b))))
    change(plan.affine, "affine", R.by_band(image, h, w, lambda v, b: v * draw("factors", 0.9, 1.1, b) + draw("offsets", -0.02, 0.02, b)))
    change(plan.blur, "blur", R.blurred(image, h, w, draw("sigma", 0.5, 1.5)))
    change(plan.noise, "noise", noisy(image, draw))
    through(plan.resized_crop, "resized crop", _crop(draw))
    change(plan.drop_window, "drop window", R.window_dropped(image, draw("which window") < 0.5))
    times = F.floor(draw("pixels", 0, plan.jitter_pixels + 1)).cast("int")
    change(plan.jitter, "jitter", R.dilated(mask, h, w, times), "mask")
    return out


def stacked(windows: DataFrame, bands: int, epoch: int, seed: int = 7, swap_order: bool = False) -> DataFrame:
    """``windows`` (patch_id, image_a, image_b of ``bands`` bands, ...) as image, b before a; with ``swap_order``, a before b in one sample of two."""
    swap = R.uniform(0, 1, F.lit(seed), F.lit(epoch), F.col("patch_id"), F.lit("swap")) < 0.5
    image = R.stacked(F.col("image_a"), F.col("image_b"), swap if swap_order else None)
    return windows.withColumns({"image": image, "bands": F.lit(2 * bands)}).drop("image_a", "image_b")


def cropped(rasters: DataFrame, size: int, bands: int, epoch: int, seed: int = 7, training: bool = True) -> DataFrame:
    """``rasters`` (patch_id, h, w, image of ``bands`` bands, mask, ...) padded and cut to ``size``: anywhere for training, else from the middle."""
    h, w, key = F.col("h"), F.col("w"), (F.lit(seed), F.lit(epoch), F.col("patch_id"))

    def cut(c, n, fill):
        if training:
            return R.random_crop(F.col(c), h, w, size, *key, bands=n, fill=fill)
        return R.centre_crop(F.col(c), h, w, size, n, fill)

    # Sizes are set apart: in one step the cuts would see the new ones.
    return rasters.withColumns({"image": cut("image", bands, 0), "mask": cut("mask", 1, IGNORE)}).withColumns({"h": F.lit(size), "w": F.lit(size)})
