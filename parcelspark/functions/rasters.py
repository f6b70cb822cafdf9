"""Column functions on flat rasters: all built-in, evaluated in the JVM.

A raster of ``bands`` bands is one array, band by band and row by row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The eight flips and quarter turns of a square, as source (y, x) of target (y, x), and each one's inverse.
D4 = (
    ("identity", "identity", lambda y, x, n: (y, x)),
    ("flip_x", "flip_x", lambda y, x, n: (y, n - x)),
    ("flip_y", "flip_y", lambda y, x, n: (n - y, x)),
    ("turn_180", "turn_180", lambda y, x, n: (n - y, n - x)),
    ("turn_90", "turn_270", lambda y, x, n: (x, n - y)),
    ("turn_270", "turn_90", lambda y, x, n: (n - x, y)),
    ("transpose", "transpose", lambda y, x, n: (x, y)),
    ("anti_transpose", "anti_transpose", lambda y, x, n: (n - x, n - y)),
)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once for a row, however often lambdas use it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scaled(raster: Column, scale: float) -> Column:
    """Digital numbers as reflectance."""
    return F.transform(raster, lambda v: v.cast("double") / scale)


def binarized(mask: Column) -> Column:
    """Boundary counts as field: every class above 0 is 1."""
    return F.transform(mask, lambda v: (v > 0).cast("int"))


def eval_relabelled(mask: Column) -> Column:
    """Boundary is background; ignored pixels stay so."""
    return F.transform(mask, lambda v: F.when(v == 2, 0).otherwise(v))


def argmax(values: Column) -> Column:
    """Place, from 0, of the first greatest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def softmax(values: Column) -> Column:
    """Shares of powers of e; the greatest value is taken off first."""
    powers = once(F.array_max(values), lambda top: F.transform(values, lambda v: F.exp(v - top)))
    total = lambda p: F.aggregate(p, F.lit(0.0), lambda a, v: a + v)
    return once(powers, lambda p: once(total(p), lambda t: F.transform(p, lambda x: x / t)))


def pixel_classes(raster: Column, n_classes: int, f: Callable[[Column], Column]) -> Column:
    """``f`` of the array of class values of every pixel of a class-major raster."""

    def pixels(r: Column) -> Column:
        n = (F.size(r) / n_classes).cast("int")
        values = lambda p: F.array(*(F.get(r, p + c * n) for c in range(n_classes)))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda p: once(values(p), f))

    return once(raster, pixels)


def stacked(a: Column, b: Column, swap: Column | None = None) -> Column:
    """The bands of both windows: b before a, or the other way round where ``swap``."""
    return F.concat(b, a) if swap is None else F.when(swap, F.concat(a, b)).otherwise(F.concat(b, a))


def window(raster: Column, h: Column, w: Column, top: Column, left: Column, new_h: Column, new_w: Column, fill, bands: int = 1) -> Column:
    """The part of a raster from (top, left) of new size; ``fill`` beyond its edges."""
    inside = lambda y, x: (y >= 0) & (y < h) & (x >= 0) & (x < w)

    def value(r: Column, i: Column) -> Column:
        band = F.floor(i / (new_h * new_w)).cast("int")
        rest = i % (new_h * new_w)
        y, x = F.floor(rest / new_w).cast("int") + top, rest % new_w + left
        return F.when(inside(y, x), F.get(r, band * h * w + y * w + x)).otherwise(F.lit(fill))

    return once(raster, lambda r: F.transform(F.sequence(F.lit(0), new_h * new_w * bands - 1), lambda i: value(r, i)))


def padded_size(d: Column, least: int = 0, unit: int = 32) -> Column:
    return F.greatest((F.ceil(d / unit) * unit).cast("int"), F.lit(least))


def padded(raster: Column, h: Column, w: Column, new_h: Column, new_w: Column, fill, bands: int = 1) -> Column:
    """Padded below and to the right; never cut."""
    zero = F.lit(0)
    return window(raster, h, w, zero, zero, F.greatest(h, new_h), F.greatest(w, new_w), fill, bands)


def centre_crop(raster: Column, h: Column, w: Column, size: int, bands: int = 1, fill=0) -> Column:
    """A square of ``size`` from the middle; a smaller raster is padded below and to the right first."""
    place = lambda d: F.floor((F.greatest(d, F.lit(size)) - size) / 2).cast("int")
    return window(raster, h, w, place(h), place(w), F.lit(size), F.lit(size), fill, bands)


def random_crop(raster: Column, h: Column, w: Column, size: int, *key, bands: int = 1, fill=0) -> Column:
    """As ``centre_crop``, from a place by a hash of ``key``: any is as likely, and the same for image and mask."""
    place = lambda d, name: F.floor(uniform(0, 1, *key, F.lit(name)) * (F.greatest(d, F.lit(size)) - size + 1)).cast("int")
    return window(raster, h, w, place(h, "top"), place(w, "left"), F.lit(size), F.lit(size), fill, bands)


def turned(raster: Column, size: Column, source: Callable) -> Column:
    """A square raster under one of the D4 elements."""

    def value(r: Column, i: Column) -> Column:
        y, x = source(F.floor(i / size).cast("int"), i % size, size - 1)
        return F.get(r, y * size + x)

    return once(raster, lambda r: F.transform(F.sequence(F.lit(0), size * size - 1), lambda i: value(r, i)))


def gamma(raster: Column, exponent: Column | float) -> Column:
    """Powers of values of at least 1e-6."""
    return F.transform(raster, lambda v: F.pow(F.greatest(v, F.lit(1e-6)), exponent))


def affine(raster: Column, a, b) -> Column:
    return F.transform(raster, lambda v: v * a + b)


def window_dropped(stack: Column, second: Column, bands: int = 4) -> Column:
    """One of two stacked windows set to 0: the second where ``second``."""
    half = (F.size(stack) / 2).cast("int")
    return F.transform(stack, lambda v, i: F.when((i >= half) == second, F.lit(0.0)).otherwise(v))


def uniform(low: float, high: float, *key) -> Column:
    """A value in [low, high) by a hash of ``key``: the same wherever the row stands."""
    u = F.pmod(F.xxhash64(*key), F.lit(1 << 52)) / float(1 << 52)
    return F.lit(low) + u * (high - low)


def _mirrored(c: Column, n: Column) -> Column:
    return F.when(c < 0, -c).when(c >= n, 2 * n - 2 - c).otherwise(c)


def _pixelwise(raster: Column, h: Column, w: Column, value: Callable) -> Column:
    """``value(at, v, band, y, x)`` of every pixel; ``at(y, x)`` is another one of its band."""

    def pixel(r: Column, v: Column, i: Column) -> Column:
        area = h * w
        band = F.floor(i / area).cast("int")
        y, x = F.floor(i % area / w).cast("int"), i % w
        return value(lambda yy, xx: F.get(r, band * area + yy * w + xx), v, band, y, x)

    return once(raster, lambda r: F.transform(r, lambda v, i: pixel(r, v, i)))


def _three(at, y: Column, x: Column, h: Column, w: Column, weight) -> Column:
    """The sum over the 3 x 3 surroundings, with edges mirrored (without repeating the edge)."""
    total = F.lit(0.0)
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            total = total + at(_mirrored(y + dy, h), _mirrored(x + dx, w)) * weight(dy, dx)
    return total


def blurred(raster: Column, h: Column, w: Column, sigma: Column | float) -> Column:
    """3 x 3 Gaussian mean of every band, with edges mirrored (without repeating the edge)."""
    sigma = F.lit(sigma) if isinstance(sigma, (int, float)) else sigma
    side = F.exp(-0.5 / (sigma * sigma))
    weight = lambda dy, dx: (side if dy else F.lit(1.0)) * (side if dx else F.lit(1.0)) / ((1 + 2 * side) * (1 + 2 * side))
    return _pixelwise(raster, h, w, lambda at, v, band, y, x: _three(at, y, x, h, w, weight))


def sharpened(raster: Column, h: Column, w: Column, factor: Column) -> Column:
    """Away from the 3 x 3 mean (centre five times as heavy) by ``factor``; edges stay."""
    weight = lambda dy, dx: F.lit(1 / 13 if dy or dx else 5 / 13)

    def value(at, v, band, y, x):
        inner = (y > 0) & (y < h - 1) & (x > 0) & (x < w - 1)
        return F.when(inner, v + factor * (v - _three(at, y, x, h, w, weight))).otherwise(v)

    return _pixelwise(raster, h, w, value)


def flipped(raster: Column, h: Column, w: Column, down: bool) -> Column:
    """Rows in reverse order, or, not ``down``, columns."""
    return _pixelwise(raster, h, w, lambda at, v, band, y, x: at(h - 1 - y, x) if down else at(y, w - 1 - x))


def by_band(raster: Column, h: Column, w: Column, f: Callable[[Column, Column], Column]) -> Column:
    """``f(value, band)`` of every pixel."""
    return F.transform(raster, lambda v, i: f(v, F.floor(i / (h * w)).cast("int")))


def dilated(mask: Column, h: Column, w: Column, times: Column, grown: int = 2, fixed: int = 3) -> Column:
    """Class ``grown`` spread by ``times`` pixels in all eight directions; class ``fixed`` stays."""
    around = F.sequence(-times, times)
    inside = lambda y, x: (y >= 0) & (y < h) & (x >= 0) & (x < w)

    def value(at, v, band, y, x):
        near = F.exists(around, lambda dy: F.exists(around, lambda dx: inside(y + dy, x + dx) & (at(y + dy, x + dx) == grown)))
        return F.when((v != fixed) & near, F.lit(grown)).otherwise(v)

    return _pixelwise(mask, h, w, value)
