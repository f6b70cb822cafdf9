"""Fields as objects: components, overlaps, matches and boundary distances.

Polygons here are unions of pixels, so that areas, intersections and IoU are
counts. A patch is scored in one task; what leaves it are its pairs of
overlapping fields, not its pixels, so that nothing but sums is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels

_PAIR = "struct<gt: int, pred: int, inter: long, gt_area: long, pred_area: long, iou: float, chamfer: double>"
_KEYS = "country string, patch_id string"


def _patches(batch):
    for r in range(batch.num_rows):
        h, w = batch.column("h")[r].as_py(), batch.column("w")[r].as_py()
        grid = lambda c: np.asarray(batch.column(c)[r].values, np.int64).reshape(h, w)  # noqa: B023, E731
        yield r, grid


#: Rows of one batch that leave a task, about, and patches whose rows it holds, at most: each is kilobytes, however few its rows.
BATCH_ROWS, BATCH_PATCHES = 1 << 16, 256


def _rows(rasters: DataFrame, rows, schema: str) -> DataFrame:
    """The rows of every patch: ``rows(grid)`` gives their columns (but the keys) as arrays or lists of one length.

    Patches are worked out one at a time, and leave as soon as they fill a batch.
    """
    arrow = _arrow(schema)

    def run(batches):
        ready, n = [], 0
        for batch in batches:
            for r, grid in _patches(batch):
                found = rows(grid)
                size = len(next(iter(found.values())))
                if not size:
                    continue
                keys = [pa.repeat(batch.column(c)[r].cast(pa.string()), size) for c in ("country", "patch_id")]
                ready.append(pa.RecordBatch.from_arrays([*keys, *(pa.array(found[f.name], f.type) for f in list(arrow)[2:])], schema=arrow))
                n += size
                if n >= BATCH_ROWS or len(ready) >= BATCH_PATCHES:
                    yield from pa.Table.from_batches(ready).combine_chunks().to_batches(max_chunksize=BATCH_ROWS)
                    ready, n = [], 0
        if ready:
            yield from pa.Table.from_batches(ready).combine_chunks().to_batches(max_chunksize=BATCH_ROWS)

    return rasters.select("country", "patch_id", "h", "w", "gt", "pred").mapInArrow(run, schema)


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
_PAIRS = _ARROW[f"array<{_PAIR}>"] = pa.list_(
    pa.struct(
        [("gt", pa.int32()), ("pred", pa.int32()), ("inter", pa.int64()), ("gt_area", pa.int64()), ("pred_area", pa.int64())]
        + [("iou", pa.float32()), ("chamfer", pa.float64())]
    )
)


def _arrow(schema: str) -> pa.Schema:
    depth, parts, word = 0, [], ""
    for c in schema + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(word.strip().split(" ", 1))
            word = ""
        else:
            word += c
    return pa.schema([(name, _ARROW[kind]) for name, kind in parts])


def fields_of(grid, side: str, watershed: bool = False, h: float = 2.0) -> np.ndarray:
    """The field mask of a side; predictions may keep only what a watershed from maxima of height ``h`` reaches."""
    classes = grid(side)
    if side == "pred" and watershed:
        return kernels.watershed_mask(classes, kernels.distance(classes != 2), h)
    return classes == 1


def components(rasters: DataFrame, side: str = "gt") -> DataFrame:
    """(country, patch_id, comp_id, area): 4-connected fields, known by their least pixel."""

    def rows(grid):
        label = kernels.components(fields_of(grid, side))
        ids, area = np.unique(label[label >= 0], return_counts=True)
        return {"comp_id": ids, "area": area}

    return _rows(rasters, rows, f"{_KEYS}, comp_id int, area long")


def outlines(rasters: DataFrame, side: str = "gt") -> DataFrame:
    """(country, patch_id, comp_id, area, n_holes, n_points, wkb): the outlines of 4-connected fields, in pixel coordinates.

    The area is that of the rings, holes taken off; ``wkb`` is a polygon that any
    geometry library reads.
    """
    schema = f"{_KEYS}, comp_id int, area long, n_holes int, n_points int, wkb binary"
    return _rows(rasters, lambda grid: kernels.polygons(kernels.components(fields_of(grid, side))), schema)


def masks(rasters: DataFrame, kernel) -> DataFrame:
    """(country, patch_id, mask): ``kernel(grid)`` of every patch."""
    return _rows(rasters, lambda grid: {"mask": [np.asarray(kernel(grid), np.int32).ravel()]}, f"{_KEYS}, mask array<int>")


def values(rasters: DataFrame, kernel) -> DataFrame:
    """(country, patch_id, y, x, value): ``kernel(grid)`` of every pixel that has one (not NaN)."""

    def rows(grid):
        v = kernel(grid)
        y, x = np.nonzero(~np.isnan(v))
        return {"y": y, "x": x, "value": v[y, x]}

    return _rows(rasters, rows, f"{_KEYS}, y int, x int, value double")


def objects(rasters: DataFrame, watershed: bool = False, chamfer: bool = False, h: float = 2.0) -> DataFrame:
    """(country, patch_id, n_gt, n_pred, pairs) of every patch, also of those without fields.

    ``pairs``: overlapping fields with IoU as float; with ``chamfer``, the
    symmetric boundary distance of pairs above 0.5 whose boundaries both exist.
    """

    def rows(grid):
        labels = [kernels.components(fields_of(grid, s, watershed, h)) for s in ("gt", "pred")]
        n_gt, n_pred, pairs = _overlapping(*labels, chamfer)
        return {"n_gt": [n_gt], "n_pred": [n_pred], "pairs": pairs}

    return _rows(rasters, rows, f"{_KEYS}, n_gt int, n_pred int, pairs array<{_PAIR}>")


def _overlapping(gt_label: np.ndarray, pred_label: np.ndarray, chamfer: bool) -> tuple[int, int, pa.ListArray]:
    """Numbers of fields of both sides, and their overlapping pairs as a list of one row."""
    gt, pred = gt_label.ravel(), pred_label.ravel()
    size = len(gt)
    areas = [np.bincount(x[x >= 0], minlength=size) for x in (gt, pred)]
    both = (gt >= 0) & (pred >= 0)
    key, inter = np.unique(gt[both] * size + pred[both], return_counts=True)
    g, p = key // size, key % size
    a, b = areas[0][g], areas[1][p]
    iou = (inter / (a + b - inter)).astype(np.float32)
    far = [None] * len(key)
    if chamfer:
        edges = [kernels.points_of(x, kernels.edges_of(x)) for x in (gt_label, pred_label)]
        for k in np.flatnonzero(iou > np.float32(0.5)):
            one, other = edges[0].get(int(g[k])), edges[1].get(int(p[k]))
            if one is not None and other is not None:
                far[k] = (kernels.mean_nearest(one, other) + kernels.mean_nearest(other, one)) / 2
    columns = [g, p, inter, a, b, iou, far]
    pairs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PAIRS.value_type, strict=True)], fields=list(_PAIRS.value_type))
    n_gt, n_pred = (int((a > 0).sum()) for a in areas)
    return n_gt, n_pred, pa.ListArray.from_arrays(pa.array([0, len(key)], pa.int32()), pairs)


def measured(rasters: DataFrame, watershed: bool = True, h: float = 2.0, ignore: int = 3) -> DataFrame:
    """All that the metrics of a country need of each patch, from one look at its pixels.

    (country, patch_id, tp, fp, fn, n_gt, n_pred, pairs, plain_n_pred, plain_pairs):
    pixel counts of the field class, with the truth's boundary as background and
    without ignored pixels; objects with boundary distances, after a watershed if
    asked; and, then, the objects of the prediction as it stands (else null).
    """

    def rows(grid):
        gt, pred = grid("gt"), grid("pred")
        valid = gt != ignore
        truth, field = gt == 1, pred == 1
        label = kernels.components(truth)
        plain = kernels.components(field)
        shown = kernels.components(fields_of(grid, "pred", True, h)) if watershed else plain
        n_gt, n_pred, pairs = _overlapping(label, shown, True)
        count = lambda m: [int((m & valid).sum())]
        out = {"tp": count(truth & field), "fp": count(~truth & field), "fn": count(truth & ~field), "n_gt": [n_gt], "n_pred": [n_pred], "pairs": pairs}
        if watershed:
            _, n_plain, plain_pairs = _overlapping(label, plain, False)
        return out | ({"plain_n_pred": [n_plain], "plain_pairs": plain_pairs} if watershed else {"plain_n_pred": [None], "plain_pairs": [None]})

    objects_of = f"pairs array<{_PAIR}>"
    return _rows(rasters, rows, f"{_KEYS}, tp long, fp long, fn long, n_gt int, n_pred int, {objects_of}, plain_n_pred int, plain_{objects_of}")


def overlaps(scored: DataFrame) -> DataFrame:
    return scored.select("country", "patch_id", F.explode("pairs").alias("p")).select("country", "patch_id", "p.*")


def matched(pairs: Column, threshold: float) -> Column:
    """Pairs above a threshold of one half or more.

    Fields of a side are disjoint, so that a field has one such partner at most,
    and first-come matching in any order comes to the same.
    """
    if threshold < 0.5:
        raise ValueError("below 0.5 the order of matching counts: use matched_in_order")
    return F.filter(pairs, lambda p: p["iou"] > F.lit(threshold).cast("float"))


def matched_in_order(pairs: Column, threshold: float) -> Column:
    """First-come matching: each field of the truth, in order, takes the first free prediction above the threshold."""
    able = F.filter(pairs, lambda p: p["iou"] > F.lit(threshold).cast("float"))
    able = F.array_sort(able, lambda a, b: F.when(a["gt"] != b["gt"], a["gt"] - b["gt"]).otherwise(a["pred"] - b["pred"]))
    free = lambda taken, p: ~F.exists(taken, lambda t: (t["gt"] == p["gt"]) | (t["pred"] == p["pred"]))
    return F.aggregate(able, F.filter(pairs, lambda p: F.lit(False)), lambda taken, p: F.when(free(taken, p), F.concat(taken, F.array(p))).otherwise(taken))
