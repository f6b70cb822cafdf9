"""Connected fields of scenes that no task can hold, cut in tiles.

A scene is rows (scene, tile_y, tile_x, h, w, mask): tiles of one size but at the
right and lower ends, 0 outside fields. Every tile is labelled alone; where two
tiles meet, the labels on both sides of the border are linked; components of the
links, found by Spark over all scenes at once, join the parts. What is shuffled are
borders and links, never pixels. A component is named by its least pixel, as in an
image labelled whole: (scene, comp_id) with comp_id = y * width + x.

Tiles that a scene lacks are not field. Null masks are empty. Repeated tiles (of one
scene and place) are refused with a ValueError, as are tiles beyond ``width``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import staged
from . import kernels
from .graphs import connected_components

_TILE = "scene string, tile_y int, tile_x int"


def _labelled(tile: int, width: int):
    """Tiles with their labels (-1: no field), their parts' (label, area), and the labels along their four borders."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                scene, ty, tx, h, w = (batch.column(c)[r].as_py() for c in ("scene", "tile_y", "tile_x", "h", "w"))
                values = batch.column("mask")[r].values
                mask = np.zeros((h, w), bool) if values is None else np.asarray(values, np.int64).reshape(h, w) != 0
                own = kernels.components(mask)
                y, x = ty * tile + own // w, tx * tile + own % w
                label = np.where(own >= 0, y * width + x, -1)
                names, area = np.unique(label[label >= 0], return_counts=True)
                parts = pa.array([[{"label": int(n), "area": int(a)} for n, a in zip(names, area, strict=True)]], pa.list_(_PART))
                sides = [label[0], label[-1], label[:, 0], label[:, -1]]
                lists = [pa.array([s], pa.list_(pa.int64())) for s in (label.ravel(), *sides)]
                keys = [pa.array([v], t) for v, t in ((scene, pa.string()), (ty, pa.int32()), (tx, pa.int32()), (h, pa.int32()), (w, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*keys, parts, *lists], [*_COLUMNS])

    return run


_PART = pa.struct([("label", pa.int64()), ("area", pa.int64())])
_COLUMNS = ("scene", "tile_y", "tile_x", "h", "w", "parts", "label", "top", "bottom", "left", "right")
_LABELLED = f"{_TILE}, h int, w int, parts array<struct<label: long, area: long>>, label array<long>, " + ", ".join(
    f"{s} array<long>" for s in ("top", "bottom", "left", "right")
)


def labelled_tiles(tiles: DataFrame, tile: int, width: int) -> DataFrame:
    """A table of ``tiles``, each labelled alone by the pixel numbers of scenes ``width`` wide."""
    tiles = tiles.select(F.col("scene").cast("string"), F.col("tile_y").cast("int"), F.col("tile_x").cast("int"), F.col("h").cast("int"), F.col("w").cast("int"), "mask")
    wrong = tiles.where((F.col("tile_x") * tile + F.col("w") > width) | (F.greatest("h", "w") > tile))
    again = tiles.groupBy("scene", "tile_y", "tile_x").count().where("count > 1")
    for bad, what in ((wrong, f"is larger than {tile} or beyond the width of {width}"), (again, "is there more than once")):
        row = bad.first()
        if row:
            raise ValueError(f"tile {row.tile_y}, {row.tile_x} of scene {row.scene} {what}")
    return staged(tiles.mapInArrow(_labelled(tile, width), _LABELLED), "labelled-tiles")


def border_links(labelled: DataFrame) -> DataFrame:
    """(a, b): nodes (scene, label) of parts that touch across a border of two tiles."""

    def meets(one: str, other: str, dy: int, dx: int) -> DataFrame:
        a = labelled.select("scene", "tile_y", "tile_x", F.col(one).alias("_a"))
        b = labelled.select("scene", (F.col("tile_y") - dy).alias("tile_y"), (F.col("tile_x") - dx).alias("tile_x"), F.col(other).alias("_b"))
        pairs = F.array_distinct(F.filter(F.arrays_zip("_a", "_b"), lambda p: (p["_a"] >= 0) & (p["_b"] >= 0)))
        return a.join(b, ["scene", "tile_y", "tile_x"]).select("scene", F.explode(pairs).alias("p"))

    both = meets("bottom", "top", 1, 0).union(meets("right", "left", 0, 1))
    node = lambda c: F.struct("scene", F.col(f"p.{c}").alias("label"))
    return both.select(node("_a").alias("a"), node("_b").alias("b"))


def part_components(labelled: DataFrame) -> DataFrame:
    """(scene, label, comp_id) of every part that a border joins to another: a table."""
    found = connected_components(border_links(labelled), "scene-components")
    return staged(found.select("node.scene", "node.label", F.col("component.label").alias("comp_id")), "scene-parts")


def components(tiles: DataFrame, tile: int, width: int) -> DataFrame:
    """(scene, comp_id, area) of the 4-connected fields of whole scenes."""
    labelled = labelled_tiles(tiles, tile, width)
    parts = labelled.select("scene", F.explode("parts").alias("p")).select("scene", "p.label", "p.area")
    joined = parts.join(part_components(labelled), ["scene", "label"], "left")
    return joined.groupBy("scene", F.coalesce("comp_id", "label").alias("comp_id")).agg(F.sum("area").alias("area"))


def labels(tiles: DataFrame, tile: int, width: int) -> DataFrame:
    """(scene, tile_y, tile_x, h, w, label): every tile with the component of each pixel, -1 outside fields.

    A tile gets the new names of its own parts that have one: no more than pixels on its border.
    """
    labelled = labelled_tiles(tiles, tile, width)
    keys = ["scene", "tile_y", "tile_x"]
    own = labelled.select(*keys, F.explode("parts.label").alias("label"))
    names = own.join(part_components(labelled), ["scene", "label"]).where("label <> comp_id")
    names = names.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("label", "comp_id"))).alias("_names"))
    new = F.transform("label", lambda v: F.coalesce(F.element_at("_names", v), v))
    out = labelled.select(*keys, "h", "w", "label").join(names, keys, "left")
    return out.select(*keys, "h", "w", F.when(F.col("_names").isNull(), F.col("label")).otherwise(new).alias("label"))
