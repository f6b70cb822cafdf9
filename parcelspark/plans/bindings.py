"""The driver's tables as patches, splits, rasters and metrics."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import METRICS
from ..sources import tiff

#: Where fields begin: of the truth, and of the prediction.
GT, PRED = 0.0, 0.02
ROOT = "/data/imagery"
MARKER = "/fields/"
COUNTRIES = [f"nation_{i}" for i in range(10)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _countries(spark, sf_dir) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.lower("n_name").alias("country"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return orders.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))


def patches(spark, sf_dir) -> DataFrame:
    file = F.concat(F.col("o_orderkey").cast("string"), F.lit(".tif"))
    return _countries(spark, sf_dir).select(
        "country",
        F.col("o_orderkey").cast("string").alias("patch_id"),
        (F.col("o_orderstatus") != "P").alias("usable_pair"),
        F.concat(F.lit("window_a/"), file).alias("image_a_path"),
        F.concat(F.lit("window_b/"), file).alias("image_b_path"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("/labels/"), file)).otherwise(F.concat(F.lit("labels/"), file)).alias("label_path"),
    )


def chips(spark, sf_dir) -> DataFrame:
    keys = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    split = F.when(F.col("l_orderkey") % 10 == 0, "val").when(F.col("l_orderkey") % 10 == 1, "test").otherwise("train")
    placed = keys.join(_countries(spark, sf_dir).select("o_orderkey", "country"), F.col("l_orderkey") == F.col("o_orderkey"))
    return placed.select("country", F.col("l_orderkey").cast("string").alias("aoi_id"), split.alias("split"))


def vectors(spark, sf_dir) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", v.alias("v"))


def _rasters(spark, sf_dir, gt, pred) -> DataFrame:
    return vectors(spark, sf_dir).select(
        F.col("label").cast("string").alias("country"),
        F.col("vec_id").cast("string").alias("patch_id"),
        F.lit(8).alias("h"),
        F.lit(8).alias("w"),
        F.transform("v", gt).alias("gt"),
        F.transform("v", pred).alias("pred"),
    )


def three_classes(v):
    return F.when(v > PRED, 1).when(v > GT, 2).otherwise(0)


def rasters(spark, sf_dir) -> DataFrame:
    """8 x 8 field masks: above GT the truth, above PRED the prediction."""
    return _rasters(spark, sf_dir, lambda v: (v > GT).cast("int"), lambda v: (v > PRED).cast("int"))


def class_rasters(spark, sf_dir) -> DataFrame:
    """The prediction has boundaries between PRED and GT."""
    return _rasters(spark, sf_dir, lambda v: (v > GT).cast("int"), three_classes)


def ignoring_rasters(spark, sf_dir) -> DataFrame:
    """The truth has boundaries, and a pixel in 17 is ignored."""
    df = _rasters(spark, sf_dir, three_classes, lambda v: (v > PRED).cast("int"))
    ignored = lambda v, i: F.when((F.col("patch_id").cast("long") + F.floor(i / 8) + i % 8) % 17 == 0, 3).otherwise(v)
    return df.withColumn("gt", F.transform("gt", ignored))


def metric_rows(spark, sf_dir) -> DataFrame:
    """Per nation: averages of its orders, some of them NaN or null."""
    rows = _countries(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_k"), "o_totalprice"), F.col("o_orderkey") == F.col("_k"))
    by = rows.groupBy("country").agg(F.count("*").alias("n_patches"), F.round(F.avg("o_totalprice") / 1e6, 6).alias("price"))
    nan, null = F.lit(float("nan")), F.lit(None).cast("double")
    return by.select(
        "country",
        "n_patches",
        F.when(F.col("country") == "nation_3", nan).otherwise(F.col("price")).alias("pixel_level_iou"),
        F.when(F.col("country") == "nation_5", null).otherwise(F.col("price") / 2).alias("object_ws_f1"),
        (F.col("price") / 4).alias("pq"),
    )


def metrics_file(spark, sf_dir) -> DataFrame:
    """``metric_rows`` with all columns of a metrics file: the others are parts of the price."""
    rows = metric_rows(spark, sf_dir)
    more = {m: F.col("pq") * 4 / (i + 2) for i, m in enumerate(METRICS) if m not in rows.columns}
    return rows.withColumns(more).select(F.lit("c").alias("checkpoint"), "country", "n_patches", *METRICS)


#: Vectors in a scene, side by side in rows of SCENE_SIDE, and pixels of a tile of its file.
SCENE_SIDE, TILE = 4, 16


def tiled_tiff(image: np.ndarray, tile: int = TILE) -> bytes:
    """A TIFF of packed tiles of one float image whose sides are whole tiles."""
    h, w = image.shape
    tiles = [zlib.compress(image[y : y + tile, x : x + tile].astype("<f4").tobytes()) for y in range(0, h, tile) for x in range(0, w, tile)]
    ends = np.cumsum([8, *map(len, tiles)]).tolist()
    tags = tiff.WIDTH, tiff.HEIGHT, tiff.BITS, tiff.COMPRESSION, tiff.SAMPLES, tiff.TILE_WIDTH, tiff.TILE_HEIGHT, tiff.TILE_AT, tiff.TILE_SIZE, tiff.FORMAT
    values = [w], [h], [32], [8], [1], [tile], [tile], ends[:-1], [len(t) for t in tiles], [3]
    after, entries, far = ends[-1] + 2 + 12 * len(tags) + 4, b"", b""
    for tag, v in zip(tags, values, strict=True):
        raw = struct.pack(f"<{len(v)}I", *v)
        if len(raw) > 4:
            raw, far = struct.pack("<I", after + len(far)), far + raw
        entries += struct.pack("<HHI", tag, 4, len(v)) + raw
    return struct.pack("<2sHI", b"II", 42, ends[-1]) + b"".join(tiles) + struct.pack("<H", len(tags)) + entries + bytes(4) + far


def scene_files(spark, sf_dir, root: str) -> int:
    """Writes the vectors as scenes under ``root``, a file for 16 ids, in folders by country; returns their number."""
    n = SCENE_SIDE * SCENE_SIDE

    def write(table):
        system, folder = fs.FileSystem.from_uri(root)
        image = np.zeros((8 * SCENE_SIDE, 8 * SCENE_SIDE), np.float32)
        for place, v in zip(table.column("place").to_pylist(), table.column("v").to_pylist(), strict=True):
            y, x = 8 * (place // SCENE_SIDE), 8 * (place % SCENE_SIDE)
            image[y : y + 8, x : x + 8] = np.reshape(v, (8, 8))
        scene = table.column("scene")[0].as_py()
        system.create_dir(f"{folder}/country={scene % 10}", recursive=True)
        with system.open_output_stream(f"{folder}/country={scene % 10}/{scene}.tif") as out:
            out.write(tiled_tiff(image))
        return pa.table({"scene": [scene]})

    placed = vectors(spark, sf_dir).select(F.expr(f"vec_id div {n}").alias("scene"), (F.col("vec_id") % n).cast("int").alias("place"), "v")
    return placed.groupBy("scene").applyInArrow(write, "scene long").count()


def mosaic(spark, sf_dir, across: int = 32) -> DataFrame:
    """The prediction's field masks as tiles of two scenes: the vectors of five labels in each, with gaps where others are."""
    return vectors(spark, sf_dir).select(
        F.expr("label div 5").cast("string").alias("scene"),
        F.expr(f"vec_id div {across}").alias("tile_y"),
        (F.col("vec_id") % across).alias("tile_x"),
        F.lit(8).alias("h"),
        F.lit(8).alias("w"),
        F.transform("v", lambda v: (v > PRED).cast("int")).alias("mask"),
    )
