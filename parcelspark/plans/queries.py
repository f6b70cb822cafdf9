"""Queries of the operators, over the driver's tables."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from .. import schemas
from ..functions import rasters as R
from ..operators import augment, kernels, metrics, records, scenes, scorers, scoring
from ..sources import catalog
from ..sources import raster_files as files
from ..sources.shared import shared_dir
from . import bindings as B


def _long(df, column="mask", name="value"):
    """A row a pixel of a flat raster."""
    return df.select("patch_id", F.posexplode(column).alias("i", name))


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def index_scan(spark, sf_dir):
    """The patch index as a file whose key is a number, read as text."""
    path = _folder(spark, "patch-index")
    B.patches(spark, sf_dir).withColumn("patch_id", F.col("patch_id").cast("long")).write.parquet(path)
    return catalog.patch_index(spark, path)


def chips_scan(spark, sf_dir):
    """Split tables, a file a country: ids are numbers in some and text in others."""
    path = _folder(spark, "chips")
    chips = B.chips(spark, sf_dir)
    names = sorted(r.country for r in B.table(spark, sf_dir, "nation").select(F.lower("n_name").alias("country")).collect())
    numbers = F.pmod(F.xxhash64("country"), F.lit(2)) == 0
    chips.where(numbers).withColumn("aoi_id", F.col("aoi_id").cast("long")).write.partitionBy("country").parquet(path)
    chips.where(~numbers).write.mode("append").partitionBy("country").parquet(path)
    there = {r.country for r in chips.select("country").distinct().collect()}
    return catalog.split_table(spark, {c: f"{path}/country={c}" for c in names if c in there})


def raster_files(spark, sf_dir):
    """Windows of scenes in TIFF files of three countries: the filter reaches the source."""
    root = _folder(spark, "scenes")
    B.scene_files(spark, sf_dir, root)
    df = files.raster_windows(spark, root, 8, ["1", "4", "7"])
    above = lambda least: F.size(F.filter("image", lambda v: v > F.lit(least).cast("float"))).alias(f"above_{least}".replace(".", "_"))
    scene = F.regexp_extract("file", r"(\d+)\.tif$", 1).cast("long").alias("scene")
    return df.select("country", scene, "top", "left", "h", "w", "bands", above(0.0), F.array_max("image").cast("double").alias("highest"))


def absent_files(spark, sf_dir):
    """An index of scenes, of which a window of the last three and all labels are not there, and split tables of none."""
    root = _folder(spark, "scenes")
    B.scene_files(spark, sf_dir, root)
    scene = B.vectors(spark, sf_dir).select(F.expr("vec_id div 16").alias("patch_id")).distinct()
    file = lambda id: F.concat(F.lit("country="), id % 10, F.lit("/"), id, F.lit(".tif"))
    index = scene.select(
        (F.col("patch_id") % 10).cast("string").alias("country"), "patch_id", file(F.col("patch_id")).alias("image_a_path"),
        file(F.col("patch_id") + 3).alias("image_b_path"), F.concat(F.lit("labels/"), "patch_id").alias("label_path"),
    )
    return catalog.absent_of_layout(spark, root, index, [str(c) for c in range(12)])


def scene_components(spark, sf_dir):
    return scenes.components(B.mosaic(spark, sf_dir), 8, 256)


def polygon_outlines(spark, sf_dir):
    df = scoring.outlines(B.rasters(spark, sf_dir))
    return df.select("country", "patch_id", "comp_id", "area", "n_holes", "n_points", (F.octet_length("wkb") - 9 - 20 * (F.col("n_holes") + 1)).alias("point_bytes"))


def raster_scan(spark, sf_dir):
    df = B.rasters(spark, sf_dir)
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, v: a + v).cast("long")
    return df.select("country", "patch_id", "h", "w", total("gt").alias("gt_pixels"), total("pred").alias("pred_pixels"))


def country_filter(spark, sf_dir):
    return records.of_countries(B.patches(spark, sf_dir), [c.upper() for c in B.COUNTRIES]).groupBy("country").agg(F.count("*").alias("n"))


def usable_filter(spark, sf_dir):
    return records.usable(B.patches(spark, sf_dir)).groupBy("country").agg(F.count("*").alias("n"))


def split_join(spark, sf_dir):
    df = records.split_records(B.patches(spark, sf_dir), B.chips(spark, sf_dir), B.COUNTRIES, "val")
    return df.select("country", "patch_id", "image_a_path")


def split_union(spark, sf_dir):
    names = ["nation_2", "nation_1", "nation_2"]
    df = records.split_union(B.patches(spark, sf_dir), B.chips(spark, sf_dir), names, "test", usable_only=False)
    return df.select("country", "patch_id")


def split_counts(spark, sf_dir):
    parts = [
        records.split_records(B.patches(spark, sf_dir), B.chips(spark, sf_dir), B.COUNTRIES, s).agg(F.lit(s).alias("split"), F.count("*").alias("n"))
        for s in records.SPLIT_NAMES
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def record_paths(spark, sf_dir):
    df = records.split_records(B.patches(spark, sf_dir), B.chips(spark, sf_dir), B.COUNTRIES, "test")
    return records.record_paths(df, B.ROOT)


def path_country(spark, sf_dir):
    path = F.concat(F.lit(f"data{B.MARKER}"), F.col("country"), F.lit("/images/window_b/"), F.col("patch_id"), F.lit(".tif"))
    df = B.patches(spark, sf_dir).select(path.alias("path"))
    return df.groupBy(records.path_country(F.col("path"), B.MARKER).alias("country")).agg(F.count("*").alias("n"))


def dense_countries(spark, sf_dir):
    held_out = B.table(spark, sf_dir, "nation").select(F.lower("n_name").alias("country")).where(F.col("country").isin(B.COUNTRIES))
    presence = spark.createDataFrame([("nation_4",)], "country string")
    return held_out.join(presence, "country", "left_anti")


def missing_countries(spark, sf_dir):
    wanted = B.table(spark, sf_dir, "nation").select(F.lower("n_name").alias("country"))
    wanted = wanted.union(spark.createDataFrame([("nowhere",)], "country string"))
    return records.absent(wanted, records.usable(B.patches(spark, sf_dir)))


def normalize(spark, sf_dir):
    df = B.vectors(spark, sf_dir).select(F.col("vec_id").alias("patch_id"), R.scaled(F.col("v"), 3000.0).alias("mask"))
    return _long(df)


def binarize(spark, sf_dir):
    df = B.class_rasters(spark, sf_dir).select("patch_id", R.binarized(F.col("pred")).alias("mask"))
    return _long(df)


def eval_relabel(spark, sf_dir):
    return _long(B.ignoring_rasters(spark, sf_dir).select("patch_id", R.eval_relabelled(F.col("gt")).alias("mask")))


def _classes(spark, sf_dir, f):
    df = B.vectors(spark, sf_dir)
    return df.select(F.col("vec_id").alias("patch_id"), R.pixel_classes(F.col("v"), 4, f).alias("mask"))


def argmax(spark, sf_dir):
    return _long(_classes(spark, sf_dir, R.argmax))


def softmax(spark, sf_dir):
    df = _long(_classes(spark, sf_dir, R.softmax), name="p")
    return df.select("patch_id", "i", F.posexplode("p").alias("class", "p")).withColumn("p", F.round("p", 9))


def clip_stack(spark, sf_dir):
    v = B.vectors(spark, sf_dir)
    a = v.select("vec_id", F.col("v").alias("a"))
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("b"))
    # The windows differ by a row and a column: both are cut to 7 x 7.
    cut = lambda c: R.window(F.col(c), F.lit(8), F.lit(8), F.lit(0), F.lit(0), F.lit(7), F.lit(7), None)
    df = a.join(b, "vec_id").select(F.col("vec_id").alias("patch_id"), R.stacked(cut("a"), cut("b")).alias("mask"))
    return _long(df)


def pad_mask(spark, sf_dir):
    size = R.padded_size(F.col("h"))
    df = B.rasters(spark, sf_dir).select("patch_id", R.padded(F.col("gt"), F.col("h"), F.col("w"), size, size, 3).alias("mask"))
    return _long(df).groupBy("patch_id", "value").agg(F.count("*").alias("n"), F.sum("i").alias("places"))


def center_crop(spark, sf_dir):
    df = B.rasters(spark, sf_dir).select("patch_id", R.centre_crop(F.col("gt"), F.col("h"), F.col("w"), 5, fill=3).alias("mask"))
    return _long(df)


def d4_transform(spark, sf_dir):
    df = B.vectors(spark, sf_dir).select(
        F.col("vec_id").alias("patch_id"), F.explode(F.array(*(F.struct(F.lit(n).alias("name"), R.turned(F.col("v"), F.lit(8), f).alias("mask")) for n, _, f in R.D4))).alias("t")
    )
    return df.select("patch_id", "t.name", F.posexplode("t.mask").alias("i", "value"))


def tta_mean(spark, sf_dir):
    """Class probabilities of a scorer that is not symmetric, averaged over the eight transforms of padded images."""
    images = B.vectors(spark, sf_dir).select(
        F.col("label").cast("string").alias("country"), F.col("vec_id").alias("patch_id"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.lit(1).alias("bands"),
        F.col("v").cast("array<float>").alias("image"),
    )
    df = scorers.probabilities(images, lambda: _leaning).select("patch_id", F.slice("p", 65, 64).alias("mask"))
    return _long(df).withColumn("value", F.round("value", 9))


def _leaning(image):
    """Two classes; the second's score grows to the right."""
    score = image[0].astype(float) * 5e4 * (1 + np.arange(image.shape[2]) % 8)
    return np.stack([np.zeros_like(score), score])


def pixel_confusion(spark, sf_dir):
    docs, labels = B.table(spark, sf_dir, "documents").select("doc_id", "lang"), B.table(spark, sf_dir, "labels")
    return metrics.confusion(docs.join(labels, "doc_id"), ["lang"], F.col("quality") == 1, F.col("toxic") == 1)


def country_confusion(spark, sf_dir):
    return metrics.pixel_confusion(B.ignoring_rasters(spark, sf_dir), ["country"])


def pixel_metrics(spark, sf_dir):
    df = B.ignoring_rasters(spark, sf_dir)
    df = df.withColumns({"gt": R.eval_relabelled(F.col("gt")), "pred": R.eval_relabelled(F.col("pred"))})
    return metrics.pixel_confusion(df, ["country"])


def components(spark, sf_dir):
    return scoring.components(B.rasters(spark, sf_dir))


def polygon_iou(spark, sf_dir):
    df = scoring.overlaps(scoring.objects(B.rasters(spark, sf_dir)))
    return df.select("country", "patch_id", "gt", "pred", "inter", F.round(F.col("iou").cast("double"), 6).alias("iou"))


def _rounded(df):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def match_at_05(spark, sf_dir):
    df = scoring.objects(B.rasters(spark, sf_dir))
    pairs = df.select("patch_id", F.explode(scoring.matched(F.col("pairs"), 0.5)).alias("p"))
    return pairs.select("patch_id", "p.gt", "p.pred", F.round(F.col("p.iou").cast("double"), 6).alias("iou"))


def match_in_order(spark, sf_dir):
    df = scoring.objects(B.rasters(spark, sf_dir))
    pairs = df.select("patch_id", F.explode(scoring.matched_in_order(F.col("pairs"), 0.5)).alias("p"))
    return pairs.select("patch_id", "p.gt", "p.pred")


def match_grid(spark, sf_dir):
    return metrics.match_grid(scoring.objects(B.rasters(spark, sf_dir)))


def f1_grid(spark, sf_dir):
    return _rounded(metrics.f1_grid(scoring.objects(B.rasters(spark, sf_dir))))


def object_pix_f1(spark, sf_dir):
    return _rounded(metrics.with_ratios(metrics.match_counts(scoring.objects(B.class_rasters(spark, sf_dir)))))


def object_ws_f1(spark, sf_dir):
    return _rounded(metrics.with_ratios(metrics.match_counts(scoring.objects(B.class_rasters(spark, sf_dir), watershed=True))))


def panoptic_quality(spark, sf_dir):
    return _rounded(metrics.panoptic(scoring.objects(B.rasters(spark, sf_dir))))


def count_delta(spark, sf_dir):
    return _rounded(metrics.count_delta(scoring.objects(B.rasters(spark, sf_dir))))


def boundary_pixels(spark, sf_dir):
    df = scoring.masks(B.rasters(spark, sf_dir), lambda grid: _edges(kernels.components(grid("gt") == 1)))
    return _long(df).where("value >= 0")


def _edges(label):
    return np.where(kernels.edges_of(label), label, -1)


def chamfer(spark, sf_dir):
    df = scoring.overlaps(scoring.objects(B.rasters(spark, sf_dir), chamfer=True)).where("chamfer is not null")
    return df.select("patch_id", "gt", "pred", F.round("chamfer", 6).alias("chamfer"))


def boundary_error(spark, sf_dir):
    return _rounded(metrics.boundary_error(scoring.objects(B.rasters(spark, sf_dir), chamfer=True)))


def distance_transform(spark, sf_dir):
    df = scoring.values(B.class_rasters(spark, sf_dir), lambda grid: _finite(kernels.distance(grid("pred") != 2)))
    return df.select("patch_id", "y", "x", F.round("value", 6).alias("value"))


def _finite(d):
    return np.where(np.isinf(d), np.nan, d)


def watershed_mask(spark, sf_dir):
    df = scoring.masks(
        B.class_rasters(spark, sf_dir), lambda grid: kernels.watershed_mask(grid("pred"), kernels.distance(grid("pred") != 2))
    )
    return _long(df).where("value = 1").drop("value")


def watershed_instances(spark, sf_dir):
    """Sizes of the instances of every patch."""
    df = scoring.masks(
        B.class_rasters(spark, sf_dir), lambda grid: kernels.watershed_instances(grid("pred"), kernels.distance(grid("pred") != 2))
    )
    return _long(df).where("value > 0").groupBy("patch_id", "value").agg(F.count("*").alias("n"))


def dilate_boundary(spark, sf_dir):
    return _long(scoring.masks(B.ignoring_rasters(spark, sf_dir), lambda grid: kernels.dilated(grid("gt"), 1)))


def band_gamma(spark, sf_dir):
    df = B.vectors(spark, sf_dir).select(F.col("vec_id").alias("patch_id"), R.gamma(F.col("v"), 0.8).alias("mask"))
    return _long(df).withColumn("value", F.round("value", 9))


def band_affine(spark, sf_dir):
    df = B.vectors(spark, sf_dir).select(F.col("vec_id").alias("patch_id"), R.affine(F.col("v"), 1.1, -0.02).alias("mask"))
    return _long(df).withColumn("value", F.round("value", 9))


def window_dropout(spark, sf_dir):
    df = B.vectors(spark, sf_dir)
    return _long(df.select(F.col("vec_id").alias("patch_id"), R.window_dropped(F.col("v"), F.col("vec_id") % 2 == 0).alias("mask")))


def gaussian_blur(spark, sf_dir):
    df = B.vectors(spark, sf_dir)
    blurred = R.blurred(F.col("v"), F.lit(8), F.lit(8), 1.0)
    return _long(df.select(F.col("vec_id").alias("patch_id"), blurred.alias("mask"))).withColumn("value", F.round("value", 9))


#: A plan without changes.
STILL = {"scale": 1.0, "rotate": 0.0, "flip": 0.0, "sharpen": 0.0, "resized_crop": 0.0}


def _drawn(name, low=0.0, high=1.0, index=None):
    """Draws that SQL can repeat: of the number of a sample and the length of the name."""
    at = F.col("patch_id") * 7 + 13 * len(name)
    at = at if index is None else at + index * 31
    return F.lit(low) + (F.pmod(at, F.lit(97)) + 0.5) / 97 * (high - low)


def _changed(spark, sf_dir, bands=1, training=True, **plan):
    side = 8 if bands == 1 else 4
    df = B.vectors(spark, sf_dir).select(
        F.col("vec_id").alias("patch_id"), F.lit(side).alias("h"), F.lit(side).alias("w"), F.lit(bands).alias("bands"), F.col("v").alias("image"),
        F.slice(F.transform("v", B.three_classes), 1, side * side).alias("mask"),
    )
    return augment.augmented(df, 0, plan=augment.Plan(**STILL | plan), training=training, draw=_drawn)


def _values(df):
    return df.select("patch_id", F.posexplode("image").alias("i", "value")).withColumn("value", F.round(F.col("value").cast("double"), 6))


def _values_and_classes(df):
    each = df.select("patch_id", F.posexplode(F.arrays_zip(F.col("image").alias("v"), F.col("mask").alias("c"))).alias("i", "z"))
    return each.select("patch_id", "i", F.round(F.col("z.v").cast("double"), 6).alias("value"), F.col("z.c").alias("class"))


def random_divisor(spark, sf_dir):
    return _values(_changed(spark, sf_dir, random_scale=True, scale=3.0))


def rotate_image(spark, sf_dir):
    return _values_and_classes(_changed(spark, sf_dir, rotate=0.5))


def small_rotate_image(spark, sf_dir):
    return _values_and_classes(_changed(spark, sf_dir, small_rotate=0.5))


def shear_image(spark, sf_dir):
    return _values_and_classes(_changed(spark, sf_dir, shear=0.3))


def resized_crop_image(spark, sf_dir):
    return _values_and_classes(_changed(spark, sf_dir, resized_crop=0.5))


def sharpen_image(spark, sf_dir):
    return _values(_changed(spark, sf_dir, sharpen=0.5))


def noise_image(spark, sf_dir):
    return _values(_changed(spark, sf_dir, noise=0.3))


def jitter_boundary(spark, sf_dir):
    return _long(_changed(spark, sf_dir, jitter=0.5))


def training_changes(spark, sf_dir):
    """Four bands under flips, exponents, factors and a dropped window for training, and only scaled else; the plan is read from a file."""
    path = _folder(spark, "plan")
    spark.createDataFrame([('{"scale": 2.0, "flip": 0.5, "gamma": 0.3, "affine": 0.3, "drop_window": 0.5}',)], "value string").coalesce(1).write.text(path)
    plan = {k: v for k, v in vars(augment.Plan.read(spark, path)).items() if k in ("scale", "flip", "gamma", "affine", "drop_window")}
    parts = [_values(_changed(spark, sf_dir, 4, t, **plan)).withColumn("training", F.lit(t)) for t in (True, False)]
    return parts[0].unionByName(parts[1])


def eval_batches(spark, sf_dir):
    df = records.batches(B.patches(spark, sf_dir), 64)
    return df.select("country", "patch_id", "batch", "place")


def reader_shares(spark, sf_dir):
    """Patches dealt to seven readers in the order of country and patch."""
    df = records.dealt(B.patches(spark, sf_dir), 32, 7, training=False)
    return df.groupBy("reader", "batch").agg(F.count("*").alias("n"), F.min("place").alias("first"), F.max("place").alias("last"), F.min("patch_id").alias("least"))


def record_at(spark, sf_dir):
    parts = [records.nth(B.patches(spark, sf_dir), k).select("country", "patch_id").withColumn("nth", F.lit(k)) for k in (0, 100)]
    return parts[0].unionByName(parts[1])


def epoch_means(spark, sf_dir):
    log = B.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("epoch"), F.col("l_discount").alias("rate"))
    return _rounded(metrics.epoch_means(log, ["rate"]))


def epochs_kept(spark, sf_dir):
    log = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("epoch"), F.col("o_totalprice").alias("loss"))
    return metrics.best_and_last(log)


def _no_weights():
    raise KeyError("weights of another kind")


def _above():
    """A scorer of field where a 10 m image is above PRED."""
    return lambda image: np.stack([np.zeros(image.shape[1:]), (image[0].astype(float) * 3000 - B.PRED) * 1e3])


def evaluate_scorer(spark, sf_dir):
    """From images of the 10 m source, through a scorer that is the second choice, to metrics rows."""
    images = B.rasters(spark, sf_dir).drop("pred").join(
        B.vectors(spark, sf_dir).select(F.col("vec_id").cast("string").alias("patch_id"), F.lit(1).alias("bands"), F.col("v").cast("array<float>").alias("image")), "patch_id"
    )
    rows = scorers.evaluated(images, scorers.first_that_works(_no_weights, _above), "10m", watershed=False, least=32)
    rows = rows.select("country", "n_patches", "pixel_level_iou", "object_pix_f1", "pq_sq", "pq_rq", "pq", "polygon_count_delta_mean")
    return _rounded(rows)


def metrics_scan(spark, sf_dir):
    """Rows written as a metrics file and read again: six decimals, nan and empty."""
    path = f"{shared_dir(spark)}/metrics-{uuid.uuid4().hex}"
    catalog.write_metrics(B.metrics_file(spark, sf_dir), path)
    back = catalog.by_country(catalog.metrics(spark, path))
    # NaN is given as -1: it differs from itself.
    return back.select("checkpoint", "country", "n_patches", *(F.nanvl(m, F.lit(-1.0)).alias(m) for m in schemas.METRICS))


def metrics_format(spark, sf_dir):
    return catalog.formatted(B.metrics_file(spark, sf_dir), list(schemas.METRICS))


def macro_average(spark, sf_dir):
    names = [c for c in B.COUNTRIES if c != "nation_4"] + ["nowhere"]
    return _rounded(metrics.macro_average(B.metric_rows(spark, sf_dir), names, ["pixel_level_iou", "object_ws_f1", "pq", "absent"]))


def summary_report(spark, sf_dir):
    from ..report import summary

    means = metrics.macro_average(B.metric_rows(spark, sf_dir), B.COUNTRIES, list(schemas.METRICS))
    return summary(means, "dense10").select("place", "label", F.round("value", 4).alias("value"), "published")


QUERIES = {
    f.__name__: f
    for f in (
        index_scan, chips_scan, raster_scan, raster_files, absent_files, scene_components, polygon_outlines, country_filter, usable_filter, split_join, split_union, split_counts, record_paths, path_country,
        dense_countries, missing_countries, normalize, binarize, eval_relabel, argmax, softmax, clip_stack, pad_mask, center_crop, d4_transform,
        tta_mean, pixel_confusion, country_confusion, pixel_metrics, components, polygon_iou, match_at_05, match_in_order, match_grid, f1_grid,
        object_pix_f1, object_ws_f1, panoptic_quality, count_delta, boundary_pixels, chamfer, boundary_error, distance_transform, watershed_mask,
        watershed_instances, dilate_boundary, band_gamma, band_affine, window_dropout, gaussian_blur,
        random_divisor, rotate_image, small_rotate_image, shear_image, resized_crop_image, sharpen_image, noise_image, jitter_boundary, training_changes,
        eval_batches, reader_shares, record_at, epoch_means, epochs_kept, evaluate_scorer,
        metrics_scan, metrics_format, macro_average,
        summary_report,
    )
}
