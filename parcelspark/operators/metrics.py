"""Counts, ratios and averages over patches and countries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import METRICS, THRESHOLDS
from ..sources.shared import staged
from .scoring import matched, measured
from .selection import percentiles


def ratio(n: Column, d: Column) -> Column:
    """0 over an empty denominator."""
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """2PR / (P + R), or 0 where both are."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return ratio(2 * p * r, p + r)


def with_ratios(df: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": f1(tp, fp, fn)})


def confusion(df: DataFrame, by: list[str], truth: Column, found: Column) -> DataFrame:
    """tp, fp, fn of a class, with IoU, precision and recall."""
    counts = df.groupBy(*by).agg(
        F.count_if(truth & found).alias("tp"), F.count_if(~truth & found).alias("fp"), F.count_if(truth & ~found).alias("fn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"iou": ratio(tp, tp + fp + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})


def pixel_confusion(rasters: DataFrame, by: list[str], ignore: int = 3) -> DataFrame:
    """Confusion of the field class over pixels, counted in each raster first: pixels are not exploded."""
    both = F.arrays_zip(F.col("gt").alias("g"), F.col("pred").alias("p"))
    valid = F.filter(both, lambda z: z["g"] != ignore)
    count = lambda f: F.size(F.filter(valid, f)).cast("long")
    counts = rasters.select(
        *by,
        count(lambda z: (z["g"] == 1) & (z["p"] == 1)).alias("tp"),
        count(lambda z: (z["g"] != 1) & (z["p"] == 1)).alias("fp"),
        count(lambda z: (z["g"] == 1) & (z["p"] != 1)).alias("fn"),
    )
    counts = counts.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"iou": ratio(tp, tp + fp + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})


def match_counts(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(country, tp, fp, fn) at one threshold."""
    tp = F.size(matched(F.col("pairs"), threshold))
    return scored.groupBy("country").agg(
        F.sum(tp).alias("tp"), F.sum(F.col("n_pred") - tp).alias("fp"), F.sum(F.col("n_gt") - tp).alias("fn")
    )


def match_grid(scored: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """(country, threshold in percent, tp, fp, fn): all thresholds from one pass over the pairs."""
    tp = F.array(*(F.struct(F.lit(t).alias("t"), F.size(matched(F.col("pairs"), t / 100)).alias("tp")) for t in thresholds))
    each = scored.select("country", "n_gt", "n_pred", F.explode(tp).alias("x"))
    return each.groupBy("country", F.col("x.t").alias("threshold")).agg(
        F.sum("x.tp").alias("tp"), F.sum(F.col("n_pred") - F.col("x.tp")).alias("fp"), F.sum(F.col("n_gt") - F.col("x.tp")).alias("fn")
    )


def panoptic(scored: DataFrame) -> DataFrame:
    """Per country: patches, counts at 0.5, segmentation (SQ), recognition (RQ) and panoptic (PQ) quality."""
    pairs = matched(F.col("pairs"), 0.5)
    tp = F.size(pairs)
    quality = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["iou"].cast("double"))
    counts = scored.groupBy("country").agg(
        F.count("*").alias("n_patches"),
        F.sum(tp).alias("tp"),
        F.sum(F.col("n_pred") - tp).alias("fp"),
        F.sum(F.col("n_gt") - tp).alias("fn"),
        F.sum(quality).alias("_iou"),
    )
    out = counts.withColumns({"sq": ratio(F.col("_iou"), F.col("tp")), "rq": f1(F.col("tp"), F.col("fp"), F.col("fn"))}).drop("_iou")
    return out.withColumn("pq", F.col("sq") * F.col("rq"))


def f1_grid(scored: DataFrame) -> DataFrame:
    """Per country: mean F1 over the thresholds."""
    return with_ratios(match_grid(scored)).groupBy("country").agg(F.avg("f1").alias("ap_5_95"))


def _delta() -> Column:
    return F.abs(F.col("n_pred") - F.col("n_gt"))


def _distances(metres: float) -> Column:
    """Boundary distances of a patch's pairs matched at 0.5."""
    return F.transform(matched(F.col("pairs"), 0.5), lambda p: p["chamfer"] * metres)


def count_delta(scored: DataFrame) -> DataFrame:
    """Per country: mean and median difference of the numbers of fields."""
    each = staged(scored.select("country", _delta().alias("value"), F.lit(0.5).alias("share")), "count-deltas")
    middle = percentiles(each, ["country"], out="polygon_count_delta_median")
    return each.groupBy("country").agg(F.avg("value").alias("polygon_count_delta_mean")).join(middle, "country", "left")


def boundary_error(scored: DataFrame, metres: float = 3.0) -> DataFrame:
    """Per country: mean and 95th percentile of matched pairs' boundary distance; null without pairs."""
    each = scored.select("country", F.explode_outer(_distances(metres)).alias("value"), F.lit(0.95).alias("share"))
    each = staged(each, "boundary-distances")
    high = percentiles(each, ["country"], out="boundary_error_m_p95")
    return each.groupBy("country").agg(F.avg("value").alias("boundary_error_m_mean")).join(high, "country", "left")


def object_metrics(scored: DataFrame, metres: float = 3.0) -> DataFrame:
    """All object metrics of every country from the staged rows ``scored`` (with chamfer).

    Counts are one aggregation of partial sums; the median and the 95th percentile
    are selected together. Without a matched pair the boundary error is NaN.
    """
    pairs = matched(F.col("pairs"), 0.5)
    tp = lambda t: F.size(matched(F.col("pairs"), t / 100)).cast("long")
    quality = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["iou"].cast("double"))
    distances = F.filter(_distances(metres), lambda d: d.isNotNull())
    total = F.aggregate(distances, F.lit(0.0), lambda a, d: a + d)
    out = scored.groupBy("country").agg(
        F.count("*").alias("n_patches"), F.sum("n_gt").alias("n_gt"), F.sum("n_pred").alias("n_pred"), F.sum(quality).alias("iou"),
        *(F.sum(tp(t)).alias(f"tp_{t}") for t in THRESHOLDS),
        F.avg(_delta()).alias("polygon_count_delta_mean"), F.sum(total).alias("far"), F.sum(F.size(distances)).alias("n_far"),
    )
    one = F.struct(F.lit("polygon_count_delta_median").alias("name"), _delta().cast("double").alias("value"), F.lit(0.5).alias("share"))
    far = F.transform(distances, lambda d: F.struct(F.lit("boundary_error_m_p95").alias("name"), d.alias("value"), F.lit(0.95).alias("share")))
    each = scored.select("country", F.explode(F.concat(F.array(one), far)).alias("x")).select("country", "x.*")
    selected = percentiles(each, ["country", "name"])
    names = ("polygon_count_delta_median", "boundary_error_m_p95")
    selected = selected.groupBy("country").agg(*(F.max(F.when(F.col("name") == n, F.col("percentile"))).alias(n) for n in names))
    out = out.join(selected, "country", "left")
    nan = F.lit(float("nan"))
    out = out.withColumns(
        {
            "boundary_error_m_mean": F.when(F.col("n_far") > 0, F.col("far") / F.col("n_far")).otherwise(nan),
            "boundary_error_m_p95": F.coalesce("boundary_error_m_p95", nan),
        }
    )
    counts_at = lambda t: (F.col(f"tp_{t}"), F.col("n_pred") - F.col(f"tp_{t}"), F.col("n_gt") - F.col(f"tp_{t}"))
    hit, spare, missed = counts_at(THRESHOLDS[0])
    out = out.withColumns(
        {
            "precision": ratio(hit, hit + spare), "recall": ratio(hit, hit + missed), "f1": f1(hit, spare, missed), "pq_sq": ratio(F.col("iou"), hit),
            "pq_rq": f1(hit, spare, missed), "ap_5_95": sum((f1(*counts_at(t)) for t in THRESHOLDS), F.lit(0.0)) / len(THRESHOLDS),
        }
    )
    return out.withColumn("pq", F.col("pq_sq") * F.col("pq_rq")).drop("iou", "n_gt", "n_pred", "far", "n_far", *(f"tp_{t}" for t in THRESHOLDS))


def country_metrics(rasters: DataFrame, watershed: bool = True, metres: float = 3.0, checkpoint: str = "", h: float = 2.0) -> DataFrame:
    """The whole metrics row of every country. Without watershed its columns are null.

    ``rasters`` is read once: what its patches give is a table, from which all metrics come.
    """
    scored = staged(measured(rasters, watershed, h), "measured-patches")
    return of_measured(scored, watershed, metres, checkpoint)


def of_measured(scored: DataFrame, watershed: bool, metres: float, checkpoint: str) -> DataFrame:
    """The metrics rows from the table of ``measured`` patches."""
    out = object_metrics(scored, metres)
    pixels = scored.groupBy("country").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    pixels = pixels.select(
        "country", ratio(tp, tp + fp + fn).alias("pixel_level_iou"), ratio(tp, tp + fp).alias("pixel_level_precision"), ratio(tp, tp + fn).alias("pixel_level_recall")
    )
    out = out.join(pixels, "country", "left")
    names = ("precision", "recall", "f1")
    if watershed:
        plain = scored.select("country", "n_gt", F.col("plain_n_pred").alias("n_pred"), F.col("plain_pairs").alias("pairs"))
        plain = with_ratios(match_counts(plain)).select("country", *(F.col(c).alias(f"object_pix_{c}") for c in names))
        out = out.join(plain, "country", "left").withColumnsRenamed({c: f"object_ws_{c}" for c in names})
    else:
        out = out.withColumnsRenamed({c: f"object_pix_{c}" for c in names})
        out = out.withColumns({f"object_ws_{c}": F.lit(None).cast("double") for c in names})
    return out.select(F.lit(checkpoint).alias("checkpoint"), "country", "n_patches", *METRICS)


def macro_average(rows: DataFrame, countries, metrics: list[str], country: str = "country") -> DataFrame:
    """One row: the mean of every metric that is there, over rows of ``countries``; NaN and null are skipped."""
    rows = rows.where(F.col(country).isin(list(countries)))
    means = [F.avg(F.nanvl(F.col(m), F.lit(None).cast("double"))).alias(m) for m in metrics if m in rows.columns]
    return rows.agg(*means, F.count("*").alias("n_countries")).withColumn("n_expected", F.lit(len(list(countries))).cast("long"))


def epoch_means(log: DataFrame, names: list[str]) -> DataFrame:
    """(epoch, ...): means over the steps of every epoch of a training log, such as of the learning rate."""
    return log.groupBy("epoch").agg(*(F.avg(n).alias(n) for n in names))


def best_and_last(log: DataFrame, loss: str = "loss") -> DataFrame:
    """(kind, epoch, loss) of the epochs whose models are kept: that of the least loss, the first of equals, and the last."""
    real = F.nanvl(F.col(loss), F.lit(None).cast("double"))
    row = F.struct("epoch", F.col(loss).alias("loss"))
    picked = log.agg(
        F.min_by(row, F.when(real.isNotNull(), F.struct(real, F.col("epoch")))).alias("best"), F.max_by(row, F.col("epoch")).alias("last")
    )
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("row")) for k in ("best", "last")))
    return picked.select(F.explode(each).alias("x")).where("x.row is not null").select("x.kind", "x.row.*")
