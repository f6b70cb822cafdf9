"""Exact percentiles of groups of any size, by narrowing ranges of values.

Equal values are counted first, in a shuffle by group and value. The ranks that a
percentile lies between are then looked for in every group at once: the values
that can hold a rank are counted by RANGES equal ranges, and the range with the
rank becomes the next to be looked at, until it holds FEW different values. No task
gets the values of a group; what meets are its RANGES counts, and FEW values in the
end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import staged

#: Ranges a step; a step makes what is left so many times narrower.
RANGES = 1024
#: Different values that are looked through in one task.
FEW = 4096
#: Groups whose bounds are sent to all tasks; more are joined by a shuffle.
SENT = 10_000


def percentiles(values: DataFrame, by: list[str], value: str = "value", share: str = "share", out: str = "percentile") -> DataFrame:
    """(*by, out): for each group the percentile ``share`` (0 to 1, one a group) of ``value``, linear between two ranks.

    Null and NaN values count for nothing; a group without others has no row.
    """
    v = F.col(value).cast("double")
    counted = values.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by, v.alias("_v")).agg(F.count("*").alias("_n"), F.first(share).alias("_share"))
    counted = staged(counted, "value-counts")
    groups = counted.groupBy(*by).agg(
        F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_values"), F.sum("_n").alias("_all"), F.first("_share").alias("_share")
    )
    place = F.col("_share") * (F.col("_all") - 1)
    ranks = F.array(*(F.struct(F.lit(i).alias("_which"), r.cast("long").alias("_rank")) for i, r in enumerate((F.floor(place), F.ceil(place)))))
    bounds = groups.select(*by, "_low", "_high", "_values", (place - F.floor(place)).alias("_part"), F.explode(ranks).alias("_r"), F.lit(0).cast("long").alias("_before"))
    bounds = staged(bounds.select(*by, "_low", "_high", "_values", "_part", "_r.*", "_before"), "value-bounds")
    keys = [*by, "_which"]
    own = [*keys, "_part", "_rank", "_before"]
    while True:
        n, most = bounds.agg(F.count("*"), F.coalesce(F.max("_values"), F.lit(0))).first()
        inside = counted.drop("_share").join(F.broadcast(bounds) if n <= 2 * SENT else bounds, by).where("_v between _low and _high")
        if most <= FEW:
            break
        # Halves first, so that the difference of two large values can't overflow.
        along = F.when(F.col("_low") < F.col("_high"), (F.col("_v") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2)).otherwise(0.0)
        step = F.least(F.floor(along * RANGES), F.lit(RANGES - 1))
        ranged = inside.groupBy(*own, step.alias("_step")).agg(
            F.sum("_n").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_values")
        )
        found = _holding(ranged, keys, "_step")
        bounds = staged(found.select(*by, "_low", "_high", "_values", "_part", "_which", "_rank", (F.col("_upto") - F.col("_n")).alias("_before")), "value-bounds")
    found = _holding(inside, keys, "_v")
    at = lambda i: F.max(F.when(F.col("_which") == i, F.col("_v")))
    return found.groupBy(*by).agg((at(0) + (at(1) - at(0)) * F.first("_part")).alias(out))


def _holding(parts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of parts with numbers ``_n`` of values, in ``order``, the one of each key that holds its rank, with the number of values up to its end."""
    upto = F.col("_before") + F.sum("_n").over(W.partitionBy(*keys).orderBy(order))
    return parts.withColumn("_upto", upto).where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n")))
