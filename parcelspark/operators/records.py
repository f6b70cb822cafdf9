"""Which patches a split holds, and where their files are."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import staged

SPLIT_NAMES = ("train", "val", "test")


def named(countries: str | list[str]) -> list[str]:
    """Countries asked for, in lower case; the index is compared as it stands."""
    return [c.lower() for c in ([countries] if isinstance(countries, str) else countries)]


def of_countries(df: DataFrame, countries: str | list[str]) -> DataFrame:
    return df.where(F.col("country").isin(named(countries)))


def usable(patches: DataFrame) -> DataFrame:
    """Null counts as not usable."""
    return patches.where("usable_pair")


def split_records(patches: DataFrame, chips: DataFrame, countries, split: str, usable_only: bool = True, may_be_empty: bool = False) -> DataFrame:
    """Patches of a split: the index joined to its chips by country and patch.

    Filters come before the join and reach the scans; the join is left to Spark,
    which broadcasts the chips while they are small. A split without any record is
    a ValueError here and now, unless it may be empty.
    """
    if split not in SPLIT_NAMES:
        raise ValueError(f"split is one of {SPLIT_NAMES}, not {split!r}")
    patches = of_countries(patches, countries)
    patches = usable(patches) if usable_only else patches
    patches = patches.withColumn("patch_id", F.col("patch_id").cast("string"))
    chips = of_countries(chips, countries).where(F.col("split") == split)
    records = patches.join(chips.select("country", F.col("aoi_id").cast("string").alias("patch_id")), ["country", "patch_id"])
    if not may_be_empty and records.isEmpty():
        raise ValueError(f"no patch of {', '.join(named(countries))} is in {split}")
    return records


def split_union(patches: DataFrame, chips: DataFrame, countries: list[str], split: str, usable_only: bool = True) -> DataFrame:
    """The split of one country after another: a country named twice counts twice."""
    parts = [split_records(patches, chips, c, split, usable_only) for c in countries]
    if not parts:
        raise ValueError("no countries")
    return reduce(DataFrame.unionByName, parts)


def nth(records: DataFrame, place: int) -> DataFrame:
    """The record at a place, from 0, in the order of country and patch; a place beyond the last is an IndexError."""
    one = records.orderBy("country", "patch_id").offset(max(place, 0)).limit(1)
    if place < 0 or one.isEmpty():
        raise IndexError(f"no record {place}")
    return one


def in_order(samples: DataFrame, epoch: int = 0, seed: int = 7, training: bool = False) -> DataFrame:
    """``samples`` with their ``place`` from 0: in training a shuffle by a hash of seed, epoch and sample, else by country and patch.

    Keys alone are dealt by ranges of the order and ranked within them; ranges are
    joined by their counts. So no task gets all keys, however alike they are, and
    places depend on neither partitions nor reruns. Repeated samples stand together.
    """
    key = ["country", "patch_id"]
    at = F.xxhash64(F.lit(seed), F.lit(epoch), *key) if training else F.lit(0).cast("long")
    keys = samples.groupBy(*key).agg(F.count("*").alias("_n")).withColumn("_at", at)
    ranges = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = staged(keys.repartitionByRange(ranges, "_at", *key).withColumn("_range", F.spark_partition_id()), "sample-keys")
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = keys.groupBy("_range").agg(F.sum("_n").alias("_all")).withColumn("_start", F.coalesce(F.sum("_all").over(before), F.lit(0)))
    inner = W.partitionBy("_range").orderBy("_at", *key).rowsBetween(W.unboundedPreceding, -1)
    keys = keys.withColumn("_own", F.coalesce(F.sum("_n").over(inner), F.lit(0))).join(F.broadcast(starts.select("_range", "_start")), "_range")
    repeated = not keys.where("_n > 1").isEmpty()
    keys = keys.select(*(F.col(c).alias(f"_{c}") for c in key), (F.col("_start") + F.col("_own")).alias("_first"))
    out = samples.join(keys, F.col("country").eqNullSafe(F.col("_country")) & F.col("patch_id").eqNullSafe(F.col("_patch_id"))).drop("_country", "_patch_id")
    if repeated:
        alike = W.partitionBy(*key).orderBy(F.xxhash64(*samples.columns))
        return out.withColumn("place", F.col("_first") + F.row_number().over(alike) - 1).drop("_first")
    return out.withColumnRenamed("_first", "place")


def batches(samples: DataFrame, size: int, epoch: int = 0, seed: int = 7, training: bool = False) -> DataFrame:
    """``samples`` with ``batch`` and ``place`` in it: ``size`` rows a batch in the order of ``in_order``, the last may have fewer."""
    placed = in_order(samples, epoch, seed, training)
    return placed.withColumns({"batch": F.expr(f"place div {size}"), "place": (F.col("place") % size).cast("int")})


def dealt(samples: DataFrame, size: int, readers: int, epoch: int = 0, seed: int = 7, training: bool = True) -> DataFrame:
    """``samples`` with ``reader``, and ``batch`` and ``place`` of each reader's own.

    Neighbours in the order go to different readers: each sample to one, and
    readers' numbers of samples are one apart at most.
    """
    placed = in_order(samples, epoch, seed, training).withColumn("reader", (F.col("place") % readers).cast("int"))
    own = F.expr(f"place div {readers}")
    return placed.withColumns({"batch": F.expr(f"(place div {readers}) div {size}"), "place": (own % size).cast("int")})


def read_together(parts: DataFrame, readers: int, consume: Callable[[int, Iterator[pa.Table]], Iterator[pa.RecordBatch]], schema: str, ahead: int = 2) -> DataFrame:
    """What ``consume(reader, batches)`` gives of the batches of ``dealt``, one task a reader; all run at once or none does.

    The tasks are a barrier stage: they start together, and if one is lost all
    start again, as readers that train one model must. While a batch is used, up to
    ``ahead`` more are made ready.
    """
    columns = parts.columns

    def run(stream):
        context = BarrierTaskContext.get()
        reader = context.partitionId()
        context.barrier()
        ready: queue.Queue = queue.Queue(ahead)

        def fill():
            try:
                held, number = [], None
                for block in stream:
                    numbers = np.asarray(block.column("batch"))
                    cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
                    for low, high in zip(cuts, cuts[1:], strict=False):
                        if low == high:
                            continue
                        if number is not None and numbers[low] != number:
                            ready.put(pa.Table.from_batches(held))
                            held = []
                        number = numbers[low]
                        held.append(block.slice(low, high - low))
                if held:
                    ready.put(pa.Table.from_batches(held))
                ready.put(None)
            except BaseException as e:  # given to the reader, which raises it
                ready.put(e)

        threading.Thread(target=fill, daemon=True).start()

        def filled():
            while (batch := ready.get()) is not None:
                if isinstance(batch, BaseException):
                    raise batch
                yield batch

        yield from consume(reader, filled())

    placed = parts.repartitionById(readers, F.col("reader")).sortWithinPartitions("batch", "place")
    return placed.select(*columns).mapInArrow(run, schema, barrier=True)


def absent(wanted: DataFrame, there: DataFrame, on: str = "country") -> DataFrame:
    """Names that are wanted and not there."""
    return wanted.select(on).join(there.select(on).distinct(), on, "left_anti")


def joined_path(root: str, path: Column) -> Column:
    """An absolute path stands for itself."""
    return F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", F.lit(root.rstrip("/")), path))


def record_paths(records: DataFrame, root: str) -> DataFrame:
    return records.select(
        "country",
        "patch_id",
        joined_path(root, F.col("image_a_path")).alias("window_a"),
        joined_path(root, F.col("image_b_path")).alias("window_b"),
        joined_path(root, F.col("label_path")).alias("label"),
    )


def path_country(path: Column, marker: str) -> Column:
    """The folder after the last ``marker``."""
    return F.substring_index(F.substring_index(path, marker, -1), "/", 1)
