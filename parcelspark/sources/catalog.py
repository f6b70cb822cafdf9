"""Tables on disk: patch index, split tables, rasters, metrics, and the layout check."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators.records import absent, joined_path

#: Folders of the tables of samples of each image source.
SOURCES = {"3m": "samples_3m", "10m": "samples_10m"}


def patch_index(spark: SparkSession, path: str) -> DataFrame:
    """The patch index; the key is text, whatever its type on disk."""
    return spark.read.parquet(path).withColumn("patch_id", F.col("patch_id").cast("string"))


def split_table(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The split tables of countries (country -> path) as one; ids are numbers in some and text in others."""
    frames = [
        spark.read.parquet(p).select(F.lit(c).alias("country"), F.col("aoi_id").cast("string").alias("aoi_id"), "split")
        for c, p in paths.items()
    ]
    return reduce(DataFrame.unionByName, frames)


def rasters(spark: SparkSession, path: str, countries: list[str] | None = None) -> DataFrame:
    """Rasters as flat arrays, of some countries or all; the filter reaches the scan."""
    df = spark.read.parquet(path)
    return df.where(F.col("country").isin(countries)) if countries else df


def samples(spark: SparkSession, root: str, source: str = "3m", countries: list[str] | None = None) -> DataFrame:
    """Images with their labels (country, patch_id, h, w, bands, image, gt) of an image source, a table of its own under ``root``."""
    if source not in SOURCES:
        raise ValueError(f"source is one of {sorted(SOURCES)}, not {source!r}")
    return rasters(spark, f"{root.rstrip('/')}/{SOURCES[source]}", countries)


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """A metrics file. The schema is given: where a column holds 'nan', inference would make it text."""
    return spark.read.csv(path, header=True, schema=schemas.METRICS_CSV, nanValue="nan")


def by_country(df: DataFrame) -> DataFrame:
    """``df`` with its country names as ``country``; files of other tools have them as ``countries``."""
    found = [c for c in ("country", "countries") if c in df.columns]
    if not found:
        raise KeyError(f"no column of country names among {', '.join(df.columns)}")
    return df.withColumnRenamed(found[0], "country")


@F.pandas_udf(T.StringType())
def six_decimals(values: pd.Series) -> pd.Series:
    """The exact binary value to six decimals; halves of shortest decimal forms would round another way."""
    return values.map(lambda v: f"{v:.6f}")


def formatted(df: DataFrame, numbers: list[str]) -> DataFrame:
    """Floating-point columns as text of six decimals; NaN is 'nan' and null is empty.

    Metrics are a row a country, little enough for a Python function.
    """
    text = lambda c: F.when(F.col(c).isNull(), "").when(F.isnan(c), "nan").otherwise(six_decimals(F.col(c)))
    return df.withColumns({c: text(c) for c in numbers})


def write_metrics(df: DataFrame, path: str) -> None:
    """One file with a header: a row a country is little enough for one task, what leads to them is not."""
    formatted(df.repartition(1), [c for c, t in df.dtypes if t in ("double", "float")]).write.csv(path, header=True, emptyValue="")


def missing_countries(spark: SparkSession, countries, root: str) -> DataFrame:
    """Countries without a folder of their name under ``root``, wherever Spark's file systems find it."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = [(s.getPath().getName(),) for s in fs.listStatus(top) if s.isDirectory()] if fs.exists(top) else []
    wanted = spark.createDataFrame([(c,) for c in countries], "country string")
    return absent(wanted, spark.createDataFrame(there, "country string"))


def absent_files(spark: SparkSession, root: str, expected: DataFrame) -> DataFrame:
    """Rows of ``expected`` whose ``path`` (under ``root``, or absolute) is no file there, or an empty one. Spark lists the folder; files are not opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(_plain(F.col("path")).alias("_there"))
    whole = _plain(joined_path(root, F.col("path")))
    return expected.join(files, whole == F.col("_there"), "left_anti")


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/*", "/")


def absent_of_layout(spark: SparkSession, root: str, index: DataFrame, countries, splits: str = "splits") -> DataFrame:
    """(country, patch_id, role, path) of all that a whole layout has and ``root`` lacks: windows and labels of the index, and split tables.

    A split table is expected as ``splits``/chips_<country>.parquet of each country, with a null patch.
    """
    wanted = spark.createDataFrame([(c,) for c in countries], "country string")
    roles = F.array(*(F.struct(F.lit(r).alias("role"), F.col(c).alias("path")) for r, c in (("window_a", "image_a_path"), ("window_b", "image_b_path"), ("label", "label_path"))))
    files = index.join(wanted, "country", "left_semi").select("country", F.col("patch_id").cast("string").alias("patch_id"), F.explode(roles).alias("x"))
    files = files.select("country", "patch_id", "x.role", "x.path")
    table = F.concat(F.lit(f"{splits}/chips_"), F.col("country"), F.lit(".parquet"))
    tables = wanted.select("country", F.lit(None).cast("string").alias("patch_id"), F.lit("split").alias("role"), table.alias("path"))
    return absent_files(spark, root, files.unionByName(tables))
