"""Rasters in TIFF files as a Spark data source: rows are windows of images.

    spark.dataSource.register(RasterFiles)
    spark.read.format("raster_files").option("window", 512).load("s3://bucket/scenes")

Files stand under ``path`` in folders named by country, ``country=x`` or ``x``. The
option ``countries`` keeps files of others out of the plan, and a filter on the
country that these countries satisfy is pushed into the source. Other filters stay
with Spark: Spark 4.1 keeps a filter once pushed into a Python source for all later
uses of the loaded frame, even those without it (tried), so that a source must not
narrow itself by the filters it is given. ``raster_windows`` loads a frame for its
countries and filters it in one.

Partitions are planned by bytes: small files together, large ones in shares of
their windows, each about ``partitionBytes``. A task reads the head of a file and
then only the strips or tiles that its windows touch, by their places in the file.

Options: ``window`` (pixels a side; 0, the default: whole images), ``partitionBytes``
(64 MB), ``suffix`` (``.tif``), ``countries`` (a JSON list; all). Paths are those of
Arrow's file systems.

An empty or missing folder gives no rows. A file that is no baseline TIFF ends the
job with a ValueError that names it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .tiff import Raster

SCHEMA = "country string, file string, top int, left int, h int, w int, bands int, image array<float>"


@dataclass
class Files(InputPartition):
    """Files of a partition: (country, path, share, shares) each."""

    files: list[tuple[str, str, int, int]]


def planned(files: list[tuple[str, str, int]], most: int) -> list[list[tuple[str, str, int, int]]]:
    """Files (country, path, bytes) as partitions of about ``most`` bytes: whole files together, larger ones in shares."""
    out, now, size = [], [], 0
    for country, path, n in sorted(files, key=lambda f: (f[0], f[1])):
        if n > most:
            shares = -(-n // most)
            out += [[(country, path, k, shares)] for k in range(shares)]
            continue
        if now and size + n > most:
            out.append(now)
            now, size = [], 0
        now.append((country, path, 0, 1))
        size += n
    return out + ([now] if now else [])


def windows(h: int, w: int, side: int, share: int, shares: int) -> list[tuple[int, int, int, int]]:
    """(top, left, h, w) of a share of the windows of an image, neighbours together."""
    side_y, side_x = (side, side) if side else (h, w)
    every = [(y, x, min(side_y, h - y), min(side_x, w - x)) for y in range(0, h, side_y) for x in range(0, w, side_x)]
    return every[len(every) * share // shares : len(every) * (share + 1) // shares]


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path", "")
        self.side = int(options.get("window", 0))
        self.most = int(options.get("partitionBytes", 64 << 20))
        self.suffix = options.get("suffix", ".tif")
        listed = options.get("countries")
        self.countries: set[str] | None = None if listed is None else set(json.loads(listed))

    def pushFilters(self, filters: list[Filter]):  # noqa: N802 - the name is Spark's
        """Takes filters on the country that all listed files satisfy; Spark sees to the others."""
        for f in filters:
            wanted: set = set()
            if isinstance(f, EqualTo) and f.attribute == ("country",):
                wanted = {f.value}
            elif isinstance(f, In) and f.attribute == ("country",):
                wanted = set(f.value)
            if self.countries is None or not self.countries <= wanted:
                yield f

    def partitions(self):
        system, root = fs.FileSystem.from_uri(self.path)
        listed = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        files = []
        for info in listed:
            if info.type == fs.FileType.File and info.path.endswith(self.suffix):
                country = info.path[len(root) :].lstrip("/").split("/")[0].removeprefix("country=")
                if self.countries is None or country in self.countries:
                    files.append((country, info.path, info.size))
        return [Files(p) for p in planned(files, self.most)] or [Files([])]

    def read(self, partition):
        system, _ = fs.FileSystem.from_uri(self.path)
        for country, path, share, shares in partition.files:
            with system.open_input_file(path) as file:
                try:
                    image = Raster(lambda at, size: file.read_at(size, at))  # noqa: B023 - read here
                except ValueError as e:
                    raise ValueError(f"{path}: {e}") from e
                for top, left, h, w in windows(image.h, image.w, self.side, share, shares):
                    values = image.window(top, left, h, w).astype(np.float32).ravel()
                    row = [country, path, top, left, h, w, image.bands]
                    kinds = [pa.string(), pa.string(), *[pa.int32()] * 5]
                    arrays = [pa.array([v], t) for v, t in zip(row, kinds, strict=True)]
                    arrays.append(pa.array([values], pa.list_(pa.float32())))
                    yield pa.RecordBatch.from_arrays(arrays, ["country", "file", "top", "left", "h", "w", "bands", "image"])


class RasterFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def raster_windows(spark: SparkSession, path: str, window: int = 0, countries: list[str] | None = None, partition_bytes: int = 64 << 20) -> DataFrame:
    """Windows of the images under ``path``, of some countries or all."""
    spark.dataSource.register(RasterFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format("raster_files").option("window", window).option("partitionBytes", partition_bytes)
    if countries is None:
        return rows.load(path)
    return rows.option("countries", json.dumps(sorted(set(countries)))).load(path).where(F.col("country").isin(list(countries)))
