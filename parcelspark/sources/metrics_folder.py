"""Metrics rows committed country by country, so that a run that ends early goes on where it ended.

A folder holds a manifest with the settings of the run, and for each country a
folder that Spark's own commit makes whole (its ``_SUCCESS`` file comes last).
A run with the same settings skips the countries that are committed; one with other
settings is refused with a ValueError. A country without patches is committed
without a row.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from .catalog import write_metrics

_MANIFEST, _ROWS = "manifest.json", "rows"


class MetricsFolder:
    def __init__(self, spark: SparkSession, path: str, settings: dict):
        self.spark, self.path = spark, path.rstrip("/")
        self.settings = json.dumps(settings, sort_keys=True)
        known = self._manifest()
        if known is None:
            spark.createDataFrame([(self.settings,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/{_MANIFEST}")
        elif known != self.settings:
            raise ValueError(f"{path} holds metrics of {known}, not of {self.settings}")

    def _files(self, path: str):
        """Spark's file system and the path in it: the folder can be wherever Spark can write."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _manifest(self) -> str | None:
        files, where = self._files(f"{self.path}/{_MANIFEST}/_SUCCESS")
        return self.spark.read.text(f"{self.path}/{_MANIFEST}").first().value if files.exists(where) else None

    def _place(self, country: str) -> str:
        return f"{self.path}/{_ROWS}/{quote(country, safe='')}"

    def committed(self) -> list[str]:
        files, top = self._files(f"{self.path}/{_ROWS}")
        if not files.exists(top):
            return []
        there = [s.getPath() for s in files.listStatus(top) if s.isDirectory()]
        return sorted(unquote(p.getName()) for p in there if files.exists(self._files(f"{p.toString()}/_SUCCESS")[1]))

    def add(self, country: str, rows: DataFrame) -> None:
        """Commit the rows of a country, in place of what an unfinished run left of it."""
        rows.write.mode("overwrite").parquet(self._place(country))

    def rows(self) -> DataFrame:
        """The rows of all committed countries."""
        places = [self._place(c) for c in self.committed()]
        return self.spark.read.schema(schemas.METRICS_CSV).parquet(*places) if places else self.spark.createDataFrame([], schemas.METRICS_CSV)

    def fill(self, countries: Iterable[str], rows_of: Callable[[str], DataFrame], out: str | None = None, at_once: int = 1) -> list[str]:
        """Score and commit what is lacking of ``countries`` and write all as a metrics file; returns what was scored.

        Countries come in their order, ``at_once`` of them at a time, so that small
        ones share the cluster. After a failure no further one is begun.
        """
        wanted = list(dict.fromkeys(countries))
        done = set(self.committed())
        lacking = [c for c in wanted if c not in done]
        if at_once == 1:
            for country in lacking:
                self.add(country, rows_of(country))
        else:
            with ThreadPoolExecutor(at_once) as pool:
                jobs = [pool.submit(lambda c=c: self.add(c, rows_of(c))) for c in lacking]
                try:
                    for job in jobs:
                        job.result()
                except BaseException:
                    pool.shutdown(wait=False, cancel_futures=True)
                    raise
        if out:
            write_metrics(self.rows().where(F.col("country").isin(wanted)), out)
        return lacking
