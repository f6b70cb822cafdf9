"""Commands: check the layout, evaluate a scorer on images, score finished rasters, report macro averages."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import regions, report
from .operators import metrics, scorers
from .schemas import METRICS
from .sources import catalog
from .sources.metrics_folder import MetricsFolder


#: Countries scored at a time.
AT_ONCE = 4


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="parcelspark", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    check = sub.add_parser("check-data", help="countries of a split without a folder")
    check.add_argument("--root", default="data")
    check.add_argument("--index", help="patch index: name all windows, labels and split tables that are not there, too")
    score = sub.add_parser("score", help="metrics of every country of a raster table")
    score.add_argument("--rasters", required=True)
    score.add_argument("--out", default="metrics")
    score.add_argument("--no-watershed", dest="watershed", action="store_false")
    score.add_argument("--metres", type=float, default=3.0, help="ground size of a pixel")
    evaluate = sub.add_parser("eval", help="metrics of every country from images, with a scorer")
    reproduce = sub.add_parser("reproduce", help="train if asked, evaluate, and print the averages beside the published ones")
    reproduce.add_argument("--train", help="module:function that trains and returns the weights' path, which the scorer gets")
    for command in (evaluate, reproduce):
        command.add_argument("--scorer", required=True, help="module:function that makes a scorer")
        command.add_argument("--weights", help="file of weights; the scorer's function gets its bytes")
        command.add_argument("--data", default="data", help="folder of the tables of samples")
        command.add_argument("--source", choices=sorted(scorers.SCALES), default="3m")
        command.add_argument("--out", default="metrics")
        command.add_argument("--resume", help="folder of countries scored so far (the output's name with -countries)")
        command.add_argument("--no-tta", dest="tta", action="store_false", help="score an image once, not under eight symmetries")
        command.add_argument("--no-watershed", dest="watershed", action="store_false")
        command.add_argument("--h-min", dest="h", type=float, default=2.0, help="least height of a watershed seed")
        command.add_argument("--min-pad", dest="least", type=int, default=512, help="least side of a scored image")
    show = sub.add_parser("report", help="macro averages of a metrics file")
    show.add_argument("--metrics", required=True)
    for command in (check, score, evaluate, reproduce, show):
        command.add_argument("--split", choices=sorted(regions.SPLITS), default="dense10")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("parcelspark").getOrCreate()
    countries = regions.SPLITS[args.split]
    if args.command == "check-data":
        missing = sorted(r.country for r in catalog.missing_countries(spark, countries, args.root).collect())
        print(f"missing: {', '.join(missing)}" if missing else f"all {len(countries)} countries are there")
        if args.index:
            lacking = catalog.absent_of_layout(spark, args.root, catalog.patch_index(spark, args.index), countries)
            for row in lacking.groupBy("country", "role").agg(F.count("*").alias("n"), F.min("path").alias("path")).orderBy("country", "role").collect():
                print(f"{row.country}: {row.n} of {row.role} missing, the first {row.path}")
                missing.append(row.country)
        return int(bool(missing))
    path = args.metrics if args.command == "report" else args.out
    if args.command == "score":
        rows = metrics.country_metrics(catalog.rasters(spark, args.rasters, list(countries)), args.watershed, args.metres, args.rasters)
        catalog.write_metrics(rows, path)
    elif args.command in ("eval", "reproduce"):
        if args.command == "reproduce" and args.train:
            args.weights = scorers.named_factory(args.train)()
        make = scorers.named_factory(args.scorer)
        if args.weights:
            stored = spark.read.format("binaryFile").load(args.weights).select("content").first()
            make = scorers.with_weights(spark, make, bytes(stored.content))
        settings = {k: getattr(args, k) for k in ("scorer", "weights", "data", "source", "tta", "watershed", "h", "least")}
        folder = MetricsFolder(spark, args.resume or f"{args.out}-countries", settings)

        def rows_of(country):
            samples = catalog.samples(spark, args.data, args.source, [country])
            return scorers.evaluated(samples, make, args.source, args.tta, args.watershed, args.scorer, args.least, args.h)

        folder.fill(countries, rows_of, path, at_once=AT_ONCE)
    rows = catalog.by_country(catalog.metrics(spark, path))
    means = metrics.macro_average(rows, countries, list(METRICS))
    n = means.first()
    print(f"macro average over {n.n_countries}/{n.n_expected} {args.split} countries")
    print("\n".join(report.lines(report.summary(means, args.split).collect())))
    return 0


if __name__ == "__main__":
    sys.exit(main())
