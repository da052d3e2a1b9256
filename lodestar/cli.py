"""Command line: lists the named queries or runs some of them over a folder of tables and writes the results."""

from __future__ import annotations

import argparse
import os
import shutil
import tempfile

from lodestar.plans import catalog


def ship(spark) -> None:
    """Sends the package to the Python workers of a cluster, which needn't have it installed. The archive stays as long as the driver serves it."""
    if not spark.sparkContext.master.startswith("local"):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "lodestar"), "zip", root, "lodestar"))


def main(argv: list[str] | None = None, more: dict | None = None) -> int:
    """more: further queries by name, as subpackages have them."""
    parser = argparse.ArgumentParser(prog="lodestar", description=__doc__)
    parser.add_argument("queries", nargs="*", help="names of queries; none lists them")
    parser.add_argument("--tables", help="folder of the Parquet tables")
    parser.add_argument("--out", help="folder for the results, one table each; without it the first rows are shown")
    parser.add_argument("--format", default="parquet", choices=["parquet", "json", "csv"])
    parser.add_argument("--rows", type=int, default=20, help="rows to show")
    args = parser.parse_args(argv)
    known = {**catalog.queries(), **(more or {})}
    if not args.queries:
        print("\n".join(sorted(known)))
        return 0
    unknown = [q for q in args.queries if q not in known]
    if unknown or not args.tables:
        parser.error(f"unknown queries: {', '.join(unknown)}" if unknown else "--tables is needed")
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("lodestar").getOrCreate()
    ship(spark)
    for q in args.queries:
        df = known[q](spark, args.tables)
        if args.out:
            df.write.mode("overwrite").format(args.format).save(f"{args.out}/{q}")
        else:
            df.show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
