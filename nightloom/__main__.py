"""python -m nightloom INPUT OUTPUT_FOLDER [--profile NAME] [--no-auto] [--override stage.setting=value ...] [--format png]

INPUT is a file, folder or glob of FITS files. The exit code is 1 if any frame failed.
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="nightloom")
    parser.add_argument("input")
    parser.add_argument("output_folder")
    parser.add_argument("--profile", default="auto")
    parser.add_argument("--no-auto", action="store_true", help="the default profile instead of one by the kind of frame")
    parser.add_argument("--override", action="append", default=[], metavar="STAGE.SETTING=VALUE")
    parser.add_argument("--format", default="png", choices=["png", "tif", "tiff", "fit", "fits"])
    parser.add_argument("--catalog", help="Parquet with ra, dec and magnitudes")
    parser.add_argument("--verbose", action="store_true")
    given = parser.parse_args(argv)

    from pyspark.sql import SparkSession

    from .plans import runner
    from .sources.catalogs import read_catalog

    spark = SparkSession.builder.appName("nightloom").getOrCreate()
    catalog = read_catalog(spark, given.catalog) if given.catalog else None
    name = "default" if given.no_auto and given.profile == "auto" else given.profile
    rows = runner.run_files(spark, given.input, given.output_folder, name, given.override, given.format, catalog).collect()
    for row in rows:
        if row["error"] or given.verbose:
            print(row["frame_id"], row["error"] or " ".join(row["done"]), file=sys.stderr)
    return int(any(row["error"] for row in rows) or not rows)


if __name__ == "__main__":
    sys.exit(main())
