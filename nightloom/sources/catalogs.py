"""Star catalogs: reading, quality filters, and tables of other shapes brought into this one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("ra", "dec", "phot_g_mean_mag", "phot_bp_mean_mag", "phot_rp_mean_mag")
# fixed values: the column names of a mirror
MIRROR = {"RA_ICRS": "ra", "DE_ICRS": "dec", "Gmag": "phot_g_mean_mag", "BPmag": "phot_bp_mean_mag", "RPmag": "phot_rp_mean_mag"}


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """src_id and the five columns as doubles. Rows without src_id get one from their position."""
    rows = spark.read.parquet(path)
    key = F.col("src_id").cast("long") if "src_id" in rows.columns else F.xxhash64("ra", "dec")
    return rows.select(key.alias("src_id"), *(F.col(c).cast("double").alias(c) for c in COLUMNS))


def catalog_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def usable(rows: DataFrame, faintest: float, lo: float = 0.0, hi: float = 360.0) -> DataFrame:
    """Rows brighter than a limit, with both colours, in a band of right ascension [lo, hi)."""
    return rows.where((F.col("phot_g_mean_mag") < faintest) & F.col("phot_bp_mean_mag").isNotNull() & F.col("phot_rp_mean_mag").isNotNull() & (F.col("ra") >= lo) & (F.col("ra") < hi))


def in_bands(rows: DataFrame, faintest: float, bands: int = 4) -> DataFrame:
    """The union of equal bands of right ascension, as sources that limit their answers are read."""
    width = 360.0 / bands
    return reduce(DataFrame.unionByName, [usable(rows, faintest, i * width, (i + 1) * width) for i in range(bands)])


def renamed(rows: DataFrame, names: dict[str, str] = MIRROR) -> DataFrame:
    return rows.withColumnsRenamed(names)


def first_of(*sources) -> DataFrame:
    """The first source (a function without arguments) that gives rows; the last error if none does."""
    last: Exception = ValueError("no sources")
    for source in sources:
        try:
            rows = source()
            if not rows.isEmpty():
                return rows
            last = ValueError("a source without rows")
        except Exception as e:  # noqa: BLE001  the next source may do
            last = e
    raise last
