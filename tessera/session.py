"""One place that builds a SparkSession and reads the driver tables."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table in each dealt part, at least where it is small and at most where it is large.
PART, LARGE_PART = 262_144, 8_388_608
#: Rows of a part at most: repeated texts take far fewer bytes in a file than in memory.
PART_ROWS = 8_192
#: Bytes of a table per core up to which it is dealt out in any case, and where its row groups are uneven.
EVER, SMALL = 16_777_216, 4_294_967_296


def session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the one you are given."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tessera")
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables. Paths go through Spark's readers only."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table for work that costs far more than moving the table.

    A file is cut into tasks at its row groups only, and a row group may hold a million rows, so
    that few tasks have all the work. A table's rows are dealt to at least twice as many parts
    as there are cores, and to parts of LARGE_PART bytes and PART_ROWS rows at most. A table of more than EVER bytes
    a core whose row groups give all cores alike is read as it lies, without a shuffle.
    """
    rows = table(spark, sf_dir, name)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    cores = spark.sparkContext.defaultParallelism
    if size <= PART or size > SMALL * cores:
        return rows
    most, total = _shares(rows)
    parts = max(min(2 * cores, ceil(size / PART)), ceil(size / LARGE_PART), ceil(total / PART_ROWS))
    return rows.repartition(parts) if size <= EVER * cores or most * cores > 1.25 * total else rows


def _shares(rows: DataFrame) -> tuple[int, int]:
    """Rows that the largest task of a scan gets, and all rows, as the files' footers tell."""
    tasks = rows.select(F.spark_partition_id().alias("task")).groupBy("task").agg(F.count("*").alias("n"))
    return tuple(tasks.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first())
