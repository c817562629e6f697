"""Logs as tables with one folder per day.

Rows of a day are written together, and writing a day again replaces that day and no other,
so a late rerun needs no other data. A reader of some days reads their folders only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a file at most, so that a day with a third of all rows is many files.
FILE_ROWS = 1_000_000
PARTS = 16


def write_days(rows: DataFrame, path: str, ts: str = "ts", parts: int = PARTS) -> None:
    """Replaces the days that rows holds; rows without a time go to a folder of their own.

    A day is dealt to `parts` tasks, whatever its size.
    """
    dated = rows.withColumn("day", F.to_date(ts)).repartition("day", F.pmod(F.xxhash64(*rows.columns), F.lit(parts)))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", FILE_ROWS).partitionBy("day").parquet(path)


def read_days(spark: SparkSession, path: str, schema: str, first: str | Column | None = None, last: str | Column | None = None) -> DataFrame:
    """Rows of the days from first to last, both included, with the column day."""
    rows = spark.read.schema(f"{schema}, day date").parquet(path)
    for bound, holds in ((first, lambda d, b: d >= b), (last, lambda d, b: d <= b)):
        if bound is not None:
            rows = rows.filter(holds(F.col("day"), F.lit(bound).cast("date") if isinstance(bound, str) else bound))
    return rows
