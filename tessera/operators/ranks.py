"""Row numbers over a whole table without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_rank(df: DataFrame, bucket: Column, *order: Column | str, name: str = "rank") -> DataFrame:
    """df with its 1-based position in the given total order.

    bucket never falls along the order (a prefix of a hash, a division of an id). Rows are
    numbered inside their bucket and shifted by the sizes of the buckets before it, so one
    task sees one bucket, and only a row per bucket meets in one place. The bucket is a
    function of the row, so a recomputed task gives the same numbers.
    """
    keyed = df.withColumn("_bucket", bucket)
    numbered = keyed.withColumn("_inside", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)))
    sizes = keyed.groupBy("_bucket").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_end", F.sum("_size").over(Window.orderBy("_bucket"))).select("_bucket", (F.col("_end") - F.col("_size")).alias("_before"))
    return numbered.join(before, "_bucket").withColumn(name, F.col("_before") + F.col("_inside")).drop("_bucket", "_inside", "_before")


def group_rank(df: DataFrame, group: str, bucket: Column, *order: Column | str, name: str = "rank", size: str | None = None) -> DataFrame:
    """df with its 1-based position inside its group, and the group's number of rows as `size`.

    As global_rank, with one offset per (group, bucket): a group with a third of all rows is
    numbered by as many tasks as it has buckets, and only a row per bucket meets in one place.
    """
    keyed = df.withColumn("_bucket", bucket)
    numbered = keyed.withColumn("_inside", F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*order)))
    sizes = keyed.groupBy(F.col(group).alias("_its_group"), F.col("_bucket").alias("_its_part")).agg(F.count("*").alias("_its_size"))
    along = Window.partitionBy("_its_group")
    before = sizes.withColumns({"_its_end": F.sum("_its_size").over(along.orderBy("_its_part")), "_its_rows": F.sum("_its_size").over(along)})
    found = numbered.join(before, F.col(group).eqNullSafe(F.col("_its_group")) & F.col("_bucket").eqNullSafe(F.col("_its_part")))
    placed = found.withColumn(name, F.col("_its_end") - F.col("_its_size") + F.col("_inside"))
    if size:
        placed = placed.withColumn(size, F.col("_its_rows"))
    return placed.drop("_bucket", "_inside", "_its_group", "_its_part", "_its_size", "_its_end", "_its_rows")


def hash_order(key: Column, seed: int = 42) -> Column:
    """A seeded random order that every engine agrees on."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_bucket(hashed: Column) -> Column:
    return F.substring(hashed, 1, 3)
