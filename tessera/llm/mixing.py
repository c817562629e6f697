"""Mixing sources to target weights.

Sources, ordered by code point with null last, have the weights 3, 1, 2, repeating. They
share 150 % of all words by weight; a source's target stops at twice its words and the
excess goes to the others by weight until none is above. Every document has a random key,
the MD5 of its id; within a source, documents are taken in key order. Keys are dealt into
4,096 ranges, words are summed by (source, range), running sums over the ranges give each
range its offset, and a running sum inside the range gives each document its place. The
source's budget cuts there: whole epochs first, then the exact rest.

All steps are DataFrame operations. No window holds a source: ranges are of equal size in
expectation, so a source with a third of all rows spreads over 4,096 window partitions.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own;
rows with equal ids are ordered by size and then by row; empty tables give no rows; other
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, staged, text_or_empty

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
RANGE_DIGITS = 3


def source_targets(sized: DataFrame) -> DataFrame:
    """One row per source: source, source_size, target. sized has source and size.

    The water level: sources sorted by cap / weight reach their caps in that order, so the
    capped ones are a prefix; what is left is shared by the others' weights.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    fill = Window.orderBy((F.col("source_size") / F.col("weight")), "rank")
    ranked = (
        sources.withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", weight.cast("double"))
        .withColumn("cap", F.col("source_size") * float(MOST_EPOCHS))
    )
    everyone = Window.partitionBy()
    filled = (
        ranked.withColumn("budget", F.sum("source_size").over(everyone) * SHARE)
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weights_left", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("full", F.col("cap") * F.col("weights_left") <= (F.col("budget") - F.col("caps_before")) * F.col("weight"))
    )
    caps_full = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everyone)
    weights_open = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everyone)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * (F.col("budget") - caps_full) / F.nullif(weights_open, F.lit(0.0)))
    return filled.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, row_column: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, row_key, size, source_size, target, taken.

    row_key is row_column, which must tell rows apart, or else a number drawn here.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = staged(
        docs.select(
            "doc_id",
            "source",
            F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
            key.alias("key"),
            (F.col(row_column) if row_column else F.monotonically_increasing_id()).alias("row_key"),
        ),
        "sized",
    ).withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    targets = source_targets(sized)
    part = Window.partitionBy("source", "range")
    offsets = (
        sized.groupBy("source", "range")
        .agg(F.sum("size").alias("range_size"))
        .withColumn("end", F.sum("range_size").over(Window.partitionBy("source").orderBy("range")))
        .select(F.col("source").alias("o_source"), F.col("range").alias("o_range"), (F.col("end") - F.col("range_size")).alias("offset"))
    )
    placed = (
        sized.withColumn("inside", F.sum("size").over(part.orderBy("key", "doc_id", "size", "row_key").rowsBetween(Window.unboundedPreceding, 0)))
        .join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("range") == F.col("o_range")))
        .withColumn("before", F.col("offset") + F.col("inside") - F.col("size"))
        .join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source")))
    )
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size") - F.col("before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.select("doc_id", "row_key", "size", "source_size", "target", taken.cast("long").alias("taken"))
