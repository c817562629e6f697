"""Checks that are part of a plan: a job whose totals are wrong fails where it runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def required(rows: DataFrame, holds: Column, message: str, of: DataFrame | None = None) -> DataFrame:
    """rows, whose job fails with the message unless the aggregate `holds` is true.

    The aggregate is over `of`, or over rows themselves. It adds no row: its one row is tested
    and left out, on an empty table too.
    """
    checked = (rows if of is None else of).agg(F.coalesce(holds, F.lit(False)).alias("holds"))
    failed = F.raise_error(F.lit(message)).cast("boolean")
    none = checked.filter(F.when(F.col("holds"), F.lit(False)).otherwise(failed))
    return rows.unionByName(none.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]))


def valid_rows(rows: DataFrame, valid: Column, message: str) -> DataFrame:
    """rows, whose job fails at the first one that isn't valid."""
    return rows.filter(F.when(F.coalesce(valid, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def observed(rows: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """rows and an observation that holds the metrics once a job has read them, at no second pass."""
    seen = Observation(name)
    return rows.observe(seen, *[value.alias(key) for key, value in metrics.items()]), seen
