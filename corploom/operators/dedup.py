"""Exact deduplication in a stable order, also against identities that exist already."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``. Null keys are equal to each other.

    Only the order columns are compared before the rows meet: the first is found by a map-side minimum, so a key that
    holds a third of all rows is not gathered in one task; the rows are then joined with their key's first.
    """
    first = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.struct(*[F.col(f"a.{o}") for o in order]) == F.col("b._first")]
    return df.alias("a").join(first.alias("b"), on, "left_semi")


def keep_first_window(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The same by a window, where groups are known to be small and ``order`` is not unique (then one of equals is kept)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def not_present(df: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not among ``existing``."""
    return df.join(existing.select(*keys).distinct(), keys, "left_anti")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("records")).where("records > 1")
