"""Queries of problem 5: drifting schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift
from ..session import table

LAYOUTS = ("shard_legacy", "shard_v1", "shard_v2", "shard_v3", "text_rows")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Changes between consecutive files of each feed."""
    return drift.changes(table(spark, sf, "raw_records")).select("feed", "file_no", "field_name", "change_kind")


def p5_unified(spark: SparkSession, sf: str) -> DataFrame:
    """All records and layouts as one table of the current layout."""
    records = table(spark, sf, "raw_records")
    parts = [drift.unify_records(records, drift.field_links(records)), *[drift.unify_layout(table(spark, sf, t), t) for t in LAYOUTS]]
    return reduce(DataFrame.unionByName, parts)


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    """Every change: between files of feeds, and between the layouts; and how many records of a file could not be read (field_name null)."""
    found = p5_found(spark, sf).select("feed", F.col("file_no").cast("string").alias("version"), "field_name", "change_kind")
    rows = [("layouts", f"{a} -> {b}", f, k) for a, b, f, k in drift.layout_changes([(t, table(spark, sf, t).select(*[c for c in table(spark, sf, t).columns if t != "text_rows" or c not in ("row_id", "shard_id", "row_no", "received_at")])) for t in LAYOUTS])]
    bad = drift.unreadable(table(spark, sf, "raw_records")).select("feed", F.col("file_no").cast("string").alias("version"), F.lit(None).cast("string").alias("field_name"), F.concat(F.col("unreadable"), F.lit(" unreadable")).alias("change_kind"))
    return found.unionByName(bad).unionByName(spark.createDataFrame(rows, "feed string, version string, field_name string, change_kind string"))


def queries() -> dict:
    """All queries by name."""
    return {"p5_found": p5_found, "p5_unified": p5_unified, "p5_report": p5_report}
