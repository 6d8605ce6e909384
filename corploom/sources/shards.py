"""Canonical shards: reading any of the five layouts, footers, listings and point reads."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..operators.drift import NAMES, layout_columns

CURRENT = tuple(NAMES)
LEGACY = ("sha256", "kind", "text", "source", "source_name", "license", "license_raw", "lang", "lang_score", "date", "tokens", "meta")

#: Column lists by layout: a file is read only if its columns are exactly one of these.
LAYOUTS = {LEGACY: "legacy", CURRENT[:11]: "v1", CURRENT[:14]: "v2", CURRENT[:15]: "v3", CURRENT: "current"}


def footers(spark: SparkSession, *paths: str) -> DataFrame:
    """path, layout, rows, row_groups, bytes, facts (the key/value pairs of the footer) of Parquet files; only footers are read."""

    def read(batches):
        import pyarrow.parquet as pq

        for pdf in batches:
            out = []
            for path in pdf["path"]:
                files, inside = store.at(path)
                f = pq.ParquetFile(inside, filesystem=files)
                facts = {k.decode(): v.decode() for k, v in (f.metadata.metadata or {}).items() if not k.startswith((b"ARROW", b"org.apache"))}
                layout = LAYOUTS.get(tuple(f.schema_arrow.names))
                out.append((path, layout, f.metadata.num_rows, f.metadata.num_row_groups, store.size(path), facts))
            yield pd.DataFrame(out, columns=["path", "layout", "rows", "row_groups", "bytes", "facts"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(list(paths)).select("path")
    return files.mapInPandas(read, "path string, layout string, rows long, row_groups int, bytes long, facts map<string,string>")


ATTESTED = "record_kind string, record_schema int, records long, tokens long, content_bytes long, recipe string, plan string, kind string"


def attested(footers: DataFrame) -> DataFrame:
    """path, rows, state of shards by their footers (footers()): recognised (an attestation that agrees with the footer's sums and rows), contradictory or absent."""
    f = footers.withColumn("a", F.from_json(F.col("facts")["corploom.attestation"], ATTESTED))
    fact = lambda k: F.col("facts")[f"corploom.{k}"].cast("long")
    agrees = (F.col("a.records") == F.col("rows")) & (F.col("a.kind") == "attestation")
    for k in ("records", "tokens", "content_bytes"):
        agrees &= F.col(f"a.{k}").eqNullSafe(fact(k))
    known = F.col("facts")["corploom.attestation"].isNotNull()
    return f.select("path", "rows", F.when(~known, "absent").when(F.coalesce(agrees, F.lit(False)), "recognised").otherwise("contradictory").alias("state"))


def audit(spark: SparkSession, *paths: str, deep: bool = False) -> DataFrame:
    """path, problem, records: rules that shards break. Files with a recognised attestation are read only if ``deep``; others are read whole.

    A digest that stands in several rows of the files read, whatever the licence, is the problem ``duplicate``.
    """
    state = attested(footers(spark, *paths))
    wrong = state.where("state = 'contradictory'").select("path", F.lit("attestation").alias("problem"), F.col("rows").alias("records"))
    rows = read_shards(spark, *paths)
    if not deep:
        plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
        open_ = state.where("state <> 'recognised'").select(plain(F.col("path")).alias("_p"))
        rows = rows.join(open_, plain(F.col("shard")) == F.col("_p"), "left_semi")
    broken = violations(rows).select("shard", F.explode("broken").alias("problem")).groupBy(F.col("shard").alias("path"), "problem").agg(F.count(F.lit(1)).alias("records"))
    twice = rows.groupBy("content_sha256").agg(F.count(F.lit(1)).alias("n"), F.min("shard").alias("path")).where("n > 1").groupBy("path").agg(F.sum("n").alias("records"))
    return wrong.unionByName(broken).unionByName(twice.select("path", F.lit("duplicate").alias("problem"), "records"))


def read_shards(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows of all shards in the current layout, with shard (the file) and row (its place there). A file of another layout raises."""
    groups: dict[str, list[str]] = {}
    for r in footers(spark, *paths).select("path", "layout").toLocalIterator():
        if r["layout"] is None:
            raise ValueError(f"{r['path']} has none of the known layouts")
        groups.setdefault(r["layout"], []).append(r["path"])

    def one(files: list[str]) -> DataFrame:
        df = spark.read.parquet(*files)
        placed = df.select(F.col("_metadata.file_path").alias("shard"), F.col("_metadata.row_index").alias("row"), *df.columns)
        return placed.select("shard", "row", *layout_columns(placed).values())

    return reduce(DataFrame.unionByName, [one(sorted(f)) for _, f in sorted(groups.items())])


def listing(rows: DataFrame) -> DataFrame:
    """row, id, octets, tokens, license, language, source of every record."""
    return rows.select("shard", "row", F.lower(F.hex("content_sha256")).alias("id"), F.octet_length("text").alias("octets"), F.col("token_count").alias("tokens"), "license", "language", "source")


def read_at(rows: DataFrame, places: DataFrame) -> DataFrame:
    """The rows at given places (shard, row)."""
    return rows.join(places, ["shard", "row"], "left_semi")


def violations(rows: DataFrame) -> DataFrame:
    """Rows that break a rule of the current layout, with the rules' names: a valid shard has none."""
    rules = {
        "digest": ~F.lower(F.hex("content_sha256")).eqNullSafe(F.sha2("text", 256)),
        "text": F.coalesce(F.col("text"), F.lit("")) == "",
        "source": F.coalesce(F.col("source"), F.lit("")) == "",
        "license": F.coalesce(F.col("license"), F.lit("")) == "",
        "language_score": ~F.coalesce(F.col("language_score").between(0, 1000), F.lit(True)),
        "token_count": F.coalesce(F.col("token_count"), F.lit(-1)) < 0,
        "meta": F.col("meta").isNotNull() & ~F.coalesce(F.expr("schema_of_variant(try_parse_json(meta)) like 'OBJECT%'"), F.lit(False)),
        "counters": F.least(*[F.coalesce(F.col(n), F.lit(0)) for n in CURRENT[15:]]) < 0,
    }
    broken = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return rows.withColumn("broken", broken).where(F.size("broken") > 0)
