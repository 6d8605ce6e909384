"""Named queries that write tables as files into the shared folder, read them back and give what was read, with the SQL of what it must be."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.policy import Values
from ..operators import mapping
from ..session import checkpoint_dir, table
from ..sinks import shards as sink
from ..sources import files, shards
from . import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def folder(spark) -> str:
    """A new folder in the shared folder for checkpoints."""
    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def _rows(spark, sf) -> DataFrame:
    return table(spark, sf, "text_rows")


_OUTCOME = "CASE WHEN trim(regexp_replace(text, '[\\s]+', '', 'g')) = '' THEN 'empty' ELSE 'ok' END"
_MAPPED = f"SELECT row_id, {_OUTCOME} AS outcome, CASE WHEN {_OUTCOME} = 'ok' THEN sha256(text) END AS digest, CASE WHEN {_OUTCOME} = 'ok' THEN source END AS source, CASE WHEN {_OUTCOME} = 'ok' THEN CAST(token_count AS VARCHAR) END AS tokens FROM text_rows"


def _mapped(records: DataFrame) -> DataFrame:
    p = mapping.Profile(text=("text",), source="source", meta={"id": "row_id", "tokens": "token_count"})
    # an empty record has no mapped fields; its number is read from the record itself
    m = mapping.map_records(records.withColumn("id", F.get_json_object("record", "$.row_id").cast("bigint")), p)
    return m.select(F.col("id").alias("row_id"), "outcome", F.sha2("text", 256).alias("digest"), F.when(F.col("outcome") == "ok", F.col("source")).alias("source"), F.get_json_object("meta", "$.tokens").alias("tokens"))


@query(_MAPPED)
def jsonl_mapped(spark, sf):
    """All rows written as JSON Lines, read by blocks and mapped by a profile."""
    to = folder(spark)
    _rows(spark, sf).select(F.to_json(F.struct("row_id", "text", "source", "token_count"))).write.text(to)
    return _mapped(files.jsonl(spark, to))


@query(_MAPPED)
def parquet_mapped(spark, sf):
    """The same from the Parquet table: only the columns of the profile are read."""
    return _mapped(files.parquet_records(spark, ["row_id", "text", "source", "token_count"], os.path.join(sf, "text_rows.parquet")))


@query("SELECT sha256(text) AS digest, count(*) AS records FROM documents WHERE text IS NOT NULL GROUP BY 1")
def parquet_column(spark, sf):
    """One column of a Parquet table, row by row."""
    df = files.parquet_column(spark, "text", os.path.join(sf, "documents.parquet"))
    return df.where("text is not null").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("records"))


@query("SELECT row_id, sha256(rtrim('Subject: ' || row_id || chr(10) || chr(10) || regexp_replace(text, '(^|\\n)From ', '\\1>From ', 'g'), chr(10)) || chr(10)) AS digest FROM text_rows")
def mbox_messages(spark, sf):
    """All rows written as messages of mailboxes and read back."""
    to = folder(spark)
    said = F.concat(F.lit("Subject: "), F.col("row_id").cast("string"), F.lit("\n\n"), F.regexp_replace("text", r"(^|\n)From ", "$1>From "))
    _rows(spark, sf).select(F.concat(F.lit("From sender "), F.col("row_id").cast("string"), F.lit("\n"), said, F.lit("\n"))).write.text(to)
    got = files.mbox(spark, to)
    return got.select(F.regexp_extract("text", r"^Subject: (\d+)", 1).cast("bigint").alias("row_id"), F.sha2("text", 256).alias("digest"))


@query("""SELECT lower(hex(content_sha256)) AS id, count(*) AS records, CAST(sum(strlen(text)) AS BIGINT) AS octets, CAST(sum(coalesce(token_count, 0)) AS BIGINT) AS tokens, min(license) AS license, count(language) AS languages FROM text_rows GROUP BY 1""")
def shards_written(spark, sf):
    """All rows written as content-addressed shards, verified, and read back."""
    to = folder(spark)
    written = _written(spark, sf, to)
    if not sink.verify(written).isEmpty():
        raise ValueError("shards differ from what was written")
    r = shards.read_shards(spark, to)
    return r.groupBy(F.lower(F.hex("content_sha256")).alias("id")).agg(F.count(F.lit(1)).alias("records"), F.sum(F.octet_length("text")).cast("bigint").alias("octets"), F.sum("token_count").cast("bigint").alias("tokens"), F.min(F.when(F.col("license") != "none", F.col("license"))).alias("license"), F.count("language").alias("languages"))


def _written(spark, sf, to: str) -> DataFrame:
    from ..operators.drift import NAMES
    from ..session import checkpoint

    rows = _rows(spark, sf).withColumn("token_count", F.coalesce("token_count", F.lit(0))).withColumn("license", F.coalesce("license", F.lit("none")))
    return checkpoint(sink.write_shards(rows.select(*NAMES), to))


@query("""SELECT count(*) AS records, CAST(sum(coalesce(token_count, 0)) AS BIGINT) AS tokens, CAST(sum(strlen(text)) AS BIGINT) AS content_bytes, CAST(count(*) FILTER (email_addresses) AS BIGINT) AS email_addresses, CAST(count(*) FILTER (main_content) AS BIGINT) AS main_content, CAST(sum(redacted_phone_numbers) AS BIGINT) AS redacted_phone_numbers FROM text_rows""")
def shard_footers(spark, sf):
    """Totals from the footers of written shards alone."""
    to = folder(spark)
    _written(spark, sf, to)
    fact = lambda k: F.sum(F.col("facts")[f"corploom.{k}"].cast("bigint")).alias(k)
    return shards.footers(spark, to).agg(*[fact(k) for k in ("records", "tokens", "content_bytes", "email_addresses", "main_content", "redacted_phone_numbers")])


@query("SELECT 'recognised' AS state, count(*) AS records FROM text_rows")
def shard_attestations(spark, sf):
    """What the attestations of written shards vouch for."""
    to = folder(spark)
    _written(spark, sf, to)
    return shards.attested(shards.footers(spark, to)).groupBy("state").agg(F.sum("rows").alias("records"))


@query("""SELECT problem, CAST(sum(records) AS BIGINT) AS records FROM (SELECT 'duplicate' AS problem, count(*) AS records FROM text_rows GROUP BY content_sha256 HAVING count(*) > 1
 UNION ALL SELECT 'language_score', 1 FROM text_rows WHERE NOT coalesce(language_score BETWEEN 0 AND 1000, true) UNION ALL SELECT 'token_count', 1 FROM text_rows WHERE coalesce(token_count, 0) < 0
 UNION ALL SELECT 'meta', 1 FROM text_rows WHERE meta IS NOT NULL AND NOT (json_valid(meta) AND coalesce(json_type(CASE WHEN json_valid(meta) THEN meta END), '') = 'OBJECT') UNION ALL SELECT 'text', 1 FROM text_rows WHERE text = '') GROUP BY problem""")
def shard_audit(spark, sf):
    """Rules that the rows of written shards break, all files read."""
    to = folder(spark)
    _written(spark, sf, to)
    return shards.audit(spark, to, deep=True).groupBy("problem").agg(F.sum("records").cast("bigint").alias("records"))


@query("SELECT lower(hex(content_sha256)) AS id, strlen(text) AS octets, coalesce(token_count, 0) AS tokens, coalesce(license, 'none') AS license, language, source FROM text_rows")
def shard_listing(spark, sf):
    """The records of written shards as a listing shows them."""
    to = folder(spark)
    _written(spark, sf, to)
    return shards.listing(shards.read_shards(spark, to)).select("id", F.col("octets").cast("bigint").alias("octets"), "tokens", "license", "language", "source")


@query(f"""WITH o AS (SELECT CASE WHEN {_OUTCOME} = 'empty' THEN 'empty' WHEN license LIKE 'CC-BY-NC%' OR license IS NULL THEN 'license-policy' ELSE 'accepted' END AS outcome FROM text_rows), z AS (SELECT unnest(['empty', 'license-policy', 'accepted']) AS outcome)
SELECT z.outcome, count(o.outcome) AS records FROM z LEFT JOIN o USING (outcome) GROUP BY 1""")
def ingest_counters(spark, sf):
    """The whole pipeline over all rows as JSON Lines, with a licence policy: what became of the records (duplicates count as accepted)."""
    to = folder(spark)
    _rows(spark, sf).select(F.to_json(F.struct("row_id", "text", "source", "license", "date"))).write.text(f"{to}/in")
    p = mapping.Profile(text=("text",), source="source", license=("license",), date="date", meta={"id": "row_id"})
    counts, _ = ingest.ingest(spark, [f"{to}/in"], p, f"{to}/out", allowed=Values(["?*"], ["CC-BY-NC*"]))
    kinds = spark.createDataFrame([("empty",), ("license-policy",), ("accepted",)], "outcome string")
    of = F.when(F.col("outcome").isin("retained", "duplicate"), "accepted").otherwise(F.col("outcome"))
    return kinds.join(counts.groupBy(of.alias("outcome")).agg(F.sum("records").alias("records")), "outcome", "left").select("outcome", F.coalesce("records", F.lit(0)).alias("records"))


def queries() -> dict:
    """All queries by name."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Their SQL."""
    return dict(SQL)
