"""The ingest pipeline: read, map, redact, hash, deduplicate, count, assess, write, verify, describe; in this order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.policy import Values
from ..functions.privacy import is_repetitive, redacted, redacted_conversation, redacted_json
from ..operators import dedup, mapping
from ..operators.drift import NAMES
from ..session import checkpoint
from ..sinks import shards
from ..sources import files
from ..sources.shards import read_shards


def byte_count(rows: DataFrame) -> DataFrame:
    """rows with token_count by the byte tokenizer; the default where no other counter is given."""
    return rows.withColumn("token_count", F.octet_length("text").cast("bigint"))


def raw(spark: SparkSession, paths: list[str], profile: mapping.Profile, form: str, fields: dict[str, str] | None = None) -> DataFrame:
    """path, line, record (a JSON object) of files of a form: jsonl, json, parquet, text (markdown, whole files and chunks), mbox, xml.

    Texts and messages are objects with ``text``; XML records have ``fields`` (name: path of elements); of Parquet files
    the columns that the profile names are read.
    """
    one = lambda df, line: df.select("path", line.cast("bigint").alias("line"), F.to_json(F.struct("text")).alias("record"))
    if form in ("jsonl", "json"):
        return {"jsonl": files.jsonl, "json": files.json_objects}[form](spark, *paths)
    if form in ("text", "markdown"):
        return one(files.text_files(spark, *paths), F.col("chunk") + 1)
    if form == "mbox":
        return one(files.mbox(spark, *paths), F.col("message"))
    if form == "xml":
        x = files.xml_records(spark, *paths, fields=fields or {"text": "//text"})
        return x.select("path", F.lit(1).cast("bigint").alias("line"), F.to_json(F.struct(*[c for c in x.columns if c != "path"])).alias("record"))
    if form == "parquet":
        return files.parquet_records(spark, mapping.columns(profile), *paths)
    raise ValueError(f"unknown form {form!r}")


def logical(spark: SparkSession, paths: list[str], profile: mapping.Profile, form: str = "jsonl", fields: dict[str, str] | None = None) -> DataFrame:
    """Mapped records with their place: path, line, origin (sha256:<file>#line=<line>), outcome and the mapped fields."""
    mapped = mapping.map_records(raw(spark, paths, profile, form, fields), profile)
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    known = files.binary(spark, *paths).select(plain(F.col("path")).alias("_p"), F.sha2("content", 256).alias("_h"))
    # one row for each file
    placed = mapped.withColumn("_p", plain(F.col("path"))).join(known, "_p", "left").drop("_p")
    return placed.withColumn("origin", F.concat(F.lit("sha256:"), "_h", F.lit("#line="), F.col("line").cast("string"))).drop("_h")


def redact(rows: DataFrame) -> DataFrame:
    """text, source and meta redacted, the counts summed, the digest computed anew. kind tells plain texts from conversations."""
    r = rows.withColumn("_t", F.when(F.col("kind") == "conversation", redacted_conversation(F.when(F.col("kind") == "conversation", F.col("text")))).otherwise(redacted(F.when(F.col("kind") != "conversation", F.col("text")))))
    r = r.withColumns({"_s": redacted(F.col("source")), "_m": redacted_json(F.col("meta"))})
    total = lambda c: F.col(f"_t.{c}") + F.col(f"_s.{c}") + F.col(f"_m.{c}")
    counts = {"redacted_email_addresses": total("emails"), "redacted_ip_addresses": total("ips"), "redacted_phone_numbers": total("phones"), "removed_mail_routing_headers": total("headers"), "redacted_credentials": total("credentials")}
    r = r.withColumns(counts | {"text": F.col("_t.text"), "source": F.col("_s.text"), "meta": F.col("_m.text")})
    return r.drop("_t", "_s", "_m").withColumn("content_sha256", F.unhex(F.sha2("text", 256)))


def assess(rows: DataFrame) -> DataFrame:
    """The three content flags of every row, on the redacted text; a conversation is read as its contents and contexts."""
    said = F.from_json("text", "messages array<struct<role string, content string, context string>>")["messages"]
    spoken = F.array_join(F.flatten(F.transform(said, lambda m: F.filter(F.array(m["content"], m["context"]), lambda x: x.isNotNull()))), "\n")
    t = F.when(F.col("kind") == "conversation", spoken).otherwise(F.col("text"))
    return rows.withColumns({"email_addresses": T.has_email(t), "boilerplate_content": T.is_boilerplate(t) | T.is_boilerplate(t, paragraphs=True), "repetitive_content": is_repetitive(T.words(t))})


def clean(mapped: DataFrame, allowed: Values | None = None) -> DataFrame:
    """Every mapped record with its outcome, the good ones redacted and with their digest: path, line, kind, outcome and the columns of the layout so far.

    A licence that ``allowed`` forbids makes the outcome license-policy; such records, and others that are not good, keep no text.
    """
    placed = mapped
    c = mapping.canonical(placed, extra=("path", "line", "kind"))
    if allowed is not None:
        c = c.withColumn("outcome", F.when(allowed.allows(F.col("license")), "ok").otherwise("license-policy"))
    else:
        c = c.withColumn("outcome", F.lit("ok"))
    rejected = placed.where("outcome <> 'ok'").select("path", "line", "outcome")
    good = redact(c.where("outcome = 'ok'"))
    return good.unionByName(c.where("outcome <> 'ok'").select("path", "line", "outcome").unionByName(rejected), allowMissingColumns=True)


def prepare(cleaned: DataFrame, count: Callable[[DataFrame], DataFrame] = byte_count, existing: DataFrame | None = None) -> DataFrame:
    """Rows of the current layout, with path, line and kind, from clean(): deduplicate, count, assess.

    Of equal texts under one licence the first by path and line stays; what ``existing`` (content_sha256, license) has is dropped.
    """
    r = cleaned.where("outcome = 'ok'").drop("outcome")
    if existing is not None:
        r = dedup.not_present(r, existing, ["content_sha256", "license"])
    r = dedup.keep_first(r, ["content_sha256", "license"], ["path", "line"])
    return assess(count(r.drop("token_count"))).select("path", "line", "kind", *NAMES)


def counters(cleaned: DataFrame, retained: int) -> DataFrame:
    """outcome, records: rejections by reason, duplicates and retained records."""
    n = cleaned.groupBy("outcome").agg(F.count(F.lit(1)).alias("records"))
    ok = n.where("outcome = 'ok'").select(F.lit("duplicate").alias("outcome"), (F.col("records") - retained).alias("records"))
    return n.where("outcome <> 'ok'").unionByName(ok).unionByName(cleaned.sparkSession.createDataFrame([("retained", retained)], "outcome string, records long"))


def ingest(
    spark: SparkSession, paths: list[str], profile: mapping.Profile, folder: str, form: str = "jsonl", count: Callable[[DataFrame], DataFrame] = byte_count, name: str = "corpus", license_: str = "",
    fields: dict[str, str] | None = None, allowed: Values | None = None, existing: DataFrame | None = None,
) -> tuple[DataFrame, dict]:
    """The whole pipeline into a folder of a store that all executors reach; the counters and the manifest.

    The journal tells how far a job came: what was assembled is not assembled again, what was published is left as it
    is. Texts are kept once, redacted, between the passes; everything else between them is digests and places.
    """
    folder = folder.rstrip("/")
    journal = shards.Journal(f"{folder}/journal.json", {"paths": sorted(paths), "profile": repr(profile), "form": form, "name": name, "allowed": repr(allowed)})
    outcome = "outcome string, records long"
    if journal.state == "published":
        return spark.createDataFrame(journal.facts["counters"], outcome), journal.facts["manifest"]
    if journal.state in (None, "assembling"):
        journal.enter("assembling")
        cleaned = checkpoint(clean(logical(spark, paths, profile, form, fields), allowed))
        ordered = prepare(cleaned, count, existing).repartitionByRange(F.col("path"), F.col("line")).sortWithinPartitions("path", "line")
        written = checkpoint(shards.write_shards(ordered, f"{folder}/assembled", plan=journal.identity))
        wrong = shards.verify(written)
        if not wrong.isEmpty():
            raise ValueError(f"shards differ from what was written: {wrong.take(3)}")
        retained = written.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        # one row for each shard and each outcome
        journal.enter("assembled", written=[list(r) for r in written.collect()], counters=[[r["outcome"], r["records"]] for r in counters(cleaned, retained).collect()])
    written = spark.createDataFrame(journal.facts["written"], shards.WRITTEN)
    if journal.state == "assembled":
        journal.enter("publishing")
    published = shards.publish(written, f"{folder}/shards")
    published.write.format("noop").mode("overwrite").save()
    rows = None if written.isEmpty() else read_shards(spark, f"{folder}/shards")
    m = shards.manifest(written, name, name, license_, [], rows)
    journal.enter("published", manifest=m)
    return spark.createDataFrame(journal.facts["counters"], outcome), m
