"""Catalogue operators: summaries, totals by manifest and licence, roll-up trees, reconciliation, inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEASURES = ("docs", "tokens", "bytes")


def _sums():
    return [F.sum(F.coalesce(F.col(m), F.lit(0))).cast("bigint").alias(m) for m in MEASURES]


def shard_summary(rows: DataFrame) -> DataFrame:
    """Records, tokens, bytes, flags, redactions and licences of each shard, from its rows."""
    count = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False))).cast("bigint").alias(c)
    flags = ("email_addresses", "repetitive_content", "boilerplate_content", "main_content")
    counters = ("redacted_email_addresses", "redacted_ip_addresses", "redacted_phone_numbers", "removed_mail_routing_headers", "redacted_credentials")
    return rows.groupBy("shard_id").agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.coalesce("token_count", F.lit(0))).cast("bigint").alias("tokens"), F.sum(F.octet_length("text")).cast("bigint").alias("content_bytes"),
        *[count(c) for c in flags], *[F.sum(c).cast("bigint").alias(c) for c in counters], F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
    )


def totals(shards: DataFrame) -> DataFrame:
    """Totals over all, by corpus, by licence, and by both, in one pass: grouping sets."""
    g = shards.cube("corpus", "license").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("shards"), *_sums())
    return g


def reconcile(declared: DataFrame, rows: DataFrame) -> DataFrame:
    """Shards whose declared docs or tokens differ from what their rows give; a null declaration differs from any number."""
    actual = rows.groupBy("shard_id").agg(F.count(F.lit(1)).alias("actual_docs"), F.sum(F.coalesce("token_count", F.lit(0))).cast("bigint").alias("actual_tokens"))
    both = declared.select("shard_id", F.col("docs").alias("declared_docs"), F.col("tokens").alias("declared_tokens")).join(actual, "shard_id", "left")
    both = both.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("actual_docs", "actual_tokens")})
    return both.where(~F.col("declared_docs").eqNullSafe(F.col("actual_docs")) | ~F.col("declared_tokens").eqNullSafe(F.col("actual_tokens")))


def inventory(objects: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Every key of either side with its state: referenced, unreferenced or missing."""
    a = objects.select(key).distinct().withColumn("_a", F.lit(True))
    b = references.groupBy(key).agg(F.count(F.lit(1)).alias("references"))
    state = F.when(F.col("_a").isNull(), "missing").when(F.col("references").isNull(), "unreferenced").otherwise("referenced")
    return a.join(b, key, "full_outer").select(key, state.alias("state"), F.coalesce("references", F.lit(0)).alias("references"))


def tree_totals(edges: DataFrame, leaves: DataFrame, value: str, rounds: int = 64) -> DataFrame:
    """The sum of the leaves below every node: edges (parent, child), leaves (node, value). Each leaf counts once in an ancestor.

    The tree is climbed one level at a time on sums by node, never on single leaves, so every round shrinks.
    A tree deeper than ``rounds`` (or a circle) is an error.
    """
    from ..session import checkpoint

    level = leaves.groupBy("node").agg(F.sum(value).cast("bigint").alias(value))
    out = level
    for _ in range(rounds):
        level = level.join(edges, level["node"] == edges["child"]).groupBy("parent").agg(F.sum(value).cast("bigint").alias(value)).withColumnRenamed("parent", "node")
        level = checkpoint(level)
        if level.isEmpty():
            return out.groupBy("node").agg(F.sum(value).cast("bigint").alias(value))
        out = out.unionByName(level)
    raise ValueError(f"the tree has more than {rounds} levels or a circle")


def longest_prefix(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Each path with the longest prefix that is a whole part of it: the paths' own prefixes are joined by equality, no pairs are tried."""
    parts = F.split("path", "/")
    own = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    each = paths.select("path", F.explode(own).alias("prefix"))
    found = each.join(prefixes.select("prefix").distinct(), "prefix")
    best = found.groupBy("path").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))
    return paths.select("path").distinct().join(best, "path", "left")


def canonical_category(c):
    """A source category without case, white space and underscores; public means public-dataset; unknown ones are null."""
    known = ("public-dataset", "commercially-licensed", "private-third-party", "web-crawl", "user-data", "synthetic", "other")
    v = F.regexp_replace(F.lower(F.trim(c)), "[ _]+", "-")
    return F.when(v == "public", "public-dataset").when(v.isin(*known), v)


def license_usage(rows: DataFrame) -> DataFrame:
    """shard_id, usage: docs and tokens of every licence in a shard, as a map."""
    each = rows.groupBy("shard_id", "license").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.coalesce("token_count", F.lit(0))).cast("bigint").alias("tokens")).where("license is not null")
    entry = F.struct("license", F.struct("docs", "tokens"))
    return each.groupBy("shard_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("usage"))


def by_language(corpora: DataFrame, languages: list[str]) -> DataFrame:
    """Corpora (with an array ``languages``) that declare any of the languages, whatever their case; undeclared ones never match."""
    wanted = F.array(*[F.lit(x.lower()) for x in languages])
    return corpora.where(F.coalesce(F.arrays_overlap(F.transform("languages", F.lower), wanted), F.lit(False)))


def not_completed(selected: DataFrame, completed: DataFrame) -> DataFrame:
    """Selections whose path (without .yaml, .yml, .json) no completed run has."""
    plain = lambda c: F.regexp_replace(c, r"\.(ya?ml|json)$", "")
    return selected.withColumn("_p", plain(F.col("path"))).join(completed.select(plain(F.col("path")).alias("_p")).distinct(), "_p", "left_anti").drop("_p")


def advice(telemetry: DataFrame) -> DataFrame:
    """run_id, first, latest (held-out loss), change, advice (stop, inspect, continue) of every training run.

    The held-out loss grown by more than a quarter, or a loss that is not finite, means stop; by more than a
    twentieth, inspect. Runs without held-out losses go on.
    """
    at = F.struct("step", "elapsed_seconds")
    seen = F.col("heldout_loss").isNotNull()
    g = telemetry.groupBy("run_id").agg(F.min_by("heldout_loss", F.when(seen, at)).alias("first"), F.max_by("heldout_loss", F.when(seen, at)).alias("latest"), F.max(F.coalesce(F.isnan("loss"), F.lit(False)) | F.coalesce(F.abs("loss") == float("inf"), F.lit(False))).alias("broken"))
    change = F.col("latest") / F.col("first") - 1
    return g.select("run_id", "first", "latest", change.alias("change"), F.when(F.col("broken") | (change > 0.25), "stop").when(change > 0.05, "inspect").otherwise("continue").alias("advice"))
