"""Selections of a catalogue: boundaries of inputs, pins of objects, updates, gaps of evidence, outcomes of ingest."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import catalog


def boundary_claims(files: DataFrame, boundaries: DataFrame) -> DataFrame:
    """path, source, claims: the sources whose boundary (a whole leading part of a path) holds each file, and how many do.

    files: path; boundaries: source, prefix. A file with no or several claims has a null source. The files' own leading
    parts are joined by equality, so no pairs are tried.
    """
    parts = F.split("path", "/")
    own = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    each = files.select("path").distinct().select("path", F.explode(own).alias("prefix")).join(boundaries.select("source", "prefix").distinct(), "prefix", "left")
    g = each.groupBy("path").agg(F.count("source").alias("claims"), F.min("source").alias("source"))
    return g.select("path", F.when(F.col("claims") == 1, F.col("source")).alias("source"), "claims")


def inventory_line(sha256: Column, size: Column, path: Column) -> Column:
    """A line of a tree's inventory: digest, bytes and path."""
    return F.concat(sha256, F.lit("\t"), size.cast("string"), F.lit("\t"), path, F.lit("\n"))


def boundary_evidence(files: DataFrame) -> DataFrame:
    """source, files, bytes, tree: counts and the digest of the inventory of every source's files (source, path, sha256, bytes), by path.

    The digest is one over all lines in order by definition; a source's lines meet in one task (some hundred bytes a file).
    """
    line = F.struct("path", inventory_line(F.col("sha256"), F.col("bytes"), F.col("path")).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"])
    return files.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").cast("bigint").alias("bytes"), F.sha2(F.array_join(lines, ""), 256).alias("tree"))


def verify_boundaries(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """source, problem of sources whose declared files, bytes or tree differ from what is there, or that only one side has."""
    d = declared.select("source", F.struct("files", "bytes", "tree").alias("d"))
    both = d.join(actual.select("source", F.struct("files", "bytes", "tree").alias("a")), "source", "full")
    problem = (
        F.when(F.col("d").isNull(), "undeclared").when(F.col("a").isNull(), "missing").when(~F.col("d.files").eqNullSafe(F.col("a.files")), "files")
        .when(~F.col("d.bytes").eqNullSafe(F.col("a.bytes")), "bytes").when(~F.col("d.tree").eqNullSafe(F.col("a.tree")), "tree")
    )
    return both.select("source", problem.alias("problem")).where("problem is not null")


def tree_digest(files: DataFrame) -> str:
    """The digest of a whole tree's inventory (path, sha256, bytes). Lines stream to the driver in order; never more than a part of them is held."""
    digest = hashlib.sha256()
    for r in files.select("path", inventory_line(F.col("sha256"), F.col("bytes"), F.col("path")).alias("line")).orderBy("path").toLocalIterator():
        digest.update(r["line"].encode())
    return digest.hexdigest()


def tree_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """side (left, right), and the rows that only that side has, as often as it has more of them; none if the trees are equal."""
    return a.exceptAll(b).select(F.lit("left").alias("side"), "*").unionByName(b.exceptAll(a).select(F.lit("right").alias("side"), "*"))


def changed_files(planned: DataFrame, now: DataFrame) -> DataFrame:
    """path, state (unchanged, changed, missing, new) of files whose digest, size or time was planned (path, sha256, bytes, modified)."""
    p = planned.select("path", F.struct("sha256", "bytes", "modified").alias("p"))
    both = p.join(now.select("path", F.struct("sha256", "bytes", "modified").alias("n")), "path", "full")
    state = F.when(F.col("p").isNull(), "new").when(F.col("n").isNull(), "missing").when(F.col("p").eqNullSafe(F.col("n")), "unchanged").otherwise("changed")
    return both.select("path", state.alias("state"))


def object_states(pins: DataFrame, objects: DataFrame) -> DataFrame:
    """sha256, bytes, state (available, wrong-size, missing) of every distinct pin; only sizes are read, no content."""
    have = objects.groupBy("sha256").agg(F.collect_set("bytes").alias("_sizes"))
    both = pins.select("sha256", "bytes").distinct().join(have, "sha256", "left")
    state = F.when(F.col("_sizes").isNull(), "missing").when(F.array_contains("_sizes", F.col("bytes")), "available").otherwise("wrong-size")
    return both.select("sha256", "bytes", state.alias("state"))


def object_listing(paths: DataFrame) -> DataFrame:
    """paths with sha256, canonical: the digest in a path aa/bb/<digest>, and whether its two folders are the digest's beginning."""
    digest = F.regexp_extract("path", r"(?:^|/)([0-9a-f]{64})(?:\.[a-z0-9]+)?$", 1)
    folders = F.regexp_extract("path", r"(?:^|/)([0-9a-f]{2})/([0-9a-f]{2})/[0-9a-f]{64}(?:\.[a-z0-9]+)?$", 1), F.regexp_extract("path", r"(?:^|/)([0-9a-f]{2})/([0-9a-f]{2})/[0-9a-f]{64}(?:\.[a-z0-9]+)?$", 2)
    right = (digest != "") & (F.substring(digest, 1, 2) == folders[0]) & (F.substring(digest, 3, 2) == folders[1])
    return paths.withColumn("sha256", F.when(digest != "", digest)).withColumn("canonical", right)


def fetch_plan(pins: DataFrame) -> DataFrame:
    """sha256, url, bytes, references, conflict: one fetch for each distinct object (the first address by name); conflict if its pins have several sizes."""
    return pins.groupBy("sha256").agg(F.min("url").alias("url"), F.min("bytes").alias("bytes"), F.count(F.lit(1)).alias("references"), (F.coalesce(F.min("bytes") != F.max("bytes"), F.lit(False))).alias("conflict"))


def export_mismatches(files: DataFrame, pins: DataFrame) -> DataFrame:
    """ordinal, problem of an export's files (ordinal, sha256, bytes) that are not one to one the pins of its selection, place by place."""
    both = files.select("ordinal", F.struct("sha256", "bytes").alias("f")).join(pins.select("ordinal", F.struct("sha256", "bytes").alias("p")), "ordinal", "full")
    problem = F.when(F.col("p").isNull(), "unexpected").when(F.col("f").isNull(), "missing").when(~F.col("f.sha256").eqNullSafe(F.col("p.sha256")), "digest").when(~F.col("f.bytes").eqNullSafe(F.col("p.bytes")), "size")
    return both.select("ordinal", problem.alias("problem")).where("problem is not null")


def keep_context(new: DataFrame, old: DataFrame, keep: list[str]) -> DataFrame:
    """new (ordinal, name, url) with the columns ``keep`` of the first old source (by its ordinal) that has its name or its url; nulls if none has.

    Two joins by equality, one for each way to match, and a minimum: no pairs of other sources are tried.
    """
    o = F.struct("ordinal", *keep).alias("_o")
    by_name = new.select("ordinal", "name").join(old.select("name", o), "name").select("ordinal", "_o")
    by_url = new.select("ordinal", "url").join(old.select("url", o), "url").select("ordinal", "_o")
    first = by_name.unionByName(by_url).groupBy("ordinal").agg(F.min_by("_o", "_o.ordinal").alias("_o"))
    return new.join(first, "ordinal", "left").select(*new.columns, *[F.col(f"_o.{k}").alias(k) for k in keep])


def declared_languages(declarations: DataFrame) -> DataFrame:
    """corpus, languages: every language declared for a corpus or for one of its sources (corpus, languages array), each once, sorted, lower case."""
    each = declarations.select("corpus", F.explode_outer("languages").alias("l")).select("corpus", F.lower(F.trim("l")).alias("l"))
    return each.groupBy("corpus").agg(F.array_sort(F.collect_set(F.when(F.col("l") != "", F.col("l")))).alias("languages"))


def index_summary(shards: DataFrame, rows: DataFrame) -> DataFrame:
    """license, shards, docs, tokens, bytes over the catalogue, and a row with license null for the totals; they do not add up by design.

    A shard with several licences counts once for each, gives docs and tokens by its rows' licences and no bytes; one
    with a single licence gives its own totals. Shards without rows have the licence they declare. shards: shard_id,
    license, docs, tokens, bytes; rows: shard_id, license, token_count.
    """
    use = rows.where("license is not null").groupBy("shard_id", "license").agg(F.count(F.lit(1)).alias("u_docs"), F.sum(F.coalesce("token_count", F.lit(0))).cast("bigint").alias("u_tokens"))
    several = use.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = shards.select("shard_id", F.col("license").alias("declared"), "docs", "tokens", "bytes").join(several, "shard_id", "left").join(use, "shard_id", "left")
    many = zero("n") > 1
    each = both.select(F.coalesce("license", "declared").alias("license"), F.when(many, F.col("u_docs")).otherwise(zero("docs")).alias("docs"), F.when(many, F.col("u_tokens")).otherwise(zero("tokens")).alias("tokens"), F.when(many, 0).otherwise(zero("bytes")).alias("bytes"))
    sums = [F.count(F.lit(1)).alias("shards"), *[F.sum(m).cast("bigint").alias(m) for m in catalog.MEASURES]]
    by_license = each.where("license is not null").groupBy("license").agg(*sums)
    total = shards.agg(F.count(F.lit(1)).alias("shards"), *[F.coalesce(F.sum(m), F.lit(0)).cast("bigint").alias(m) for m in catalog.MEASURES])
    return by_license.unionByName(total.withColumn("license", F.lit(None).cast("string")))


def bom_totals(shards: DataFrame, allowed: Column) -> DataFrame:
    """corpus, license, modality, shards, docs, tokens, bytes of the shards a policy allows: over all, by corpus, by licence, by corpus and licence, by modality.

    One pass with grouping sets; level tells the set. Corpora all of whose shards are excluded stay, with nothing.
    """
    ok = shards.withColumn("_ok", F.coalesce(allowed, F.lit(False)))
    sets = [[], [F.col("corpus")], [F.col("license")], [F.col("corpus"), F.col("license")], [F.col("modality")]]
    sums = [F.count_if("_ok").alias("shards"), *[F.sum(F.when(F.col("_ok"), F.coalesce(F.col(m), F.lit(0))).otherwise(0)).cast("bigint").alias(m) for m in catalog.MEASURES]]
    g = ok.groupingSets(sets, "corpus", "license", "modality").agg(F.grouping_id().cast("int").alias("level"), *sums)
    return g.where((F.col("shards") > 0) | (F.col("level") == 3) | (F.col("level") == 7))


def tree_totals_once(edges: DataFrame, leaves: DataFrame, rounds: int = 64) -> DataFrame:
    """node, objects, docs, tokens, bytes of every node of a tree of catalogues: each object (sha256) below a node counts once there, however often it is listed.

    edges: parent, child; leaves: node, sha256, docs, tokens, bytes. An object listed with several sizes is an error of
    the catalogue and has its greatest. Each level carries distinct objects; a deeper tree than ``rounds`` or a circle is an error.
    """
    from ..session import checkpoint

    one = lambda df: df.groupBy("node", "sha256").agg(*[F.max(m).alias(m) for m in catalog.MEASURES])
    level, out = one(leaves), one(leaves)
    for _ in range(rounds):
        level = checkpoint(one(level.join(edges, level["node"] == edges["child"]).select(F.col("parent").alias("node"), "sha256", *catalog.MEASURES)))
        if level.isEmpty():
            return one(out).groupBy("node").agg(F.count(F.lit(1)).alias("objects"), *[F.sum(F.coalesce(F.col(m), F.lit(0))).cast("bigint").alias(m) for m in catalog.MEASURES])
        out = out.unionByName(level)
    raise ValueError(f"the tree has more than {rounds} levels or a circle")


def outcomes(rows: DataFrame, allowed: Column) -> DataFrame:
    """source, outcome (kept, empty, license-policy), records of ingested rows: an empty text comes before a licence that is not allowed."""
    blank = F.col("text").isNull() | (F.regexp_replace("text", r"[\s ]+", "") == "")
    outcome = F.when(blank, "empty").when(~F.coalesce(allowed, F.lit(False)), "license-policy").otherwise("kept")
    return rows.groupBy("source", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("records"))


def source_of(inputs: DataFrame, sources: DataFrame) -> DataFrame:
    """inputs (source_id) with the name and licence that their source declares; an input of an undeclared source has nulls and unknown true."""
    s = sources.dropDuplicates(["source_id"]).select("source_id", F.col("name").alias("source_name"), F.col("license").alias("source_license"), F.lit(False).alias("_known"))
    return inputs.join(s, "source_id", "left").withColumn("unknown", F.coalesce("_known", F.lit(True))).drop("_known")


#: What evidence a category of sources needs: field, section, column that must be there.
CATEGORY_EVIDENCE = {
    "commercially-licensed": ("source.acquisition-basis", "2.2", "basis"),
    "web-crawl": ("source.web-evidence", "2.3", "crawler"),
    "user-data": ("source.user-data", "2.4", "service"),
    "synthetic": ("source.synthetic", "2.5", "generator"),
}

#: What evidence every source needs: column, field, section, severity.
SOURCE_EVIDENCE = (("usage", "source.usage", "1.3", "required"), ("types", "source.content-types", "1.3", "required"), ("languages", "source.languages", "1.3", "review"), ("collected_to", "source.acquisition-date", "1.3", "required"))


def disclosure_gaps(sources: DataFrame) -> DataFrame:
    """section, field, context, severity of every missing piece of evidence of sources (context, category, and string columns; null or blank is missing).

    Rules are columns of one pass: a source is read once, whatever the number of rules. Required gaps block a report.
    """
    absent = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    category = catalog.canonical_category(F.col("category"))
    gap = lambda test, field, section, severity: F.when(test, F.struct(F.lit(section).alias("section"), F.lit(field).alias("field"), F.lit(severity).alias("severity")))
    rules = [gap(category.isNull(), "source.category", "2", "required")]
    rules += [gap(absent(c), field, section, severity) for c, field, section, severity in SOURCE_EVIDENCE]
    rules += [gap((category == k) & absent(c), field, section, "required") for k, (field, section, c) in CATEGORY_EVIDENCE.items()]
    found = sources.select("context", F.explode(F.filter(F.array(*rules), lambda g: g.isNotNull())).alias("g"))
    return found.select("g.section", "g.field", "context", "g.severity")


#: What is advised for a run in a state before its losses are seen.
BASE_ADVICE = {"running": "let-run", "failed": "fix", "interrupted": "fix", "complete": "complete"}


def run_advice(telemetry: DataFrame, runs: DataFrame, now: Column, stale: str = "INTERVAL 10 MINUTES") -> DataFrame:
    """run_id, state, first, latest (held-out loss), change, observed, advice of every run (run_id, state).

    telemetry: run_id, observed, loss, heldout_loss. A loss that is not finite, or a held-out loss grown by more than a
    quarter, means stop; by more than a twentieth, or nothing heard of a running run for ten minutes, inspect, where
    nothing but letting it run was advised.
    """
    seen, at = F.col("heldout_loss").isNotNull(), F.col("observed")
    bad = F.isnan("last_loss") | (F.abs("last_loss") == float("inf"))
    g = telemetry.groupBy("run_id").agg(
        F.min_by("heldout_loss", F.when(seen, at)).alias("first"), F.max_by("heldout_loss", F.when(seen, at)).alias("latest"), F.max_by("loss", F.when(F.col("loss").isNotNull(), at)).alias("last_loss"), F.max("observed").alias("observed")
    )
    base = F.coalesce(F.create_map(*[F.lit(x) for p in BASE_ADVICE.items() for x in p])[F.col("state")], F.lit("wait"))
    j = runs.join(g, "run_id", "left").withColumn("change", F.when(F.col("first") > 0, F.col("latest") / F.col("first") - 1))
    quiet = (F.col("state") == "running") & (F.col("observed") + F.expr(stale) < now)
    let = base == "let-run"
    advice = F.when(F.coalesce(bad, F.lit(False)) | F.coalesce(F.col("change") > 0.25, F.lit(False)), "stop").when(let & (F.coalesce(F.col("change") > 0.05, F.lit(False)) | F.coalesce(quiet, F.lit(False))), "inspect").otherwise(base)
    return j.select("run_id", "state", "first", "latest", "change", "observed", advice.alias("advice"))


def latest_values(telemetry: DataFrame, keys: list[str], fields: list[str], order: list[str]) -> DataFrame:
    """keys, and for each field its latest value that is not null by ``order``: one pass, whatever the number of fields."""
    at = F.struct(*order)
    return telemetry.groupBy(*keys).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields])


def turns_to_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, messages, valid of turns (conv_id, turn, role, text): the turns in order; turns without text are left out.

    valid: roles are system, user, assistant or tool, and a user and an assistant speak. A conversation's turns meet in one task.
    """
    said = turns.where("text is not null and text <> ''")
    one = F.struct("turn", F.lower(F.trim("role")).alias("role"), F.col("text").alias("content"))
    g = said.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("m")).select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"), F.lit(None).cast("string").alias("context"))).alias("messages"))
    has = lambda r: F.exists("messages", lambda m: m["role"] == r)
    known = F.forall("messages", lambda m: m["role"].isin("system", "user", "assistant", "tool"))
    return g.withColumn("valid", F.coalesce(known & has("user") & has("assistant"), F.lit(False)))

