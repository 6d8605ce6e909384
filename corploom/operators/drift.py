"""Schemas that drift between files: field profiles, changes between files, and one table of the current layout.

A field's profile has its types, sketches of its values (minimum hashes of values, words and shapes, numeric range)
and is small whatever the size of the file. Fields that left and fields that came in the same file are matched one
to one (bipartite matching on types, sketches and names); matched pairs are renames.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Minimum hashes of each kind in a sketch.
HASHES = 12

#: Score from which a field that left and one that came are the same.
SAME = 0.5

#: Kinds of JSON values by the name of their variant type.
KINDS = {"STRING": "string", "BIGINT": "integer", "DOUBLE": "fraction", "FLOAT": "fraction", "BOOLEAN": "boolean", "ARRAY": "array", "OBJECT": "object"}

#: Fields of the current layout and other names they had in older layouts or have in feeds (compared without case, underscores and a leading is).
NAMES = {
    "content_sha256": ("sha256",),
    "text": ("body", "content"),
    "source": ("origin",),
    "source_name": ("sourcename",),
    "license": ("licence", "rights"),
    "license_raw": ("licenceraw",),
    "language": ("lang", "locale"),
    "language_score": ("langscore", "langconf"),
    "date": ("issuedon", "published"),
    "token_count": ("tokens", "ntokens"),
    "meta": ("extra", "attributes", "metadata"),
    "email_addresses": (),
    "repetitive_content": ("repetitive",),
    "boilerplate_content": ("boilerplate",),
    "main_content": ("main",),
    "redacted_email_addresses": (),
    "redacted_ip_addresses": (),
    "redacted_phone_numbers": (),
    "removed_mail_routing_headers": (),
    "redacted_credentials": (),
}


def field_values(records: DataFrame) -> DataFrame:
    """feed, file_no, field, kind, value of every top-level field of every record; kind is null for a JSON null.

    Records that are null, not JSON or not an object have no fields.
    """
    parsed = records.select("feed", "file_no", F.try_parse_json("record_json").alias("v")).where("v is not null and schema_of_variant(v) like 'OBJECT%'")
    each = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("key").alias("field"), F.col("value").alias("held"))).select("feed", "file_no", "field", F.col("held").alias("v"))
    raw = F.regexp_extract(F.expr("schema_of_variant(v)"), "^([A-Z]+)", 1)
    text = F.expr("cast(v as string)")
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[raw]
    # a number written with a point or an exponent is a fraction, one without is an integer of any size
    kind = F.when(raw == "DECIMAL", F.when(text.contains("."), "fraction").otherwise("integer")).otherwise(kind)
    return each.select("feed", "file_no", "field", kind.alias("kind"), text.alias("value"))


def profiles(records: DataFrame) -> DataFrame:
    """One row per feed, file_no and field: records, nulls, kind of most non-null values (null if none) and the sketch."""
    v = field_values(records)
    words = F.filter(F.split(F.lower("value"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    shape = F.regexp_replace(F.regexp_replace("value", r"[0-9]+", "9"), r"\p{L}+", "a")
    v = v.withColumn("words", F.array_distinct(words)).withColumn("shape", shape)
    number = F.when(F.col("kind").isin("integer", "fraction"), F.expr("try_cast(value as double)"))
    aggs = [
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("kind").isNull()).alias("nulls"),
        *[F.count_if(F.col("kind") == k).alias(f"is_{k}") for k in sorted(set(KINDS.values()))],
        F.min(number).alias("least"), F.max(number).alias("most"), F.avg(number).alias("mean"),
        F.avg(F.length("value")).alias("length"),
        F.array(*[F.min(F.when(F.col("kind").isNotNull(), F.xxhash64("value", F.lit(i)))) for i in range(HASHES)]).alias("value_hashes"),
        F.array(*[F.min(F.when(F.col("kind").isNotNull(), F.xxhash64("shape", F.lit(i)))) for i in range(HASHES)]).alias("shape_hashes"),
        F.array(*[F.min(F.array_min(F.transform("words", lambda w, i=i: F.xxhash64(w, F.lit(i))))) for i in range(HASHES)]).alias("word_hashes"),
    ]
    p = v.groupBy("feed", "file_no", "field").agg(*aggs)
    best = F.array_max(F.array(*[F.struct(F.col(f"is_{k}").alias("n"), F.lit(k).alias("k")) for k in sorted(set(KINDS.values()))]))
    return p.withColumn("kind", F.when(best["n"] > 0, best["k"])).drop(*[f"is_{k}" for k in set(KINDS.values())])


def name_parts(name: str) -> list[str]:
    """A name's words: split at underscores, other signs and changes of case, lower-cased, without is and n."""
    parts = [w.lower() for w in re.findall(r"[A-Z]?[^\W\dA-Z_]+|[A-Z]+|\d+", name)]
    return [w for w in parts if w not in ("is", "n", "num")] or parts


def name_likeness(a: str, b: str) -> float:
    """Likeness of two names from 0 to 1: of their words (one may begin the other), or of their letter pairs."""
    x, y = name_parts(a), name_parts(b)
    if not x or not y:
        return 0.0
    like = lambda p, q: p == q or (min(len(p), len(q)) >= 3 and (p.startswith(q) or q.startswith(p))) or p.rstrip("s") == q.rstrip("s")
    words = (sum(any(like(p, q) for q in y) for p in x) + sum(any(like(p, q) for p in x) for q in y)) / (len(x) + len(y))
    s, t = "".join(x), "".join(y)
    pairs = lambda w: {w[i : i + 2] for i in range(len(w) - 1)}
    p, q = pairs(s), pairs(t)
    letters = 2 * len(p & q) / (len(p) + len(q)) if p and q else 0.0
    return max(words, letters)


def _shared(a, b) -> float:
    pairs = [(x, y) for x, y in zip(a, b) if x is not None and y is not None and x == x and y == y]
    return sum(x == y for x, y in pairs) / len(pairs) if pairs else 0.0


def likeness(a: dict, b: dict) -> float:
    """How likely two profiles are of one field, from 0 to 1: by kind, values and name."""
    name = name_likeness(a["field"], b["field"])
    if a["kind"] is None or b["kind"] is None:
        return 0.9 * name
    numbers = {"integer", "fraction"}
    kind = 1.0 if a["kind"] == b["kind"] else 0.5 if {a["kind"], b["kind"]} <= numbers else 0.0
    values, shapes, words = (_shared(a[k], b[k]) for k in ("value_hashes", "shape_hashes", "word_hashes"))
    if a["kind"] in numbers and b["kind"] in numbers:
        low, high = max(a["least"], b["least"]), min(a["most"], b["most"])
        span = max(a["most"], b["most"]) - min(a["least"], b["least"])
        # overlap of the ranges, and nearness of the means within them
        same = 1.0 if span == 0 else max(0.0, high - low) / span * max(0.0, 1 - 2 * abs(a["mean"] - b["mean"]) / span)
        value = max(values, same)
    else:
        value = max(values, words, 0.8 * shapes)
    if a["kind"] == b["kind"] == "boolean" or (value > 0 and max(len(set(a["value_hashes"])), len(set(b["value_hashes"]))) <= 2):
        value *= 0.5  # two values or so say little
    if kind == 0.0:
        value *= 0.5
    return max(0.4 * kind + 0.4 * value + 0.2 * name, 0.9 * name)


def assign(scores: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns with the greatest sum of scores (Hungarian method with potentials)."""
    turned = scores.shape[0] > scores.shape[1]
    cost = -(scores.T if turned else scores)
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = ~used
            free[0] = False
            reduced = np.full(m + 1, np.inf)
            reduced[1:] = cost[i0 - 1] - u[i0] - v[1:]
            better = free & (reduced < least)
            least[better], way[better] = reduced[better], j0
            j1 = int(np.argmin(np.where(free, least, np.inf)))
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[free] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return [(b, a) for a, b in pairs] if turned else pairs


_PROFILE = "field string, kind string, least double, most double, mean double, value_hashes array<bigint>, shape_hashes array<bigint>, word_hashes array<bigint>"


def renames(profile: DataFrame, files: DataFrame) -> DataFrame:
    """feed, file_no, old, new: fields matched across a file and the one before it.

    Only what left and what came between the two files is compared: a few fields, whatever the files' size.
    """
    facts = F.struct("field", "kind", "least", "most", "mean", "value_hashes", "shape_hashes", "word_hashes")
    now = profile.select("feed", "file_no", "field", facts.alias("new"))
    back = files.select("feed", F.col("file_no").alias("at"), F.col("before").alias("file_no")).where("file_no is not null")
    then = profile.join(back, ["feed", "file_no"]).select("feed", F.col("at").alias("file_no"), "field", facts.alias("old"))
    both = now.join(files.where("before is not null").select("feed", "file_no"), ["feed", "file_no"]).join(then, ["feed", "file_no", "field"], "full")
    moved = both.where("new is null or old is null").groupBy("feed", "file_no")
    moved = moved.agg(F.collect_list("old").alias("gone"), F.collect_list("new").alias("come")).where("size(gone) > 0 and size(come) > 0")

    def match(batches):
        for pdf in batches:
            out = []
            for feed, file_no, gone, come in zip(pdf["feed"], pdf["file_no"], pdf["gone"], pdf["come"]):
                gone, come = (sorted(({k: (None if isinstance(v, float) and v != v else v) for k, v in dict(x).items()} for x in side), key=lambda x: x["field"]) for side in (gone, come))
                scores = np.array([[likeness(a, b) for b in come] for a in gone])
                out += [(feed, file_no, gone[i]["field"], come[j]["field"]) for i, j in assign(np.where(scores >= SAME, scores, 0)) if scores[i, j] >= SAME]
            yield pd.DataFrame(out, columns=["feed", "file_no", "old", "new"])

    return moved.mapInPandas(match, "feed string, file_no int, old string, new string")


def changes(records: DataFrame) -> DataFrame:
    """feed, file_no, field_name, change_kind (added, removed, renamed, retyped) between each file and the one before it in its feed.

    A file has a field if any record has it, even as null. The type of a field is that of most of its non-null values
    (of equals the last by name); a field of nulls only keeps its earlier type, also across a rename. Files without a
    readable record have no fields. The order of rows and the time of writing do not matter.
    """
    from ..session import checkpoint

    records = records.select("feed", "file_no", "record_json").where("feed is not null and file_no is not null")
    order = Window.partitionBy("feed").orderBy("file_no")
    files = records.select("feed", "file_no").distinct().withColumn("before", F.lag("file_no").over(order))
    profile = checkpoint(profiles(records))
    files = checkpoint(files)
    renamed = checkpoint(renames(profile, files))
    there = profile.select("feed", "file_no", "field", "kind")
    back = files.select("feed", F.col("file_no").alias("at"), F.col("before").alias("file_no")).where("file_no is not null")

    carried = _carry(chains(there, files, renamed))
    then = carried.join(back, ["feed", "file_no"]).select("feed", F.col("at").alias("file_no"), F.col("field").alias("old"), F.col("kind").alias("old_kind"))
    now = carried.join(files.where("before is not null").select("feed", "file_no"), ["feed", "file_no"]).join(renamed.withColumnRenamed("new", "field"), ["feed", "file_no", "field"], "left")
    now = now.withColumn("is_renamed", F.col("old").isNotNull()).withColumn("old", F.coalesce("old", "field"))
    then = then.withColumn("had", F.lit(True))
    both = now.join(then, ["feed", "file_no", "old"], "full").withColumn("had", F.coalesce("had", F.lit(False)))
    kinds = F.array(
        F.when(~F.col("had"), "added"),
        F.when(F.col("field").isNull(), "removed"),
        F.when(F.col("is_renamed"), "renamed"),
        F.when(F.col("field").isNotNull() & (F.col("old_kind") != F.col("kind")), "retyped"),
    )
    return both.select("feed", "file_no", F.coalesce("field", "old").alias("field_name"), F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("change_kind"))


def chains(there: DataFrame, files: DataFrame, renamed: DataFrame) -> DataFrame:
    """there with root and since: the field and file with which the chain of renames that a field stands in began (since null: from the start).

    A name that was left by a rename and is used again begins anew. The chains, however long, are followed by doubling:
    every round halves what is left of them, and only the renames themselves are joined.
    """
    from ..session import checkpoint

    events = renamed.select("feed", "file_no", F.explode(F.array("old", "new")).alias("field")).distinct()
    line = Window.partitionBy("feed", "field").orderBy("file_no", "given").rowsBetween(Window.unboundedPreceding, 0)
    both = there.withColumn("given", F.lit(1)).withColumn("event", F.lit(None).cast("int"))
    both = both.unionByName(events.select("feed", "file_no", "field", F.lit(0).alias("given"), F.col("file_no").alias("event")), allowMissingColumns=True)
    rows = both.withColumn("since", F.last("event", ignorenulls=True).over(line)).where("given = 1").drop("given", "event")
    before = files.where("before is not null").select("feed", "file_no", "before")
    was = rows.select("feed", F.col("file_no").alias("before"), F.col("field").alias("old"), F.col("since").alias("to_since"))
    links = renamed.join(before, ["feed", "file_no"]).join(was, ["feed", "before", "old"])
    links = checkpoint(links.select("feed", F.col("new").alias("field"), F.col("file_no").alias("since"), F.col("old").alias("to"), "to_since"))
    while True:
        r = links.select(F.col("feed").alias("f"), F.col("field").alias("g"), F.col("since").alias("s"), F.col("to").alias("further"), F.col("to_since").alias("further_since"))
        met = (F.col("feed") == F.col("f")) & (F.col("to") == F.col("g")) & F.col("to_since").eqNullSafe(F.col("s"))
        joined = checkpoint(links.join(r, met, "left"))
        links = joined.select("feed", "field", "since", F.coalesce("further", "to").alias("to"), F.when(F.col("g").isNotNull(), F.col("further_since")).otherwise(F.col("to_since")).alias("to_since"))
        if joined.where("g is not null").isEmpty():
            break
    ends = links.select("feed", "field", "since", F.col("to").alias("root"), F.col("to_since").alias("root_since"))
    placed = rows.join(ends, ["feed", "field", "since"], "left")
    return placed.select(*there.columns, F.when(F.col("root").isNull(), F.col("since")).otherwise(F.col("root_since")).alias("since"), F.coalesce("root", "field").alias("root"))


def _carry(chained: DataFrame) -> DataFrame:
    """feed, file_no, field, kind: the kind of fields of nulls only is that of their earlier files, across any number of renames."""
    line = Window.partitionBy("feed", "root", "since").orderBy("file_no").rowsBetween(Window.unboundedPreceding, 0)
    return chained.select("feed", "file_no", "field", F.last("kind", ignorenulls=True).over(line).alias("kind"))


def field_links(records: DataFrame) -> DataFrame:
    """feed, file_no, links: for each file with any, which column its fields belong to that only their chain of renames tells (field -> column).

    A field whose own name is a column's, now or formerly, needs no link. Of a chain with several columns' names the
    first counts. Links are by file, so a name that is used again for something else later is not mapped.
    """
    from ..session import checkpoint

    records = records.select("feed", "file_no", "record_json").where("feed is not null and file_no is not null")
    files = checkpoint(records.select("feed", "file_no").distinct().withColumn("before", F.lag("file_no").over(Window.partitionBy("feed").orderBy("file_no"))))
    profile = checkpoint(profiles(records))
    renamed = checkpoint(renames(profile, files))
    chained = checkpoint(chains(profile.select("feed", "file_no", "field"), files, renamed)).withColumn("to", _canonical(F.col("field")))
    first = chained.where("to is not null").groupBy("feed", "root", "since").agg(F.min_by("to", F.struct("file_no", "field")).alias("of"))
    same = (F.col("a.feed") == F.col("b.feed")) & (F.col("a.root") == F.col("b.root")) & F.col("a.since").eqNullSafe(F.col("b.since"))
    need = chained.where("to is null").alias("a").join(first.alias("b"), same).select("a.feed", "a.file_no", "a.field", "b.of")
    return need.groupBy("feed", "file_no").agg(F.map_from_entries(F.collect_list(F.struct("field", "of"))).alias("links"))


def unreadable(records: DataFrame) -> DataFrame:
    """feed, file_no, unreadable: how many records of each file are null, not JSON or no JSON object; files without any have no row."""
    bad = F.from_json("record_json", "map<string,string>").isNull()
    return records.groupBy("feed", "file_no").agg(F.count_if(bad).alias("unreadable")).where("unreadable > 0")


def plain_name(c):
    """A field name without case, underscores and other signs, and a leading is."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]", ""), r"^is(?=[a-z]{4})", "")


def _canonical(c):
    table = {n.replace("_", ""): n for n in NAMES} | {a: n for n, others in NAMES.items() for a in others}
    table |= {"maincontent": "main_content", "boilerplatecontent": "boilerplate_content"}
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[plain_name(c)]


def _flag(c):
    v = F.lower(F.trim(c))
    return F.when(v.isin("true", "yes", "1", "t", "y"), True).when(v.isin("false", "no", "0", "f", "n"), False)


def _score(c):
    """A confidence as 0..1000: fractions up to 1 are scaled."""
    v = F.expr(f"try_cast({c} as double)") if isinstance(c, str) else c.try_cast("double")
    return F.when((v >= 0) & (v <= 1) & c.contains("."), F.round(v * 1000)).when((v >= 0) & (v <= 1000), F.round(v)).cast("int")


def _date(c):
    """A date text; eight digits become YYYY-MM-DD."""
    return F.when(c.rlike(r"^\d{8}$"), F.regexp_replace(c, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")).otherwise(c)


def unify_records(records: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """raw_records as rows of the current layout, with origin (the feed), file_no and line_no; every record gives one row.

    A field goes to the column whose name (or former name) it has; a field that was renamed from such a field, over any
    number of files, goes there too (links: field_links(records)). Of several fields of one record that belong to one
    column, the column's own name comes first, then the first by name, fields with a value before nulls; the others and
    what fits no column are kept in meta under their own names. Values of another type are cast, those that cannot be
    are null. content_sha256 is computed from the text. A record that is null, not JSON or no JSON object gives a row of
    nulls with the record itself in meta (see unreadable).
    """
    rows = records.select("feed", "file_no", "line_no", "record_json", F.from_json("record_json", "map<string,string>").alias("m"))
    target = _canonical
    if links is not None:
        rows = rows.join(links, ["feed", "file_no"], "left")
        target = lambda k: F.coalesce(_canonical(k), F.col("links")[k])
    entry = lambda x: F.struct(target(x["key"]).alias("to"), x["value"].isNull().alias("empty"), (x["key"] != target(x["key"])).alias("other"), x["key"].alias("field"), x["value"].alias("value"))
    rows = rows.withColumn("e", F.array_sort(F.transform(F.map_entries("m"), entry)))
    rows = rows.withColumn("e", F.transform("e", lambda x, i: F.struct(F.when((i > 0) & (F.get("e", i - 1)["to"] == x["to"]), None).otherwise(x["to"]).alias("to"), x["field"].alias("field"), x["value"].alias("value"))))
    rest = F.map_from_entries(F.transform(F.filter("e", lambda x: x["to"].isNull()), lambda x: F.struct(x["field"], x["value"])))
    first = lambda n: F.get(F.filter("e", lambda x: x["to"] == n), F.lit(0))["value"]
    wide = rows.select("feed", "file_no", "line_no", "record_json", F.col("m").isNull().alias("_bad"), *[first(n).alias(n) for n in NAMES], rest.alias("_rest"))
    c = {n: F.col(n) for n in NAMES}
    rest = F.when(F.size("_rest") > 0, F.to_json("_rest"))
    meta = F.when(rest.isNull(), c["meta"]).when(c["meta"].isNull(), rest).otherwise(F.concat(F.lit('{"meta":'), F.when(F.try_parse_json("meta").isNotNull(), c["meta"]).otherwise(F.to_json(F.struct("meta"))), F.lit(',"other":'), rest, F.lit("}")))
    meta = F.when(F.col("_bad"), F.col("record_json")).otherwise(meta)
    return wide.select(
        F.col("feed").alias("origin"), F.col("file_no"), F.col("line_no"),
        F.when(c["text"].isNotNull(), F.unhex(F.sha2("text", 256))).alias("content_sha256"), "text", "source", "source_name", "license", "license_raw", "language",
        _score(c["language_score"]).alias("language_score"), _date(c["date"]).alias("date"), c["token_count"].try_cast("long").alias("token_count"), meta.alias("meta"),
        *[_flag(c[n]).alias(n) for n in ("email_addresses", "repetitive_content", "boilerplate_content")],
        F.coalesce(_flag(c["main_content"]), F.lit(True)).alias("main_content"),
        *[c[n].try_cast("long").alias(n) for n in list(NAMES)[15:]],
    )


def unify_layout(df: DataFrame, origin: str) -> DataFrame:
    """Rows of any of the five shard layouts as rows of the current one; origin names the table.

    Legacy empty strings and zero scores and counts are absences. Older layouts have null flags and counters, and
    main_content true. A digest in hexadecimal of either case becomes bytes.
    """
    none = F.lit(None).cast("int")
    return df.select(F.lit(origin).alias("origin"), none.alias("file_no"), none.alias("line_no"), *layout_columns(df).values())


def layout_columns(df: DataFrame) -> dict:
    """The columns of the current layout by name, as expressions over df of any layout."""
    have = {c.lower(): c for c in df.columns}
    legacy = {"content_sha256": "sha256", "language": "lang", "language_score": "lang_score", "token_count": "tokens"}
    is_legacy = "sha256" in have and "content_sha256" not in have
    out = {}
    for n, kind in zip(NAMES, ["binary"] + ["string"] * 6 + ["int", "string", "bigint", "string"] + ["boolean"] * 4 + ["bigint"] * 5):
        name = have.get(n) or have.get(legacy.get(n, ""))
        if name is None:
            col = F.lit(None).cast(kind)
        elif is_legacy and n == "content_sha256":
            col = F.unhex(F.col(name))
        elif is_legacy:
            col = F.col(name).cast(kind)
            col = F.when((col != "") if kind == "string" else (col != 0), col)
        else:
            col = F.col(name).cast(kind)
        if n == "main_content":
            col = F.coalesce(col, F.lit(True))
        out[n] = col.alias(n)
    return out


def layout_changes(layouts: list[tuple[str, DataFrame]]) -> list[tuple[str, str, str, str]]:
    """(from, to, field, change) between consecutive layouts, from their schemas and former names."""
    out = []
    plain = {a: n for n, others in NAMES.items() for a in others}
    canon = lambda c: plain.get(c.replace("_", ""), c)
    for (a, x), (b, y) in zip(layouts, layouts[1:]):
        old, new = ({canon(c): (c, t) for c, t in df.dtypes} for df in (x, y))
        for f in sorted(set(old) | set(new)):
            if f not in new:
                out.append((a, b, old[f][0], "removed"))
            elif f not in old:
                out.append((a, b, new[f][0], "added"))
            else:
                if old[f][0] != new[f][0]:
                    out.append((a, b, new[f][0], "renamed"))
                if old[f][1] != new[f][1]:
                    out.append((a, b, new[f][0], "retyped"))
    return out
