"""Named queries over the tables of a folder with the SQL that gives the same rows. Every query reads its whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import policy
from ..functions import text as T
from ..operators import catalog, dedup, training
from ..session import table

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


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "text_rows")


SQL_EMAIL = T.EMAIL.replace("'", "''")

# Digests and counts


@query("SELECT row_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS octets FROM text_rows")
def content_hash(spark, sf):
    """Digest and bytes of every text."""
    return _rows(spark, sf).select("row_id", T.text_hash(F.col("text")).alias("sha256"), F.octet_length("text").cast("bigint").alias("octets"))


@query("""SELECT row_id, n FROM (SELECT row_id, 0 AS n, lower(hex(content_sha256)) AS h, text FROM text_rows UNION ALL SELECT row_id, 1, CASE WHEN row_id % 7 = 0 THEN sha256(source) WHEN row_id % 7 = 1 THEN NULL ELSE lower(hex(content_sha256)) END, text FROM text_rows)
 WHERE h IS DISTINCT FROM sha256(text)""")
def wrong_hashes(spark, sf):
    """Rows whose digest is not that of their text: of the table (n 0), and of a copy of it with some digests wrong or missing (n 1)."""
    h = F.lower(F.hex("content_sha256"))
    k = F.col("row_id") % 7
    r = _rows(spark, sf)
    both = r.select("row_id", F.lit(0).alias("n"), h.alias("h"), "text").unionByName(r.select("row_id", F.lit(1).alias("n"), F.when(k == 0, F.sha2("source", 256)).when(k == 1, None).otherwise(h).alias("h"), "text"))
    return both.where(~F.col("h").eqNullSafe(T.text_hash(F.col("text")))).select("row_id", "n")


@query("""SELECT source, count(*) AS records, CAST(sum(strlen(text)) AS BIGINT) AS octets, CAST(sum(coalesce(token_count, 0)) AS BIGINT) AS tokens,
 CAST(count(DISTINCT content_sha256) AS BIGINT) AS texts FROM text_rows GROUP BY source""")
def source_rollup(spark, sf):
    """Records, bytes, tokens and distinct texts by source."""
    return _rows(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum(F.octet_length("text")).cast("bigint").alias("octets"), F.sum(F.coalesce("token_count", F.lit(0))).cast("bigint").alias("tokens"), F.countDistinct("content_sha256").alias("texts"))


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) + 1 AS byte_tokens FROM documents WHERE text IS NOT NULL")
def byte_token_counts(spark, sf):
    """Byte tokens of every document, end token included."""
    return table(spark, sf, "documents").where("text is not null").select("doc_id", (F.octet_length("text").cast("bigint") + 1).alias("byte_tokens"))


# Deduplication


@query("SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY content_sha256 ORDER BY received_at, row_id) AS n FROM text_rows) WHERE n = 1")
def exact_dedup_keep_first(spark, sf):
    """The first delivery of every text."""
    return dedup.keep_first(_rows(spark, sf).select("row_id", "content_sha256", "received_at"), ["content_sha256"], ["received_at", "row_id"]).select("row_id")


@query("SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY content_sha256, license ORDER BY row_id) AS n FROM text_rows) WHERE n = 1")
def exact_dedup_by_license(spark, sf):
    """The first row of every text and licence: the same text under two licences stays twice."""
    return dedup.keep_first(_rows(spark, sf).select("row_id", "content_sha256", "license"), ["content_sha256", "license"], ["row_id"]).select("row_id")


@query("""SELECT count(*) AS input, CAST(count(DISTINCT (content_sha256, coalesce(license, ''))) AS BIGINT) AS kept,
 count(*) - CAST(count(DISTINCT (content_sha256, coalesce(license, ''))) AS BIGINT) AS duplicates FROM text_rows""")
def dedup_counters(spark, sf):
    """Rows in, kept and dropped."""
    kept = F.countDistinct("content_sha256", F.coalesce("license", F.lit("")))
    return _rows(spark, sf).agg(F.count(F.lit(1)).alias("input"), kept.alias("kept"), (F.count(F.lit(1)) - kept).alias("duplicates"))


@query("""WITH seen AS (SELECT lower(hex(content_sha256)) || ' ' || coalesce(license, '') AS k FROM shard_v1 UNION SELECT lower(hex(content_sha256)) || ' ' || coalesce(license, '') FROM shard_v2 UNION SELECT lower(sha256) || ' ' || coalesce(license, '') FROM shard_legacy),
r AS (SELECT row_id, lower(hex(content_sha256)) || ' ' || coalesce(license, '') AS k FROM text_rows)
SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY k ORDER BY row_id) AS n FROM r WHERE k NOT IN (SELECT k FROM seen)) WHERE n = 1""")
def seeded_dedup(spark, sf):
    """Texts of text_rows that no older shard has under the same licence, each once by text and licence."""
    key = lambda h: [F.lower(h).alias("h"), F.coalesce("license", F.lit("")).alias("license")]
    hexed = lambda t: table(spark, sf, t).select(*key(F.hex("content_sha256")))
    seen = hexed("shard_v1").union(hexed("shard_v2")).union(table(spark, sf, "shard_legacy").select(*key(F.col("sha256"))))
    new = dedup.not_present(_rows(spark, sf).select("row_id", *key(F.hex("content_sha256"))), seen, ["h", "license"])
    return dedup.keep_first(new, ["h", "license"], ["row_id"]).select("row_id")


@query("SELECT lower(hex(content_sha256)) AS sha256, count(*) AS records FROM text_rows GROUP BY content_sha256 HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    """Digests that occur more than once, across all shards and licences."""
    return dedup.duplicate_keys(_rows(spark, sf).select(F.lower(F.hex("content_sha256")).alias("sha256")), ["sha256"])


# Text functions


@query(f"SELECT row_id, regexp_matches(text, '{SQL_EMAIL}') AS email FROM text_rows")
def email_flag(spark, sf):
    """Whether a mail address occurs."""
    return _rows(spark, sf).select("row_id", T.has_email(F.col("text")).alias("email"))


@query(f"""SELECT row_id, sha256(regexp_replace(text, '{SQL_EMAIL}', '<EMAIL_ADDRESS>', 'g')) AS redacted,
 CAST(len(regexp_extract_all(text, '{SQL_EMAIL}')) AS BIGINT) AS emails FROM text_rows""")
def email_redact(spark, sf):
    """Texts with mail addresses replaced (as digests), and how many."""
    t = F.col("text")
    return _rows(spark, sf).select("row_id", F.sha2(T.redact(t, T.EMAIL, "<EMAIL_ADDRESS>"), 256).alias("redacted"), F.regexp_count(t, F.lit(T.EMAIL)).cast("bigint").alias("emails"))


_SECRET = "text || ' api_key=' || sha256(text) || chr(10) || '-----BEGIN RSA PRIVATE KEY-----' || chr(10) || sha256(source) || chr(10) || '-----END RSA PRIVATE KEY-----'"
SQL_CREDENTIAL, SQL_KEY = T.CREDENTIAL.replace("'", "''"), T.PRIVATE_KEY


@query(f"SELECT row_id, sha256(regexp_replace(regexp_replace({_SECRET}, '{SQL_KEY}', '<CREDENTIAL>', 'g'), '{SQL_CREDENTIAL}', '<CREDENTIAL>', 'g')) AS redacted FROM text_rows")
def credential_redact(spark, sf):
    """Texts to which a key and a private key were added, with both replaced (as digests)."""
    t = F.concat("text", F.lit(" api_key="), F.sha2("text", 256), F.lit("\n-----BEGIN RSA PRIVATE KEY-----\n"), F.sha2("source", 256), F.lit("\n-----END RSA PRIVATE KEY-----"))
    return _rows(spark, sf).select("row_id", F.sha2(T.redact(T.redact(t, T.PRIVATE_KEY, "<CREDENTIAL>"), T.CREDENTIAL, "<CREDENTIAL>"), 256).alias("redacted"))


SQL_PHONE = T.PHONE
_DIGITS = "length(regexp_replace(m, '[^0-9]', '', 'g'))"
_LIKELY = f"({_DIGITS} <= 15 AND ({_DIGITS} >= 10 OR ({_DIGITS} >= 7 AND (m LIKE '+%' OR contains(m, '(') OR contains(m, ')')))))"


@query(f"""WITH s AS (SELECT row_id, regexp_split_to_array(text, '{SQL_PHONE}') AS b, regexp_extract_all(text, '{SQL_PHONE}') AS h FROM text_rows)
SELECT row_id, CAST(len([m FOR m IN h IF {_LIKELY}]) AS BIGINT) AS phones,
 sha256(array_to_string([b[i] || coalesce(CASE WHEN {_LIKELY.replace("(m,", "(h[i],").replace("(m LIKE", "(h[i] LIKE").replace("contains(m", "contains(h[i]")} THEN '<PHONE_NUMBER>' ELSE h[i] END, '') FOR i IN range(1, len(b) + 1)], '')) AS redacted FROM s""")
def phone_redact(spark, sf):
    """Texts with likely telephone numbers replaced (as digests), and how many: one pass inside the JVM."""
    r = T.redact_if(F.col("text"), T.PHONE, "<PHONE_NUMBER>", T.likely_phone)
    return _rows(spark, sf).select("row_id", r.alias("r")).select("row_id", F.col("r.n").alias("phones"), F.sha2("r.text", 256).alias("redacted"))


_QUAD = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


@query(f"""SELECT row_id, CAST(len([m FOR m IN regexp_extract_all(text, '{T.IP}') IF regexp_full_match(regexp_replace(m, '^[\\[\\].,;()]+|[\\[\\].,;()]+$', '', 'g'), '({_QUAD}\\.){{3}}{_QUAD}')]) AS BIGINT) AS ips FROM text_rows""")
def ip_counts(spark, sf):
    """Valid dotted addresses in every text."""
    return _rows(spark, sf).select("row_id", T.redact_if(F.col("text"), T.IP, "<IP_ADDRESS>", T.valid_ipv4)["n"].alias("ips"))


_W = r"[\t\n\x0B\f\r \x{85}\p{Z}]"
_LINES = f"[y FOR y IN [trim(regexp_replace(x, '{_W}+', ' ', 'g')) FOR x IN string_split(text, chr(10))] IF y <> '']"


@query(f"""WITH e AS (SELECT row_id, text, {_LINES} AS e FROM text_rows)
SELECT row_id, len(e) >= 4 AND ((len(e) - len(list_distinct(e))) / len(e) > 0.30
 OR (list_sum([strlen(x) FOR x IN e]) - list_sum([strlen(x) FOR x IN list_distinct(e)])) / strlen(text) > 0.20) AS boilerplate FROM e""")
def boilerplate_lines(spark, sf):
    """The boilerplate flag by lines."""
    return _rows(spark, sf).select("row_id", T.is_boilerplate(F.col("text")).alias("boilerplate"))


_WORDS = r"[x FOR x IN regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') IF x <> '']"


@query(f"SELECT row_id, CAST(len({_WORDS}) AS BIGINT) AS words FROM text_rows")
def word_counts(spark, sf):
    """Words of every text."""
    return _rows(spark, sf).select("row_id", F.size(T.words(F.col("text"))).cast("bigint").alias("words"))


@query(f"""WITH w AS (SELECT row_id, {_WORDS} AS w FROM text_rows),
g AS (SELECT row_id, len(w) AS n, unnest([w[i] || ' ' || w[i+1] || ' ' || w[i+2] FOR i IN range(1, len(w) - 1)]) AS g FROM w WHERE len(w) >= 3),
c AS (SELECT row_id, n, g, count(*) AS k FROM g GROUP BY row_id, n, g), t AS (SELECT row_id, CAST(max(k) AS BIGINT) AS top, n >= 50 AND max(k) * 3 / n > 0.18 AS repetitive FROM c GROUP BY row_id, n)
SELECT row_id, coalesce(top, 0) AS top, coalesce(repetitive, false) AS repetitive FROM text_rows LEFT JOIN t USING (row_id)""")
def repetition_trigram(spark, sf):
    """The most frequent triple of words (0 without any), and the flag it gives: counted inside each row, without a shuffle."""
    w = _rows(spark, sf).select("row_id", F.coalesce(T.words(F.col("text")), F.array().cast("array<string>")).alias("w"))
    hashed = F.transform(F.when(F.size("w") >= 3, F.sequence(F.lit(0), F.size("w") - 3)).otherwise(F.array().cast("array<int>")), lambda i: F.xxhash64(F.col("w")[i], F.col("w")[i + 1], F.col("w")[i + 2]))
    g = w.select("row_id", F.size("w").alias("n"), F.array_sort(hashed).alias("g"))
    # in sorted triples, the longest run of equals
    run = F.aggregate("g", F.struct(F.lit(0).cast("bigint").alias("last"), F.lit(0).alias("k"), F.lit(0).alias("top")), lambda s, x: F.struct(x.alias("last"), F.when(x == s["last"], s["k"] + 1).otherwise(1).alias("k"), F.greatest(s["top"], F.when(x == s["last"], s["k"] + 1).otherwise(1)).alias("top")))["top"]
    g = g.select("row_id", "n", run.cast("bigint").alias("top"))
    return g.select("row_id", "top", ((F.col("n") >= T.LEAST_WORDS) & (F.col("top") * 3 / F.col("n") > T.TOP_TRIGRAM)).alias("repetitive"))


def _license_sql(v: str) -> str:
    """The SQL of one raw licence."""
    names = " ".join(f"WHEN '{k}' THEN '{i}'" for k, i in T.LICENSES.items())
    short = f"regexp_replace(upper(regexp_extract({v}, '(?i)^CC[ _-]*(BY(?:[ _-]*(?:NC|ND|SA)){{0,2}}|ZERO|0)[ _-]*([0-9]+(?:\\.[0-9]+)?)$', 1)), '[ _]', '-', 'g')"
    number = f"regexp_extract({v}, '([0-9]+(?:\\.[0-9]+)?)$', 1)"
    return f"coalesce(CASE lower({v}) {names} END, CASE WHEN {short} IN ('ZERO', '0') THEN 'CC0-' || {number} WHEN {short} <> '' THEN 'CC-' || {short} || '-' || {number} ELSE {v} END)"


_RAW = "SELECT 'text_rows' AS part, CAST(row_id AS VARCHAR) AS id, license_raw FROM text_rows" + "".join(f" UNION ALL SELECT '{t}', lower({h}), license_raw FROM {t}" for t, h in (("shard_v1", "hex(content_sha256)"), ("shard_v2", "hex(content_sha256)"), ("shard_v3", "hex(content_sha256)"), ("shard_legacy", "sha256")))


@query(f"""WITH r AS ({_RAW}), t AS (SELECT *, CASE WHEN trim(license_raw) LIKE '[%' AND json_valid(license_raw) THEN CAST(json_extract_string(license_raw, '$[*]') AS VARCHAR[]) END AS terms FROM r)
SELECT part, id, license_raw, CASE WHEN terms IS NOT NULL THEN array_to_string(list_sort(list_distinct([{_license_sql("trim(x)")} FOR x IN terms IF trim(x) <> ''])), ' AND ') ELSE {_license_sql("trim(license_raw)")} END AS license FROM t""")
def license_normalize(spark, sf):
    """The raw licences of all rows and shard tables (by row id or digest) as identifiers; the terms of a JSON list as one conjunction."""
    parts = [_rows(spark, sf).select(F.lit("text_rows").alias("part"), F.col("row_id").cast("string").alias("id"), "license_raw")]
    for name, digest in (("shard_v1", F.lower(F.hex("content_sha256"))), ("shard_v2", F.lower(F.hex("content_sha256"))), ("shard_v3", F.lower(F.hex("content_sha256"))), ("shard_legacy", F.lower("sha256"))):
        parts.append(table(spark, sf, name).select(F.lit(name).alias("part"), digest.alias("id"), "license_raw"))
    return reduce(DataFrame.unionByName, parts).select("part", "id", "license_raw", T.normalize_raw_license(F.col("license_raw")).alias("license"))


@query("SELECT row_id, CASE WHEN license IS NULL THEN 'MIT' WHEN license < 'MIT' THEN license || ' AND MIT' WHEN license = 'MIT' THEN 'MIT' ELSE 'MIT AND ' || license END AS licenses FROM text_rows")
def license_set(spark, sf):
    """Several licences of one row as one conjunction."""
    return _rows(spark, sf).select("row_id", T.license_set(F.array(F.col("license"), F.lit("MIT License"), F.lit(" "), F.col("license"))).alias("licenses"))


# Filters


@query("SELECT row_id FROM text_rows WHERE coalesce(license, '') NOT LIKE '%-NC-%' AND coalesce(license, '') NOT LIKE '%/%' AND (license LIKE 'CC-%' OR license = 'MIT' OR coalesce(license, '') = '')")
def license_policy(spark, sf):
    """Rows that a licence policy allows; a missing licence is the empty one, which this policy allows."""
    p = policy.Values(["CC-*", "MIT", ""], ["*-NC-*"])
    return _rows(spark, sf).where(p.allows(F.col("license"))).select("row_id")


@query("""WITH s AS (SELECT shard_id, bool_and(coalesce(license, '') LIKE 'CC%') AS ok FROM text_rows GROUP BY shard_id)
SELECT c.corpus, count(*) AS shards, CAST(sum(CASE WHEN s.ok THEN 1 ELSE 0 END) AS BIGINT) AS selected FROM shards c LEFT JOIN s USING (shard_id) GROUP BY c.corpus""")
def shard_license_policy(spark, sf):
    """Shards by corpus whose licences are all allowed; a corpus stays even if it has none."""
    ok = _rows(spark, sf).groupBy("shard_id").agg(F.bool_and(policy.any_match(F.col("license"), ["CC*"])).alias("ok"))
    return table(spark, sf, "shards").join(ok, "shard_id", "left").groupBy("corpus").agg(F.count(F.lit(1)).alias("shards"), F.sum(F.when(F.col("ok"), 1).otherwise(0)).cast("bigint").alias("selected"))


_DAY = "CASE WHEN regexp_full_match(date, '\\d{4}') THEN date || '-01-01' WHEN regexp_full_match(date, '\\d{4}-\\d{2}') THEN date || '-01' WHEN regexp_full_match(date, '\\d{4}-\\d{2}-\\d{2}') THEN date END"
_INSTANT = r"regexp_full_match(date, '\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})')"
_BOUNDS = f"""b AS (SELECT *, CASE WHEN {_INSTANT} THEN try_cast(upper(date) AS TIMESTAMPTZ) AT TIME ZONE 'UTC' ELSE try_cast({_DAY} AS TIMESTAMP) END AS d0 FROM text_rows),
d AS (SELECT *, CASE length(date) WHEN 4 THEN d0 + INTERVAL 1 YEAR WHEN 7 THEN d0 + INTERVAL 1 MONTH WHEN 10 THEN d0 + INTERVAL 1 DAY ELSE d0 + INTERVAL 1 MICROSECOND END AS d1 FROM b)"""


@query(f"WITH {_BOUNDS} SELECT row_id FROM d WHERE d1 > TIMESTAMP '2005-03-01' AND d0 < TIMESTAMP '2012-07-01'")
def date_overlap(spark, sf):
    """Rows whose date's interval overlaps March 2005 to June 2012."""
    return _rows(spark, sf).where(policy.date_overlaps(F.col("date"), "2005-03", "2012-06")).select("row_id")


@query(f"""WITH {_BOUNDS} SELECT row_id FROM d WHERE main_content AND NOT (boilerplate_content = true) AND coalesce(license, '') NOT LIKE 'GPL%'
 AND (regexp_full_match(coalesce(language, ''), 'en') OR regexp_full_match(coalesce(language, ''), 'de[^/]*')) AND NOT regexp_full_match(source, 'books/[^/]*') AND NOT coalesce(regexp_full_match(source_name, 'books/[^/]*'), false)
 AND d1 > TIMESTAMP '2003-01-01'""")
def record_filter_full(spark, sf):
    """A record filter of every kind of condition."""
    f = policy.RecordFilter(languages=policy.Values(["en", "de*"]), sources=policy.Values(exclude=["books/*"]), date_from="2003", boilerplate=True, exclude_licenses=["GPL*"])
    return _rows(spark, sf).where(f.predicate()).select("row_id")


@query("SELECT content_sha256 IS NOT NULL AS ok, count(*) AS records FROM shard_v2 WHERE NOT coalesce(repetitive_content = true, false) GROUP BY 1")
def exclusion_nulls(spark, sf):
    """Rows of an older layout that an exclusion keeps: a null flag never excludes."""
    return table(spark, sf, "shard_v2").where(~F.coalesce(F.col("repetitive_content") == F.lit(True), F.lit(False))).groupBy(F.col("content_sha256").isNotNull().alias("ok")).agg(F.count(F.lit(1)).alias("records"))


@query("""SELECT kind, count(*) AS records FROM (SELECT CASE WHEN email_addresses IS NULL THEN 'unassessed' ELSE 'assessed' END AS kind FROM shard_v2
 UNION ALL SELECT 'unassessed' FROM shard_v1 UNION ALL SELECT 'unassessed' FROM shard_legacy UNION ALL SELECT CASE WHEN email_addresses IS NULL THEN 'unassessed' ELSE 'assessed' END FROM shard_v3) GROUP BY kind""")
def unassessed_records(spark, sf):
    """Rows for which an exclusion cannot be applied."""
    from ..operators.drift import unify_layout
    from functools import reduce

    all_ = reduce(DataFrame.unionByName, [unify_layout(table(spark, sf, t), t) for t in ("shard_v2", "shard_v1", "shard_legacy", "shard_v3")])
    return all_.groupBy(F.when(F.col("email_addresses").isNull(), "unassessed").otherwise("assessed").alias("kind")).agg(F.count(F.lit(1)).alias("records"))


# Records and layouts


@query("SELECT origin, count(*) AS records, count(language) AS languages, CAST(sum(coalesce(token_count, 0)) AS BIGINT) AS tokens, CAST(sum(CAST(main_content AS INTEGER)) AS BIGINT) AS main FROM ("
       "SELECT 'shard_legacy' AS origin, nullif(lang, '') AS language, nullif(tokens, 0) AS token_count, true AS main_content FROM shard_legacy UNION ALL SELECT 'shard_v1', language, token_count, true FROM shard_v1"
       " UNION ALL SELECT 'shard_v2', language, token_count, true FROM shard_v2 UNION ALL SELECT 'shard_v3', language, token_count, coalesce(main_content, true) FROM shard_v3) GROUP BY origin")
def layouts_unified(spark, sf):
    """The older layouts read as one."""
    from ..operators.drift import unify_layout
    from functools import reduce

    all_ = reduce(DataFrame.unionByName, [unify_layout(table(spark, sf, t), t) for t in ("shard_legacy", "shard_v1", "shard_v2", "shard_v3")])
    return all_.groupBy("origin").agg(F.count(F.lit(1)).alias("records"), F.count("language").alias("languages"), F.sum(F.coalesce("token_count", F.lit(0))).cast("bigint").alias("tokens"), F.sum(F.col("main_content").cast("int")).cast("bigint").alias("main"))


@query("SELECT doc_id, coalesce(nullif(trim(text), ''), source) AS body FROM documents")
def text_fallback(spark, sf):
    """Documents' text, or their source where there is none."""
    return table(spark, sf, "documents").select("doc_id", F.coalesce(F.expr("nullif(trim(text), '')"), "source").alias("body"))


@query("SELECT row_id, CASE WHEN json_valid(meta) THEN json_extract_string(meta, '$.url') END AS url, CASE WHEN json_valid(meta) THEN json_extract_string(meta, '$.dataset_id') END AS dataset_id FROM text_rows")
def meta_json_paths(spark, sf):
    """Fields of meta; null where it is missing or cannot be read."""
    ok = F.try_parse_json("meta").isNotNull()
    return _rows(spark, sf).select("row_id", *[F.when(ok, F.get_json_object("meta", f"$.{k}")).alias(k) for k in ("url", "dataset_id")])


def _json_sql(c: str) -> str:
    """The SQL of a text as a JSON string."""
    for char, short in ((92, "\\\\"), (34, '\\"'), (8, "\\b"), (9, "\\t"), (10, "\\n"), (12, "\\f"), (13, "\\r")):
        c = f"replace({c}, chr({char}), '{short}')"
    for code in (*range(1, 8), 11, *range(14, 32)):
        c = f"replace({c}, chr({code}), '\\u{code:04x}')"
    return f"""'"' || {c} || '"'"""


def _key_sql(key: str, column: str, value: str | None = None, absent: str = "''") -> str:
    """The SQL of an optional key with a leading comma."""
    return f"""CASE WHEN {column} <> {absent} THEN ',"{key}":' || {value or _json_sql(column)} ELSE '' END"""


_OPTIONAL = " || ".join(f"coalesce({x}, '')" for x in (
    _key_sql("source_name", "source_name"), _key_sql("license", "license"), _key_sql("license_raw", "license_raw"), _key_sql("lang", "language"), _key_sql("lang_score", "language_score", "language_score", "0"), _key_sql("date", "date"),
    _key_sql("tokens", "token_count", "token_count", "0"), _key_sql("meta", "meta", "meta"),
))


@query(f"""SELECT row_id, sha256('{{"sha256":"' || sha256(text) || '","kind":"pretrain","text":' || {_json_sql("text")} || ',"source":' || {_json_sql("source")} || {_OPTIONAL} || '}}') AS line FROM text_rows""")
def canonical_jsonl(spark, sf):
    """Canonical JSON lines of all rows (as digests) with all their columns, whatever characters they have."""
    names = {"lang": "language", "lang_score": "language_score", "tokens": "token_count"}
    c = {k: F.col(names.get(k, k)) for k in ("text", "source", "source_name", "license", "license_raw", "lang", "lang_score", "date", "tokens", "meta")}
    return _rows(spark, sf).select("row_id", F.sha2(T.canonical_json({"sha256": T.text_hash(F.col("text"))} | c), 256).alias("line"))


# Conversations, from documents in pairs: the source asks, the text answers

_ASK = "SELECT doc_id, source AS q, text AS a FROM documents WHERE trim(text) <> ''"


@query(f"SELECT doc_id, sha256('User: ' || q || chr(10) || chr(10) || 'Assistant:' || a) AS prompt, CAST(strlen(a) AS BIGINT) + 1 AS targets FROM ({_ASK})")
def render_user_assistant(spark, sf):
    """Dialogues rendered with plain markers (as digests), and their supervised bytes with the end token."""
    d = _dialogues(spark, sf)
    return d.select("doc_id", F.sha2(T.render(F.col("messages"), "user-assistant-v1"), 256).alias("prompt"), _targets(0).alias("targets"))


@query(f"SELECT doc_id, sha256('<|im_start|>user' || chr(10) || q || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || a || '<|im_end|>' || chr(10)) AS prompt, CAST(strlen(a) AS BIGINT) + 12 AS targets FROM ({_ASK})")
def render_chatml(spark, sf):
    """Dialogues rendered with chat markers (as digests), and their supervised bytes: content, end marker, end token."""
    d = _dialogues(spark, sf)
    return d.select("doc_id", F.sha2(T.render(F.col("messages"), "chatml-v1"), 256).alias("prompt"), _targets(len("<|im_end|>\n")).alias("targets"))


def _dialogues(spark, sf):
    one = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"), F.lit(None).cast("string").alias("context"))
    return table(spark, sf, "documents").where(F.trim("text") != "").select("doc_id", F.array(one("user", "source"), one("assistant", "text")).alias("messages"))


def _targets(marker: int):
    spoken = F.filter("messages", lambda m: m["role"] == "assistant")
    return F.aggregate(spoken, F.lit(1).cast("bigint"), lambda s, m: s + F.octet_length(m["content"]) + marker)


# Catalogue


@query("""SELECT shard_id, count(*) AS records, CAST(sum(coalesce(token_count, 0)) AS BIGINT) AS tokens, CAST(sum(strlen(text)) AS BIGINT) AS content_bytes,
 CAST(count(*) FILTER (email_addresses) AS BIGINT) AS email_addresses, CAST(count(*) FILTER (repetitive_content) AS BIGINT) AS repetitive_content, CAST(count(*) FILTER (boilerplate_content) AS BIGINT) AS boilerplate_content, CAST(count(*) FILTER (main_content) AS BIGINT) AS main_content,
 CAST(sum(redacted_email_addresses) AS BIGINT) AS redacted_email_addresses, CAST(sum(redacted_ip_addresses) AS BIGINT) AS redacted_ip_addresses, CAST(sum(redacted_phone_numbers) AS BIGINT) AS redacted_phone_numbers,
 CAST(sum(removed_mail_routing_headers) AS BIGINT) AS removed_mail_routing_headers, CAST(sum(redacted_credentials) AS BIGINT) AS redacted_credentials, coalesce(string_agg(DISTINCT license, ',' ORDER BY license), '') AS licenses FROM text_rows GROUP BY shard_id""")
def shard_summary(spark, sf):
    """The summary of every shard."""
    return catalog.shard_summary(_rows(spark, sf))


@query("SELECT corpus, license, CAST(grouping(corpus, license) AS INTEGER) AS level, count(*) AS shards, CAST(sum(coalesce(docs, 0)) AS BIGINT) AS docs, CAST(sum(coalesce(tokens, 0)) AS BIGINT) AS tokens, CAST(sum(coalesce(bytes, 0)) AS BIGINT) AS bytes FROM shards GROUP BY CUBE (corpus, license)")
def bom_grouping_sets(spark, sf):
    """Totals over all, by corpus, by licence and by both."""
    return catalog.totals(table(spark, sf, "shards"))


@query("""SELECT license, CAST(count(DISTINCT shard_id) AS BIGINT) AS shards, count(*) AS docs, CAST(sum(coalesce(token_count, 0)) AS BIGINT) AS tokens FROM text_rows GROUP BY license""")
def index_summary_by_license(spark, sf):
    """Shards, docs and tokens by licence: a shard with several licences counts once for each."""
    each = _rows(spark, sf).groupBy("license", "shard_id").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.coalesce("token_count", F.lit(0))).alias("tokens"))
    return each.groupBy("license").agg(F.count("shard_id").alias("shards"), F.sum("docs").alias("docs"), F.sum("tokens").cast("bigint").alias("tokens"))


@query("""SELECT corpus, count(*) AS shards, CAST(sum(docs) AS BIGINT) AS docs, CAST(sum(coalesce(tokens, 0)) AS BIGINT) AS tokens, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, max(written_at) AS newest FROM shards GROUP BY corpus""")
def corpus_list(spark, sf):
    """One row per corpus."""
    lic = F.expr("nullif(array_join(array_sort(collect_set(license)), ','), '')")
    return table(spark, sf, "shards").groupBy("corpus").agg(F.count(F.lit(1)).alias("shards"), F.sum("docs").cast("bigint").alias("docs"), F.sum(F.coalesce("tokens", F.lit(0))).cast("bigint").alias("tokens"), lic.alias("licenses"), F.max("written_at").alias("newest"))


@query("""WITH a AS (SELECT shard_id, count(*) AS n, CAST(sum(coalesce(token_count, 0)) AS BIGINT) AS t FROM text_rows GROUP BY shard_id)
SELECT s.shard_id, s.docs AS declared_docs, coalesce(s.tokens, -1) AS declared_tokens, coalesce(n, 0) AS actual_docs, coalesce(t, 0) AS actual_tokens FROM shards s LEFT JOIN a USING (shard_id) WHERE s.docs IS DISTINCT FROM coalesce(n, 0) OR s.tokens IS DISTINCT FROM coalesce(t, 0)""")
def reconcile_totals(spark, sf):
    """Shards whose declared totals are stale or missing (-1)."""
    return catalog.reconcile(table(spark, sf, "shards"), _rows(spark, sf)).withColumn("declared_tokens", F.coalesce("declared_tokens", F.lit(-1)))


@query("""WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region),
t(node, leaf) AS (SELECT child, child FROM e WHERE child LIKE 'c%' UNION ALL SELECT e.parent, t.leaf FROM t JOIN e ON t.node = e.child)
SELECT node, count(*) AS leaves FROM t GROUP BY node""")
def rollup_tree_sum(spark, sf):
    """Leaves below every node of a tree of three levels."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = table(spark, sf, "customer").select(key("c", "c_custkey").alias("child"), key("n", "c_nationkey").alias("parent"))
    e = e.union(table(spark, sf, "nation").select(key("n", "n_nationkey"), key("r", "n_regionkey"))).union(table(spark, sf, "region").select(key("r", "r_regionkey"), F.lit("root")))
    leaves = e.where("child like 'c%'").select(F.col("child").alias("node"), F.lit(1).alias("leaves"))
    return catalog.tree_totals(e, leaves, "leaves")


@query("""SELECT coalesce(a.h, b.h) AS h, CASE WHEN a.h IS NULL THEN 'missing' WHEN b.h IS NULL THEN 'unreferenced' ELSE 'referenced' END AS state, coalesce(b.n, 0) AS "references"
 FROM (SELECT DISTINCT lower(hex(content_sha256)) AS h FROM shard_v3) a FULL JOIN (SELECT lower(hex(content_sha256)) AS h, count(*) AS n FROM text_rows GROUP BY 1) b ON a.h = b.h""")
def inventory_full_outer(spark, sf):
    """Stored and referenced objects."""
    hexed = lambda t: table(spark, sf, t).select(F.lower(F.hex("content_sha256")).alias("h"))
    return catalog.inventory(hexed("shard_v3"), hexed("text_rows"), "h")


@query("SELECT DISTINCT lower(hex(content_sha256)) AS h FROM shard_v1 EXCEPT SELECT lower(hex(content_sha256)) FROM text_rows")
def missing_references(spark, sf):
    """Texts of an older layout that the current one lacks."""
    hexed = lambda t: table(spark, sf, t).select(F.lower(F.hex("content_sha256")).alias("h"))
    return hexed("shard_v1").distinct().join(hexed("text_rows"), "h", "left_anti")


@query("SELECT DISTINCT r.source FROM (SELECT source FROM text_rows UNION ALL SELECT CASE WHEN row_id % 9 = 4 THEN source || '-mirror' ELSE source END FROM text_rows) r LEFT JOIN shards s ON r.source = s.corpus WHERE s.corpus IS NULL")
def unknown_sources(spark, sf):
    """Sources of rows, and of a copy of them with some sources renamed, that no shard declares."""
    r = _rows(spark, sf)
    renamed = F.when(F.col("row_id") % 9 == 4, F.concat("source", F.lit("-mirror"))).otherwise(F.col("source"))
    return r.select("source").union(r.select(renamed)).distinct().join(table(spark, sf, "shards").select(F.col("corpus").alias("source")).distinct(), "source", "left_anti")


@query("""SELECT path, max_by(prefix, length(prefix)) AS prefix FROM (SELECT s.source AS path, p.prefix FROM (SELECT DISTINCT source FROM text_rows) s
 LEFT JOIN (SELECT 'web' AS prefix UNION ALL SELECT 'mail' UNION ALL SELECT DISTINCT corpus FROM shards WHERE corpus LIKE 'books/%') p ON s.source = p.prefix OR starts_with(s.source, p.prefix || '/')) GROUP BY path""")
def source_prefix_join(spark, sf):
    """The longest declared prefix of every source."""
    p = table(spark, sf, "shards").where("corpus like 'books/%'").select(F.col("corpus").alias("prefix")).union(spark.createDataFrame([("web",), ("mail",)], "prefix string"))
    return catalog.longest_prefix(_rows(spark, sf).select(F.col("source").alias("path")).distinct(), p)


@query("""SELECT coalesce(w.k, s.k) AS corpus, coalesce(w.weights, 0) AS weights, s.rows IS NOT NULL AS present FROM (SELECT regexp_replace(lower(trim(corpus)), '\\.(ya?ml|json)$', '') AS k, count(*) AS weights FROM corpus_weights GROUP BY 1) w
 FULL JOIN (SELECT source AS k, count(*) AS rows FROM text_rows GROUP BY source) s ON w.k = s.k""")
def weights_full_outer(spark, sf):
    """Weights and sources matched, both sides whole."""
    k = F.regexp_replace(F.lower(F.trim("corpus")), r"\.(ya?ml|json)$", "")
    w = table(spark, sf, "corpus_weights").groupBy(k.alias("corpus")).agg(F.count(F.lit(1)).alias("weights"))
    s = _rows(spark, sf).select(F.col("source").alias("corpus")).distinct().withColumn("p", F.lit(True))
    return w.join(s, "corpus", "full_outer").select("corpus", F.coalesce("weights", F.lit(0)).alias("weights"), F.col("p").isNotNull().alias("present"))


# Training views

_SCORE = "sha256(unhex('000000000000002A') || encode(CAST(row_id AS VARCHAR)))"


@query(f"SELECT id FROM (SELECT CAST(row_id AS VARCHAR) AS id, row_number() OVER (ORDER BY {_SCORE}, CAST(row_id AS VARCHAR)) AS n, count(*) OVER () AS c FROM text_rows) WHERE n <= least(CAST(ceil(0.01 * c) AS BIGINT), 256)")
def holdout_lowest_sha(spark, sf):
    """The held-out records: the lowest scores, at most 256."""
    records = _rows(spark, sf).select(F.col("row_id").cast("string").alias("id"), F.octet_length("text").cast("bigint").alias("size"))
    return training.holdout(records, 42, 0.01, 256, 1 << 30).select("id")


@query(f"""WITH r AS (SELECT source, CAST(row_id AS VARCHAR) AS id, row_number() OVER (PARTITION BY source ORDER BY {_SCORE}, CAST(row_id AS VARCHAR)) AS n, count(*) OVER () AS c FROM text_rows)
SELECT corpus, id FROM (SELECT source AS corpus, id, c, row_number() OVER (ORDER BY n, source) AS place FROM r WHERE n <= 256) WHERE place <= greatest(1, least(CAST(ceil(c * CAST(0.01 AS DOUBLE)) AS BIGINT), 256, c - 1))""")
def holdout_stratified(spark, sf):
    """The stratified held-out set: the lowest scores of the sources in turns, at most 256 records."""
    records = _rows(spark, sf).select(F.col("source").alias("corpus"), F.col("row_id").cast("string").alias("id"), F.octet_length("text").cast("bigint").alias("size"))
    return training.stratified_holdout(records, 42, 0.01, 256, 1 << 30).select("corpus", "id")


@query(f"SELECT row_id FROM text_rows WHERE row_id NOT IN (SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY {_SCORE}, CAST(row_id AS VARCHAR)) AS n, count(*) OVER () AS c FROM text_rows) WHERE n <= least(CAST(ceil(0.01 * c) AS BIGINT), 256))")
def holdout_anti(spark, sf):
    """The training records: all that are not held out."""
    held = holdout_lowest_sha(spark, sf).select(F.col("id").cast("bigint").alias("row_id"))
    return _rows(spark, sf).select("row_id").join(F.broadcast(held), "row_id", "left_anti")


@query(f"SELECT CAST(shard_id AS BIGINT) AS shard_id, row_number() OVER (ORDER BY sha256(unhex('000000000000002A') || encode(sha256)), shard_id) AS place FROM shards")
def seeded_shard_order(spark, sf):
    """Shards in a seeded order."""
    s = table(spark, sf, "shards")
    return s.select("shard_id", F.row_number().over(Window.orderBy(training.score(42, F.col("sha256")), "shard_id")).cast("bigint").alias("place"))


_BEFORE = "SELECT source AS corpus, row_id AS seq, CAST(coalesce(sum(coalesce(token_count, 0)) OVER (PARTITION BY source ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM text_rows"


@query(f"""WITH w AS (SELECT stage, regexp_replace(lower(trim(corpus)), '\\.(ya?ml|json)$', '') AS corpus, CAST(sum(weight) AS BIGINT) AS weight FROM corpus_weights WHERE weight > 0 GROUP BY 1, 2),
l AS (SELECT stage, list_reduce(list(CAST(weight AS HUGEINT)), lambda x, y: lcm(x, y)) AS whole FROM w GROUP BY stage)
SELECT stage, corpus, seq, before, weight, CAST(before * (whole // weight) AS VARCHAR) AS key FROM ({_BEFORE}) JOIN w USING (corpus) JOIN l USING (stage)""")
def stage_interleave(spark, sf):
    """The sources of every stage in turns by its weights: the key of the order (exact, as digits)."""
    w = table(spark, sf, "corpus_weights").select("stage", F.regexp_replace(F.lower(F.trim("corpus")), r"\.(ya?ml|json)$", "").alias("corpus"), "weight")
    return training.stage_order(_tokens_of(spark, sf), w).withColumn("key", F.col("key").cast("string"))


@query(f"SELECT corpus, seq, before, before AS key FROM ({_BEFORE})")
def balanced_interleave(spark, sf):
    """All sources in turns, each with the same weight: the key of the order."""
    return training.balanced_order(_tokens_of(spark, sf)).select("corpus", "seq", "before", "key")


def _tokens_of(spark, sf):
    return _rows(spark, sf).select(F.col("source").alias("corpus"), F.col("row_id").alias("seq"), F.coalesce("token_count", F.lit(0)).alias("tokens"))


@query("SELECT CAST(sum(strlen(text) + 1) - 1 AS BIGINT) AS targets FROM text_rows")
def byte_targets(spark, sf):
    """Byte targets of one epoch."""
    return training.byte_targets(_rows(spark, sf))


@query("SELECT CAST(sum(strlen(text) + 1) * 3 - 1 AS BIGINT) AS targets FROM text_rows")
def epoch_targets(spark, sf):
    """Byte targets of three epochs."""
    return training.byte_targets(_rows(spark, sf), 3)


@query("""WITH t AS (SELECT row_id, strlen(text) + 1 AS n FROM text_rows), p AS (SELECT n, coalesce(sum(n) OVER (ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM t),
s AS (SELECT greatest(b, 1) AS a, b + n - 1 AS z FROM p WHERE b + n > 1), w AS (SELECT a, z, unnest(range(CAST((a - 1) // 512 AS BIGINT), CAST((z - 1) // 512 AS BIGINT) + 1)) AS w FROM s)
SELECT w AS window, CAST(sum(least(z, (w + 1) * 512) - greatest(a, w * 512 + 1) + 1) AS BIGINT) AS targets FROM w GROUP BY w""")
def pack_windows(spark, sf):
    """Windows of 512 byte tokens over all texts in a row, and their targets."""
    r = _rows(spark, sf).select(F.col("row_id").alias("seq"), F.octet_length("text").cast("bigint").alias("tokens"))
    return training.pack_windows(r, 512)


@query("SELECT row_id, CAST(i AS BIGINT) AS piece, CAST(least(512, n - i * 512) AS BIGINT) AS targets FROM (SELECT row_id, strlen(text) AS n, unnest(range(CAST((strlen(text) + 511) // 512 AS BIGINT))) AS i FROM text_rows)")
def evaluation_windows(spark, sf):
    """Windows of every record by itself, as evaluation packs them."""
    n = F.octet_length("text")
    r = _rows(spark, sf).where(n > 0).select("row_id", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(n / 512).cast("bigint") - 1)).alias("piece"))
    return r.select("row_id", "piece", F.least(F.lit(512).cast("bigint"), F.col("n") - F.col("piece") * 512).cast("bigint").alias("targets"))


@query("SELECT name, CAST((planned_tokens + batch_size * sequence_length - 1) // (batch_size * sequence_length) AS BIGINT) AS steps FROM planned_stages")
def stage_steps(spark, sf):
    """Steps that hold each stage's tokens."""
    one = F.col("batch_size") * F.col("sequence_length")
    return table(spark, sf, "planned_stages").select("name", F.ceil(F.col("planned_tokens") / one).cast("bigint").alias("steps"))


@query("SELECT corpus, sha256(string_agg(sha256 || chr(10), '' ORDER BY sha256)) AS digest FROM shards GROUP BY corpus")
def selection_digest(spark, sf):
    """One digest over the ordered shards of every corpus."""
    return table(spark, sf, "shards").groupBy("corpus").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("sha256", F.lit("\n")))), ""), 256).alias("digest"))


@query()
def bounded_shuffle(spark, sf):
    """The bounded shuffle of every corpus of the shards' rows."""
    row = F.col("row_no").cast("string")
    size = training.record_bytes(F.concat(F.col("shard_id").cast("string"), F.lit("#"), row), F.col("row_id").cast("string"), F.col("text"), F.col("source"), F.col("license"), F.col("language"), F.col("source"))
    r = _rows(spark, sf).select(F.col("source").alias("corpus"), F.col("shard_id").cast("string").alias("shard"), F.col("row_no").alias("row"), size.alias("size"))
    return training.bounded_shuffle(r, 42)


@query()
def redact_fixed_point(spark, sf):
    """Texts with mail addresses, addresses, telephone numbers, credentials and routing headers replaced until nothing is left."""
    from ..functions.privacy import redacted

    return _rows(spark, sf).select("row_id", redacted(F.col("text")).alias("r")).select("row_id", "r.*")


@query()
def repetition_flag(spark, sf):
    """The whole repetition flag, 8-grams included."""
    from ..functions.privacy import is_repetitive

    return _rows(spark, sf).select("row_id", is_repetitive(T.words(F.col("text"))).alias("repetitive"))


@query("""SELECT source AS corpus, bool_and(boilerplate_content IS NOT NULL) AS assessed, count(*) AS records, CAST(sum(CASE WHEN main_content AND NOT boilerplate_content AND NOT repetitive_content THEN strlen(text) ELSE 0 END) AS BIGINT) AS clean_bytes,
 CAST(count(DISTINCT content_sha256) AS BIGINT) AS texts FROM text_rows GROUP BY source""")
def quality_report(spark, sf):
    """Records, distinct texts and clean bytes of every corpus."""
    clean = F.col("main_content") & ~F.col("boilerplate_content") & ~F.col("repetitive_content")
    return _rows(spark, sf).groupBy(F.col("source").alias("corpus")).agg(F.bool_and(F.col("boilerplate_content").isNotNull()).alias("assessed"), F.count(F.lit(1)).alias("records"), F.sum(F.when(clean, F.octet_length("text")).otherwise(0)).cast("bigint").alias("clean_bytes"), F.countDistinct("content_sha256").alias("texts"))


def queries() -> dict:
    """All queries by name."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Their SQL."""
    return dict(SQL)
