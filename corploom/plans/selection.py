"""Named queries over catalogues, boundaries, budgets and runs, with the SQL that gives the same rows. Every query reads its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import conversation, policy
from ..functions import text as T
from ..operators import selection, training
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


def _rows(spark, sf) -> DataFrame:
    return table(spark, sf, "text_rows")


def _shards(spark, sf) -> DataFrame:
    return table(spark, sf, "shards")


_KIND = "split_part(corpus, '/', 1)"


# Boundaries and trees

_FILES = "SELECT corpus || '/' || split_part(url, '/', 4) AS path, sha256, bytes, corpus FROM shards"


def _files(spark, sf) -> DataFrame:
    return _shards(spark, sf).select(F.concat("corpus", F.lit("/"), F.split_part("url", F.lit("/"), F.lit(4))).alias("path"), "sha256", "bytes", "corpus")


@query(f"""WITH f AS ({_FILES}), b AS (SELECT DISTINCT {_KIND} AS source, {_KIND} AS prefix FROM shards UNION SELECT corpus, corpus FROM shards WHERE corpus LIKE 'books/%'),
c AS (SELECT DISTINCT f.path, b.source, b.prefix FROM f LEFT JOIN b ON starts_with(f.path, b.prefix || '/') OR f.path = b.prefix)
SELECT path, CASE WHEN count(source) = 1 THEN min(source) END AS source, count(source) AS claims FROM c GROUP BY path""")
def boundary_claims(spark, sf):
    """Which source claims each file: kinds claim their files, and books claim theirs a second time."""
    s = _shards(spark, sf)
    kinds = s.select(F.split_part("corpus", F.lit("/"), F.lit(1)).alias("source")).distinct().withColumn("prefix", F.col("source"))
    books = s.where("corpus like 'books/%'").select(F.col("corpus").alias("source"), F.col("corpus").alias("prefix")).distinct()
    return selection.boundary_claims(_files(spark, sf), kinds.unionByName(books))


_EVIDENCE = "SELECT corpus AS source, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, sha256(string_agg(sha256 || chr(9) || bytes || chr(9) || path || chr(10), '' ORDER BY path)) AS tree FROM f GROUP BY corpus"


@query(f"WITH f AS ({_FILES}) {_EVIDENCE}")
def boundary_evidence(spark, sf):
    """Files, bytes and the inventory's digest of every corpus."""
    return selection.boundary_evidence(_files(spark, sf).withColumnRenamed("corpus", "source"))


@query(f"""WITH f AS ({_FILES}), a AS ({_EVIDENCE}), g AS (SELECT path, sha256, bytes + CASE WHEN bytes % 3 = 0 THEN 1 ELSE 0 END AS bytes, corpus FROM f WHERE bytes % 5 <> 0), d AS ({_EVIDENCE.replace('FROM f', 'FROM g')})
SELECT source, CASE WHEN d.files IS NULL THEN 'undeclared' WHEN a.files IS NULL THEN 'missing' WHEN d.files <> a.files THEN 'files' WHEN d.bytes <> a.bytes THEN 'bytes' ELSE 'tree' END AS problem
 FROM d FULL JOIN a USING (source) WHERE d.files IS DISTINCT FROM a.files OR d.bytes IS DISTINCT FROM a.bytes OR d.tree IS DISTINCT FROM a.tree""")
def boundary_verify(spark, sf):
    """Corpora whose declaration (with some files left out and some sizes wrong) is not what is there."""
    files = _files(spark, sf).withColumnRenamed("corpus", "source")
    stale = files.where("bytes % 5 <> 0").withColumn("bytes", F.col("bytes") + F.when(F.col("bytes") % 3 == 0, 1).otherwise(0))
    return selection.verify_boundaries(selection.boundary_evidence(stale), selection.boundary_evidence(files))


@query("""WITH a AS (SELECT lower(hex(content_sha256)) AS digest, source FROM shard_v2), b AS (SELECT lower(hex(content_sha256)) AS digest, source FROM shard_v3)
SELECT 'left' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'right', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def tree_differences(spark, sf):
    """What two trees do not share, rows counted."""
    side = lambda t: table(spark, sf, t).select(F.lower(F.hex("content_sha256")).alias("digest"), "source")
    return selection.tree_differences(side("shard_v2"), side("shard_v3"))


@query("""WITH n AS (SELECT url AS path, CASE WHEN shard_id % 7 = 3 THEN sha256(sha256) ELSE sha256 END AS sha256, bytes + CASE WHEN shard_id % 11 = 5 THEN 1 ELSE 0 END AS bytes, written_at AS modified FROM shards WHERE shard_id % 5 <> 2 UNION ALL SELECT url || '.new', sha256, bytes, written_at FROM shards WHERE shard_id % 6 = 1)
SELECT coalesce(p.url, n.path) AS path, CASE WHEN p.url IS NULL THEN 'new' WHEN n.path IS NULL THEN 'missing' WHEN p.sha256 = n.sha256 AND p.bytes IS NOT DISTINCT FROM n.bytes AND p.written_at = n.modified THEN 'unchanged' ELSE 'changed' END AS state FROM shards p FULL JOIN n ON p.url = n.path""")
def changed_files(spark, sf):
    """Planned files against what is there now: some gone, some new, some with another digest or size."""
    s = _shards(spark, sf)
    planned = s.select(F.col("url").alias("path"), "sha256", "bytes", F.col("written_at").alias("modified"))
    now = s.where("shard_id % 5 <> 2").select(F.col("url").alias("path"), F.when(F.col("shard_id") % 7 == 3, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"), (F.col("bytes") + F.when(F.col("shard_id") % 11 == 5, 1).otherwise(0)).alias("bytes"), F.col("written_at").alias("modified"))
    new = s.where("shard_id % 6 = 1").select(F.concat("url", F.lit(".new")).alias("path"), "sha256", "bytes", F.col("written_at").alias("modified"))
    return selection.changed_files(planned, now.unionByName(new))


# Objects and pins


@query("""SELECT sha256, bytes, CASE WHEN shard_id % 5 = 2 THEN 'missing' WHEN shard_id % 11 = 5 THEN 'wrong-size' ELSE 'available' END AS state FROM shards""")
def object_states(spark, sf):
    """Whether every pinned object is there with its size."""
    s = _shards(spark, sf)
    there = s.where("shard_id % 5 <> 2").select("sha256", (F.col("bytes") + F.when(F.col("shard_id") % 11 == 5, 1).otherwise(0)).alias("bytes"))
    return selection.object_states(s.select("sha256", "bytes"), there)


@query("""SELECT url AS path, sha256, split_part(url, '/', 2) = substr(sha256, 1, 2) AND split_part(url, '/', 3) = substr(sha256, 3, 2) AS canonical FROM shards
 UNION ALL SELECT 'store/' || sha256, sha256, false FROM shards UNION ALL SELECT 'notes/' || shard_id || '.txt', NULL, false FROM shards""")
def object_listing(spark, sf):
    """Objects by their paths: the digest, and whether it lies in the folders of its beginning."""
    s = _shards(spark, sf)
    paths = s.select(F.col("url").alias("path")).union(s.select(F.concat(F.lit("store/"), "sha256"))).union(s.select(F.concat(F.lit("notes/"), F.col("shard_id").cast("string"), F.lit(".txt"))))
    return selection.object_listing(paths)


_PINS = "(SELECT sha256, url, bytes FROM shards UNION ALL SELECT sha256, 'mirror/' || url, bytes FROM shards WHERE shard_id % 2 = 0 UNION ALL SELECT sha256, url || '.old', bytes - 1 FROM shards WHERE shard_id % 7 = 1)"


@query(f'SELECT sha256, min(url) AS url, min(bytes) AS bytes, count(*) AS "references", coalesce(min(bytes) <> max(bytes), false) AS conflict FROM {_PINS} GROUP BY sha256')
def fetch_plan(spark, sf):
    """One fetch for every distinct object of the pins, and conflicts of size."""
    s = _shards(spark, sf)
    pins = s.select("sha256", "url", "bytes").union(s.where("shard_id % 2 = 0").select("sha256", F.concat(F.lit("mirror/"), "url"), "bytes")).union(s.where("shard_id % 7 = 1").select("sha256", F.concat("url", F.lit(".old")), F.col("bytes") - 1))
    return selection.fetch_plan(pins)


@query("""SELECT shard_id AS ordinal, CASE WHEN shard_id % 5 = 2 THEN 'missing' WHEN shard_id % 7 = 3 THEN 'digest' ELSE 'size' END AS problem FROM shards WHERE shard_id % 5 = 2 OR shard_id % 7 = 3 OR shard_id % 11 = 5
 UNION ALL SELECT -shard_id, 'unexpected' FROM shards WHERE shard_id % 13 = 4""")
def export_mismatches(spark, sf):
    """An export's files against its pins, place by place."""
    s = _shards(spark, sf)
    pins = s.select(F.col("shard_id").alias("ordinal"), "sha256", "bytes")
    files = s.where("shard_id % 5 <> 2").select(F.col("shard_id").alias("ordinal"), F.when(F.col("shard_id") % 7 == 3, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"), (F.col("bytes") + F.when(F.col("shard_id") % 11 == 5, 1).otherwise(0)).alias("bytes"))
    more = s.where("shard_id % 13 = 4").select((-F.col("shard_id")).alias("ordinal"), "sha256", "bytes")
    return selection.export_mismatches(files.unionByName(more), pins)


# Policies and outcomes


@query("SELECT source, CASE WHEN regexp_replace(text, '[\\s ]+', '', 'g') = '' THEN 'empty' WHEN license IN ('MIT', 'CC0-1.0') OR license LIKE 'CC-BY%' AND license NOT LIKE '%-NC-%' THEN 'kept' ELSE 'license-policy' END AS outcome, count(*) AS records FROM text_rows GROUP BY 1, 2")
def ingest_outcomes(spark, sf):
    """What becomes of every row under a licence policy, by source."""
    p = policy.Values(["MIT", "CC0-1.0", "CC-BY*"], ["*-NC-*"])
    return selection.outcomes(_rows(spark, sf), p.allows(F.col("license")))


@query("""SELECT row_id FROM text_rows WHERE coalesce(main_content, true) AND NOT coalesce(repetitive_content, false) AND coalesce(license, '') NOT LIKE 'CC-BY-NC%'
 AND (source <> 'web/open-gazette.example' OR (coalesce(main_content, true) AND coalesce(language, '') = 'en'))
 AND (source <> 'gov/harbor-code' OR (coalesce(boilerplate_content, false) = false))
 AND (source <> 'mail/kernel-garden' OR (coalesce(main_content, true) AND coalesce(source_name, '') LIKE '%e%' AND coalesce(source_name, '') NOT LIKE '%/%'))""")
def record_filter_policy(spark, sf):
    """Rows that pass the filter for all and that of their corpus."""
    p = policy.FilterPolicy(
        policy.RecordFilter(repetitive=True, exclude_licenses=["CC-BY-NC*"]),
        {
            "web/open-gazette.example": policy.RecordFilter(languages=policy.Values(["en"])),
            "gov/harbor-code": policy.RecordFilter(boilerplate=True, main_content=None),
            "mail/kernel-garden": policy.RecordFilter(sources=policy.Values(["*e*"])),
        },
    )
    p.validate(["web/open-gazette.example", "gov/harbor-code", "mail/kernel-garden"])
    return _rows(spark, sf).where(p.predicate(F.col("source"))).select("row_id")


# Catalogue


@query("""WITH u AS (SELECT shard_id, license, count(*) AS d, CAST(sum(coalesce(token_count, 0)) AS BIGINT) AS t FROM text_rows WHERE license IS NOT NULL GROUP BY 1, 2), m AS (SELECT shard_id, count(*) AS n FROM u GROUP BY 1),
e AS (SELECT coalesce(u.license, s.license) AS license, CASE WHEN n > 1 THEN u.d ELSE s.docs END AS docs, CASE WHEN n > 1 THEN u.t ELSE coalesce(s.tokens, 0) END AS tokens, CASE WHEN n > 1 THEN 0 ELSE coalesce(s.bytes, 0) END AS bytes FROM shards s LEFT JOIN m USING (shard_id) LEFT JOIN u USING (shard_id))
SELECT license, count(*) AS shards, CAST(sum(docs) AS BIGINT) AS docs, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(bytes) AS BIGINT) AS bytes FROM e WHERE license IS NOT NULL GROUP BY license
UNION ALL SELECT NULL, count(*), CAST(sum(docs) AS BIGINT), CAST(sum(coalesce(tokens, 0)) AS BIGINT), CAST(sum(coalesce(bytes, 0)) AS BIGINT) FROM shards""")
def index_summary(spark, sf):
    """Totals of the catalogue and by licence, shards of several licences by their rows."""
    return selection.index_summary(_shards(spark, sf), _rows(spark, sf))


@query(f"""WITH s AS (SELECT corpus, license, {_KIND} AS modality, docs, tokens, bytes, coalesce(license IN ('MIT', 'CC0-1.0') OR license LIKE 'CC-BY%' AND license NOT LIKE '%-NC-%', false) AS ok FROM shards)
SELECT corpus, license, modality, CAST(grouping(corpus, license, modality) AS INTEGER) AS level, CAST(count(*) FILTER (ok) AS BIGINT) AS shards, CAST(coalesce(sum(docs) FILTER (ok), 0) AS BIGINT) AS docs, CAST(coalesce(sum(tokens) FILTER (ok), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(bytes) FILTER (ok), 0) AS BIGINT) AS bytes
 FROM s GROUP BY GROUPING SETS ((), (corpus), (license), (corpus, license), (modality)) HAVING count(*) FILTER (ok) > 0 OR grouping(corpus, license, modality) IN (3, 7)""")
def bom_totals_policy(spark, sf):
    """Totals of the selection a licence policy leaves, by manifest, licence and modality; a corpus without any stays."""
    p = policy.Values(["MIT", "CC0-1.0", "CC-BY*"], ["*-NC-*"])
    s = _shards(spark, sf).withColumn("modality", F.split_part("corpus", F.lit("/"), F.lit(1)))
    return selection.bom_totals(s, p.allows(F.col("license")) & F.col("license").isNotNull())


_TREE = f"""WITH RECURSIVE l AS (SELECT corpus AS node, sha256, docs, tokens, bytes FROM shards UNION ALL SELECT 'mirror/' || corpus, sha256, docs, tokens, bytes FROM shards WHERE shard_id % 3 = 0),
e AS (SELECT DISTINCT node AS child, split_part(node, '/', 1) AS parent FROM l UNION SELECT DISTINCT split_part(node, '/', 1), 'root' FROM l),
t AS (SELECT * FROM l UNION ALL SELECT e.parent, t.sha256, t.docs, t.tokens, t.bytes FROM t JOIN e ON t.node = e.child),
o AS (SELECT node, sha256, max(docs) AS docs, max(tokens) AS tokens, max(bytes) AS bytes FROM t GROUP BY 1, 2)"""


@query(f"{_TREE} SELECT node, count(*) AS objects, CAST(sum(coalesce(docs, 0)) AS BIGINT) AS docs, CAST(sum(coalesce(tokens, 0)) AS BIGINT) AS tokens, CAST(sum(coalesce(bytes, 0)) AS BIGINT) AS bytes FROM o GROUP BY node")
def rollup_once_per_object(spark, sf):
    """Totals of a tree of catalogues in which some objects are listed twice: each counts once below a node."""
    return selection.tree_totals_once(*_tree(spark, sf))


def _tree(spark, sf):
    s = _shards(spark, sf)
    leaves = s.select(F.col("corpus").alias("node"), "sha256", "docs", "tokens", "bytes")
    leaves = leaves.unionByName(s.where("shard_id % 3 = 0").select(F.concat(F.lit("mirror/"), "corpus").alias("node"), "sha256", "docs", "tokens", "bytes"))
    kind = F.split_part("node", F.lit("/"), F.lit(1))
    edges = leaves.select(kind.alias("parent"), F.col("node").alias("child")).distinct().union(leaves.select(F.lit("root"), kind).distinct())
    return edges, leaves


@query("""WITH d AS (SELECT split_part(source, '/', 1) AS corpus, [language] AS l FROM text_rows UNION ALL SELECT split_part(source, '/', 1), [lang, ' EN '] FROM shard_legacy), x AS (SELECT corpus, lower(trim(unnest(l))) AS l FROM d)
SELECT corpus, coalesce(string_agg(DISTINCT l, ',' ORDER BY l) FILTER (l <> ''), '') AS languages FROM x GROUP BY corpus""")
def declared_languages(spark, sf):
    """Languages that the sources of every kind declare."""
    kind = F.split_part("source", F.lit("/"), F.lit(1)).alias("corpus")
    d = _rows(spark, sf).select(kind, F.array("language").alias("languages")).unionByName(table(spark, sf, "shard_legacy").select(kind, F.array("lang", F.lit(" EN ")).alias("languages")))
    return selection.declared_languages(d).select("corpus", F.array_join("languages", ",").alias("languages"))


@query("""WITH n AS (SELECT source AS url, min(source_name) AS name, min(row_id) AS ordinal FROM text_rows GROUP BY source), o AS (SELECT source AS url, min(upper(source_name)) AS note, min(source_name) AS name, count(*) AS docs FROM shard_v1 WHERE source < 'web/o' GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY url) AS ordinal FROM o), j AS (SELECT n.ordinal, p.note, p.docs, row_number() OVER (PARTITION BY n.ordinal ORDER BY p.ordinal) AS k FROM n JOIN p ON n.name = p.name OR n.url = p.url)
SELECT n.ordinal, n.name, n.url, j.note, coalesce(j.docs, 0) AS docs FROM n LEFT JOIN j ON n.ordinal = j.ordinal AND j.k = 1""")
def source_context_kept(spark, sf):
    """Sources of an update with what earlier ones of their name or address said."""
    new = _rows(spark, sf).groupBy(F.col("source").alias("url")).agg(F.min("source_name").alias("name"), F.min("row_id").alias("ordinal")).select("ordinal", "name", "url")
    old = table(spark, sf, "shard_v1").where("source < 'web/o'").groupBy(F.col("source").alias("url")).agg(F.min("source_name").alias("name"), F.min(F.upper("source_name")).alias("note"), F.count(F.lit(1)).alias("docs"))
    # the order of the old sources is that of their addresses, which stand in for their ordinals
    return selection.keep_context(new, old.withColumn("ordinal", F.col("url")), ["note", "docs"]).withColumn("docs", F.coalesce("docs", F.lit(0)))


@query("""SELECT r.row_id, s.name AS source_name, s.license AS source_license, s.name IS NULL AS unknown FROM text_rows r LEFT JOIN (SELECT source, min(upper(source)) AS name, min(license) AS license FROM shard_v2 GROUP BY source) s USING (source)""")
def input_sources(spark, sf):
    """Rows with what their source declares."""
    s = table(spark, sf, "shard_v2").groupBy(F.col("source").alias("source_id")).agg(F.min(F.upper("source")).alias("name"), F.min("license").alias("license"))
    return selection.source_of(_rows(spark, sf).select("row_id", F.col("source").alias("source_id")), s).select("row_id", "source_name", "source_license", "unknown")


_SOURCES = """SELECT source AS context, CASE split_part(source, '/', 1) WHEN 'web' THEN 'Web Crawl' WHEN 'mail' THEN 'user_data' WHEN 'books' THEN 'commercially-licensed' WHEN 'gov' THEN 'public' ELSE 'unheard of' END AS category,
 CASE WHEN count(*) > 5 THEN 'text' END AS usage, CASE WHEN min(row_id) % 3 > 0 THEN 'articles' ELSE ' ' END AS types, min(language) AS languages, max(date) AS collected_to, min(license_raw) AS basis, min(source_name) AS crawler, CAST(NULL AS VARCHAR) AS service, '' AS generator FROM text_rows GROUP BY source"""
_BLANK = "coalesce(trim({}), '') = ''"


@query(f"""WITH s AS ({_SOURCES}) SELECT '2' AS section, 'source.category' AS field, context, 'required' AS severity FROM s WHERE category = 'unheard of'
 UNION ALL SELECT '1.3', 'source.usage', context, 'required' FROM s WHERE {_BLANK.format('usage')} UNION ALL SELECT '1.3', 'source.content-types', context, 'required' FROM s WHERE {_BLANK.format('types')}
 UNION ALL SELECT '1.3', 'source.languages', context, 'review' FROM s WHERE {_BLANK.format('languages')} UNION ALL SELECT '1.3', 'source.acquisition-date', context, 'required' FROM s WHERE {_BLANK.format('collected_to')}
 UNION ALL SELECT '2.2', 'source.acquisition-basis', context, 'required' FROM s WHERE category = 'commercially-licensed' AND {_BLANK.format('basis')} UNION ALL SELECT '2.3', 'source.web-evidence', context, 'required' FROM s WHERE category = 'Web Crawl' AND {_BLANK.format('crawler')}
 UNION ALL SELECT '2.4', 'source.user-data', context, 'required' FROM s WHERE category = 'user_data'""")
def disclosure_gaps(spark, sf):
    """Evidence that the sources' declarations lack."""
    kind = F.split_part("source", F.lit("/"), F.lit(1))
    g = _rows(spark, sf).groupBy("source", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"), F.min("language").alias("languages"), F.max("date").alias("collected_to"), F.min("license_raw").alias("basis"), F.min("source_name").alias("crawler"))
    category = F.when(F.col("kind") == "web", "Web Crawl").when(F.col("kind") == "mail", "user_data").when(F.col("kind") == "books", "commercially-licensed").when(F.col("kind") == "gov", "public").otherwise("unheard of")
    s = g.select(F.col("source").alias("context"), category.alias("category"), F.when(F.col("n") > 5, "text").alias("usage"), F.when(F.col("first") % 3 > 0, "articles").otherwise(" ").alias("types"), "languages", "collected_to", "basis", "crawler", F.lit(None).cast("string").alias("service"), F.lit("").alias("generator"))
    return selection.disclosure_gaps(s)


# Conversations

_TURNS = "SELECT doc_id AS conv_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS turn FROM documents"


@query(f"""WITH t AS (SELECT conv_id, turn, regexp_extract(line, '^(user|assistant|human|system): ', 1) AS role, regexp_replace(line, '^(user|assistant|human|system): ', '') AS text FROM ({_TURNS})), s AS (SELECT conv_id, turn, role, text FROM t WHERE role <> '' AND text <> '')
SELECT conv_id, count(*) AS turns, sha256(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS messages, count(*) FILTER (role = 'human') = 0 AND count(*) FILTER (role = 'user') > 0 AND count(*) FILTER (role = 'assistant') > 0 AS valid FROM s GROUP BY conv_id""")
def turns_to_conversations(spark, sf):
    """Turns found in the documents' lines, grouped to conversations (as digests), and whether they are valid."""
    head = r"^(user|assistant|human|system): "
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("conv_id"), F.posexplode(F.split("text", "\n", -1)).alias("turn", "line"))
    turns = lines.where(F.col("line").rlike(head)).select("conv_id", "turn", F.regexp_extract("line", head, 1).alias("role"), F.regexp_replace("line", head, "").alias("text"))
    c = selection.turns_to_conversations(turns)
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return c.select("conv_id", F.size("messages").cast("bigint").alias("turns"), F.sha2(said, 256).alias("messages"), "valid")


def _go_sql(c: str) -> str:
    """The SQL of a text as a canonical JSON string."""
    from .reference import _json_sql

    c = _json_sql(c)
    for code in (60, 62, 38, 0x2028, 0x2029):
        c = f"replace({c}, chr({code}), '\\u{code:04x}')"
    return c


_ASKED = "(SELECT doc_id, source AS q, text AS a, corpus AS x FROM documents WHERE text <> '')"
_ENCODED = f"""'{{"messages":[{{"role":"user","content":' || {_go_sql("q")} || ',"context":' || {_go_sql("x")} || '}},{{"role":"assistant","content":' || {_go_sql("a")} || '}}]}}'"""


def _encoded(spark, sf) -> DataFrame:
    one = lambda role, c, x: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"), x.alias("context"))
    messages = F.array(one("user", "source", F.col("corpus")), one("assistant", "text", F.lit(None).cast("string")))
    return table(spark, sf, "documents").where("text <> ''").select("doc_id", conversation.encode(messages).alias("line"))


@query(f"SELECT doc_id, sha256({_ENCODED}) AS line FROM {_ASKED}")
def conversation_encoded(spark, sf):
    """Dialogues as canonical JSON (as digests)."""
    return _encoded(spark, sf).select("doc_id", F.sha2("line", 256).alias("line"))


@query(f"SELECT doc_id, doc_id % 5 <> 1 AND doc_id % 5 <> 2 AND doc_id % 5 <> 3 AS ok, CASE WHEN doc_id % 5 IN (0, 4) THEN sha256(a) END AS answer FROM {_ASKED}")
def conversation_decoded(spark, sf):
    """Canonical dialogues read strictly; in three of five something is not canonical: an unknown field, a blank after the end, a blank inside."""
    k = F.col("doc_id") % 5
    line = F.when(k == 1, F.replace("line", F.lit('{"messages"'), F.lit('{"other":1,"messages"'))).when(k == 2, F.concat("line", F.lit(" "))).when(k == 3, F.replace("line", F.lit('{"messages":['), F.lit('{"messages": ['))).otherwise(F.col("line"))
    d = _encoded(spark, sf).select("doc_id", conversation.decode(line).alias("d"))
    return d.select("doc_id", F.col("d.error").isNull().alias("ok"), F.sha2(F.element_at("d.messages", -1)["content"], 256).alias("answer"))


# Budgets and runs


@query("""WITH t AS (SELECT doc_id, strlen(source) AS silent, strlen(source) + strlen(text) AS n FROM documents WHERE text IS NOT NULL), p AS (SELECT *, coalesce(sum(n + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM t),
s AS (SELECT greatest(b + silent, 1) AS a, b + n AS z FROM p WHERE b + n >= greatest(b + silent, 1)), w AS (SELECT a, z, unnest(range(CAST((a - 1) // 256 AS BIGINT), CAST((z - 1) // 256 AS BIGINT) + 1)) AS w FROM s)
SELECT w AS window, CAST(sum(least(z, (w + 1) * 256) - greatest(a, w * 256 + 1) + 1) AS BIGINT) AS targets FROM w GROUP BY w""")
def pack_windows_masked(spark, sf):
    """Windows of 256 byte tokens over dialogues, of which only the answers are targets."""
    d = table(spark, sf, "documents").where("text is not null")
    return training.pack_windows(d.select(F.col("doc_id").alias("seq"), (F.octet_length("source") + F.octet_length("text")).cast("bigint").alias("tokens"), F.octet_length("source").cast("bigint").alias("silent")), 256)


@query("SELECT row_id, e AS epoch, sha256(unhex('0000000000000007') || encode(e || ':' || row_id)) AS order_key FROM text_rows, range(3) r(e)")
def epoch_order(spark, sf):
    """Three epochs of all rows, each in an order of its own."""
    return training.epoch_order(_rows(spark, sf).select("row_id"), 7, 3, F.col("row_id").cast("string")).select("row_id", F.col("epoch").cast("bigint").alias("epoch"), "order_key")


_ACTUAL = "SELECT w.stage, count(*) AS files, CAST(sum(docs) AS BIGINT) AS docs, CAST(sum(coalesce(tokens, 0)) AS BIGINT) AS tokens, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT DISTINCT stage, regexp_replace(lower(trim(corpus)), '\\.(ya?ml|json)$', '') AS corpus FROM corpus_weights) w JOIN shards s USING (corpus) GROUP BY 1"


@query(f"""WITH a AS ({_ACTUAL}), s AS (SELECT name, type, objective, corpus_bom_sha256, files, docs, tokens, bytes FROM planned_stages UNION ALL SELECT name || '-x', CASE WHEN epochs = 1 THEN 'alignment' ELSE type END, 'assistant-response-modeling', corpus_bom_sha256, files, docs, tokens, bytes FROM planned_stages),
j AS (SELECT s.*, a.stage, a.files AS f, a.docs AS d, a.tokens AS t, a.bytes AS b FROM s LEFT JOIN a ON a.stage = s.name)
SELECT name AS stage, 'type' AS problem FROM j WHERE type NOT IN ('pre-training', 'fine-tuning') UNION ALL SELECT name, 'objective' FROM j WHERE type = 'pre-training' AND objective <> 'causal-language-modeling'
 UNION ALL SELECT name, 'selection' FROM j WHERE corpus_bom_sha256 IS NULL UNION ALL SELECT name, 'inputs' FROM j WHERE stage IS NULL UNION ALL SELECT name, 'files' FROM j WHERE files <> f UNION ALL SELECT name, 'docs' FROM j WHERE docs <> d UNION ALL SELECT name, 'tokens' FROM j WHERE tokens <> t UNION ALL SELECT name, 'bytes' FROM j WHERE bytes <> b""")
def stage_problems(spark, sf):
    """What keeps the stages (and copies of them with other types and objectives) from being run."""
    s = table(spark, sf, "planned_stages")
    key = F.regexp_replace(F.lower(F.trim("corpus")), r"\.(ya?ml|json)$", "")
    w = table(spark, sf, "corpus_weights").select("stage", key.alias("corpus")).distinct()
    actual = w.join(_shards(spark, sf), "corpus").groupBy("stage").agg(F.count(F.lit(1)).alias("files"), F.sum("docs").cast("bigint").alias("docs"), F.sum(F.coalesce("tokens", F.lit(0))).cast("bigint").alias("tokens"), F.sum("bytes").cast("bigint").alias("bytes"))
    names = ["name", "type", "objective", "corpus_bom_sha256", "files", "docs", "tokens", "bytes"]
    other = s.withColumn("type", F.when(F.col("epochs") == 1, "alignment").otherwise(F.col("type"))).withColumn("name", F.concat("name", F.lit("-x"))).withColumn("objective", F.lit("assistant-response-modeling"))
    return training.stage_problems(s.select(*names).unionByName(other.select(*names)), actual)


@query("""SELECT name, CAST(coalesce(steps, -1) AS BIGINT) AS steps, CAST(CASE WHEN steps IS NULL THEN -1 WHEN steps > 1 THEN greatest(least(100, steps // 10), 1) ELSE least(100, steps // 10) END AS BIGINT) AS warmup_steps, CAST(CASE WHEN steps IS NULL THEN -1 ELSE least(500, steps) END AS BIGINT) AS checkpoint_every, CAST(CASE WHEN steps IS NULL THEN -1 ELSE least(500, steps) END AS BIGINT) AS evaluate_every, CAST(coalesce(steps * one, -1) AS BIGINT) AS capacity, data_order, held_out, error FROM (
 SELECT name, one, CASE WHEN k = 0 THEN (planned_tokens + one - 1) // one WHEN k = 1 THEN coalesce(docs, 17) END AS steps, CASE WHEN type = 'pre-training' THEN 'corpus-weighted-shuffle-v1' ELSE 'bounded-shuffle-v1' END AS data_order, CASE WHEN type = 'pre-training' THEN 'stratified-lowest-sha256-v1' ELSE 'lowest-sha256-v1' END AS held_out,
 CASE WHEN k = 3 THEN 'tokens cannot be combined with steps or epochs' WHEN k = 4 THEN 'one of tokens, epochs or steps is required' END AS error FROM (
 SELECT name || '-' || k AS name, k, planned_tokens, docs, type, coalesce(batch_size, 1) * sequence_length AS one FROM planned_stages, (VALUES (0), (1), (2), (3), (4)) v(k)))""")
def parameters_resolved(spark, sf):
    """Every stage with its settings filled in, in five ways to give its budget: tokens, steps, epochs, too much and nothing."""
    s = table(spark, sf, "planned_stages")
    each = s.select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    b = each.select(
        F.concat("name", F.lit("-"), F.col("k").cast("string")).alias("name"), F.when(F.col("k").isin(0, 3), F.col("planned_tokens")).alias("tokens"), F.when(F.col("k") == 1, F.coalesce("docs", F.lit(17))).alias("steps"), F.when(F.col("k").isin(2, 3), 2).alias("epochs"),
        "batch_size", "sequence_length", (F.col("type") == "pre-training").alias("weighted"), F.lit(False).alias("balanced"),
    )
    known = [F.coalesce(c, F.lit(-1)).cast("bigint").alias(c) for c in ("steps", "warmup_steps", "checkpoint_every", "evaluate_every", "capacity")]
    return training.resolved(b).select("name", *known, "data_order", "held_out", "error")


_SCORE = "sha256(unhex('000000000000002A') || encode(CAST(row_id AS VARCHAR)))"
_HELD = f"(SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY {_SCORE}, CAST(row_id AS VARCHAR)) AS n, count(*) OVER () AS c FROM text_rows) WHERE n <= least(CAST(ceil(0.01 * c) AS BIGINT), 256))"


@query(f"SELECT count(*) FILTER (h.row_id IS NULL) AS records, CAST(sum(CASE WHEN h.row_id IS NOT NULL THEN strlen(text) ELSE 0 END) AS BIGINT) AS held_out, CAST(sum(CASE WHEN h.row_id IS NULL THEN strlen(text) ELSE 0 END) * 2 - 1 AS BIGINT) AS targets FROM text_rows LEFT JOIN {_HELD} h USING (row_id)")
def training_targets(spark, sf):
    """Byte targets of two epochs after the held-out records are set aside, and those of the held-out records."""
    r = _rows(spark, sf).select(F.col("row_id").cast("string").alias("id"), "text")
    held = training.holdout(r.select("id", F.octet_length("text").cast("bigint").alias("size")), 42, 0.01, 256, 1 << 40)
    return training.training_targets(r, F.broadcast(held), 2)


@query("SELECT CAST(ceil((n - 1) / 512) AS BIGINT) AS sequences, CAST(ceil(ceil((n - 1) / 512) / 16) AS BIGINT) AS steps FROM (SELECT sum(strlen(text) + 1) * 3 AS n FROM text_rows)")
def epoch_steps(spark, sf):
    """Sequences and steps of three epochs packed continuously."""
    return training.epoch_steps(_rows(spark, sf).select(F.octet_length("text").cast("bigint").alias("tokens")), 16, 512, 3)


@query("SELECT source AS corpus, CAST(sum(strlen(text) + 1) - CASE WHEN min(row_id) = (SELECT min(row_id) FROM text_rows) THEN 1 ELSE 0 END AS BIGINT) AS targets FROM text_rows GROUP BY source")
def consumption_by_corpus(spark, sf):
    """Targets that each corpus gives to a pass over all records."""
    return training.consumption(_rows(spark, sf).select(F.col("source").alias("corpus"), F.col("row_id").alias("seq"), F.octet_length("text").cast("bigint").alias("tokens")))


@query("SELECT source AS corpus, row_id AS seq, row_number() OVER (PARTITION BY source ORDER BY row_id) - 1 AS round FROM text_rows")
def round_robin(spark, sf):
    """All records in turns of their corpora: ordered by round and corpus."""
    return training.rounds(_rows(spark, sf).select(F.col("source").alias("corpus"), F.col("row_id").alias("seq"))).select("corpus", "seq", "round")


_LADDER = sorted((training.decoder_parameters(v, h, layers, heads, kv, i, True), n) for n, _, v, h, i, layers, heads, kv in training.PRESETS)


@query(f"""WITH b AS (SELECT source, CAST(sum(coalesce(token_count, 0)) AS BIGINT) * 50000 AS tokens FROM text_rows GROUP BY source UNION ALL SELECT name, planned_tokens * 0 FROM planned_stages), p(parameters, preset) AS (VALUES {', '.join(f"({k}, '{n}')" for k, n in _LADDER)})
SELECT source, tokens, CASE WHEN tokens > 0 THEN coalesce((SELECT max_by(preset, parameters) FROM p WHERE parameters <= tokens // 20), '{_LADDER[0][1]}') END AS preset FROM b""")
def preset_recommend(spark, sf):
    """The shape that every source's tokens (50,000 times over) suffice for."""
    b = _rows(spark, sf).groupBy("source").agg((F.sum(F.coalesce("token_count", F.lit(0))).cast("bigint") * 50000).alias("tokens"))
    return training.recommended(b.union(table(spark, sf, "planned_stages").select("name", F.col("planned_tokens") * 0)))


_SHAPE = {"vocabulary": 32000, "hidden": 1024, "layers": 24, "heads": 16, "kv_heads": 4, "intermediate": 4096, "tied": True}
_P = training.decoder_parameters(**_SHAPE)
_RUNS = "SELECT CASE event_id % 4 WHEN 0 THEN 'NVIDIA H100 SXM' WHEN 1 THEN 'h100 sxm' WHEN 2 THEN 'Own-Box 7' ELSE 'RTX 5090' END AS device, CASE WHEN event_id % 4 = 3 THEN 4 ELSE 1 END AS gpus, CAST(user_id + 1 AS DOUBLE) * 1e15 AS flops, CAST(event_id % 3 AS DOUBLE) AS seconds FROM events"
_CALIBRATED = f"SELECT min(device) AS device, CASE WHEN lower(device) LIKE '%h100%' THEN 'h100' WHEN lower(device) LIKE '%rtx 5090%' THEN 'rtx5090' ELSE 'ownbox7' END AS key, gpus, count(*) AS runs, sum(flops) / sum(seconds) / 1e12 AS tflops FROM ({_RUNS}) WHERE seconds > 0 GROUP BY 2, 3"


def _calibrations(spark, sf):
    k = F.col("event_id") % 4
    device = F.when(k == 0, "NVIDIA H100 SXM").when(k == 1, "h100 sxm").when(k == 2, "Own-Box 7").otherwise("RTX 5090")
    runs = table(spark, sf, "events").select(device.alias("device"), F.when(k == 3, 4).otherwise(1).alias("gpus"), ((F.col("user_id") + 1).cast("double") * 1e15).alias("flops"), (F.col("event_id") % 3).cast("double").alias("seconds"))
    return training.calibrations(runs)


@query(f"SELECT device, gpus, runs, round(tflops, 3) AS tflops FROM ({_CALIBRATED})")
def calibration_throughput(spark, sf):
    """Observed throughput of every family of accelerators and number of devices."""
    return _calibrations(spark, sf).select("device", "gpus", "runs", F.round("tflops", 3).alias("tflops"))


_DEVICES = ", ".join(f"('{n}', {gib}, {float(t * k * s)!r}, {k})" for n, gib, t, scaling in training.ACCELERATORS for k, s in scaling.items())
_NEED = f"SELECT CAST(sum(planned_tokens) AS BIGINT) AS tokens, max(coalesce(batch_size, 1) * CAST(sequence_length AS BIGINT) * {1024 * 24 * 72} + coalesce(batch_size, 1) * CAST(sequence_length AS BIGINT) * {32000 * 6}) AS work FROM planned_stages"


@query(f"""WITH a(device, gib, tflops, gpus) AS (VALUES {_DEVICES}), n AS ({_NEED}), r AS (SELECT *, ({_P * 16} + gpus - 1) // gpus + work + {4 << 30} AS required, CAST(gib AS BIGINT) * {1 << 30} AS memory FROM a, n)
SELECT device, gpus, CAST(required AS BIGINT) AS required, round(tflops, 6) AS tflops, CAST(greatest(1, ceil({6.0 * _P!r} * tokens / (tflops * 1e12) * 1.08)) AS BIGINT) AS seconds, 'catalog' AS estimate FROM r WHERE required <= memory - memory // 10""")
def forecast_grid(spark, sf):
    """Time of all stages on every accelerator that has the memory."""
    f = training.forecast(table(spark, sf, "planned_stages"), _SHAPE)
    return f.select("device", "gpus", "required", F.round("tflops", 6).alias("tflops"), "seconds", "estimate")


@query(f"""WITH a(device, gib, tflops, gpus) AS (VALUES {_DEVICES}), n AS ({_NEED}), c AS ({_CALIBRATED}), r AS (SELECT a.*, n.*, c.tflops AS seen, ({_P * 16} + a.gpus - 1) // a.gpus + work + {4 << 30} AS required, CAST(gib AS BIGINT) * {1 << 30} AS memory
 FROM a CROSS JOIN n LEFT JOIN c ON c.gpus = a.gpus AND c.key = CASE WHEN a.device LIKE '%H100%' THEN 'h100' WHEN a.device LIKE '%RTX 5090%' THEN 'rtx5090' END)
SELECT device, gpus, CAST(required AS BIGINT) AS required, round(coalesce(seen, tflops), 3) AS tflops, CAST(greatest(1, CASE WHEN seen IS NULL THEN ceil({6.0 * _P!r} * tokens / (tflops * 1e12) * 1.08) ELSE ceil({6.0 * _P!r} * tokens / (seen * 1e12)) END) AS BIGINT) AS seconds, CASE WHEN seen IS NULL THEN 'catalog' ELSE 'observed-runs' END AS estimate FROM r WHERE required <= memory - memory // 10""")
def forecast_calibrated(spark, sf):
    """The same with the throughput of observed runs where there are any."""
    f = training.forecast(table(spark, sf, "planned_stages"), _SHAPE, _calibrations(spark, sf))
    return f.select("device", "gpus", "required", F.round("tflops", 3).alias("tflops"), "seconds", "estimate")


@query("""SELECT i AS step, round(CASE WHEN i < 100 THEN (i + 1) / 100.0 ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * (i - 100) / 900.0)) END, 6) AS rate FROM range(1000) t(i)""")
def cosine_schedule(spark, sf):
    """Learning rates of 1,000 steps."""
    return training.cosine_schedule(spark, 1000, 100).select("step", F.round("rate", 6).alias("rate"))


_TELEMETRY = "SELECT event_type AS run_id, ts AS observed, CASE WHEN event_id % 3 > 0 THEN value END AS loss, CASE WHEN event_id % 5 = 0 THEN value END AS heldout_loss, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id FROM events"


def _telemetry(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_type").alias("run_id"), F.col("ts").alias("observed"), F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("loss"), F.when(F.col("event_id") % 5 == 0, F.col("value")).alias("heldout_loss"), "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), "event_id")


@query(f"""SELECT run_id, {', '.join(f'last({c} ORDER BY observed, event_id) FILTER ({c} IS NOT NULL) AS {c}' for c in ('loss', 'heldout_loss', 'user_id', 'k'))} FROM ({_TELEMETRY}) GROUP BY run_id""")
def telemetry_latest(spark, sf):
    """The latest value of every field of every run's telemetry."""
    return selection.latest_values(_telemetry(spark, sf), ["run_id"], ["loss", "heldout_loss", "user_id", "k"], ["observed", "event_id"])


@query(f"""WITH g AS (SELECT run_id, first(heldout_loss ORDER BY observed) FILTER (heldout_loss IS NOT NULL) AS a, last(heldout_loss ORDER BY observed) FILTER (heldout_loss IS NOT NULL) AS z, max(observed) AS observed FROM ({_TELEMETRY}) GROUP BY run_id),
r AS (SELECT run_id, a, z, observed, CASE length(run_id) % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'complete' WHEN 2 THEN 'failed' ELSE 'planned' END AS state, CASE WHEN a > 0 THEN z / a - 1 END AS change FROM g)
SELECT run_id, state, a AS first, z AS latest, round(change, 9) AS change, CASE WHEN change > 0.25 THEN 'stop' WHEN state = 'running' AND (change > 0.05 OR observed + INTERVAL 10 MINUTE < TIMESTAMP '2024-01-03') THEN 'inspect' WHEN state = 'running' THEN 'let-run' WHEN state = 'complete' THEN 'complete' WHEN state = 'failed' THEN 'fix' ELSE 'wait' END AS advice FROM r""")
def run_advice(spark, sf):
    """What is advised for every run (one for each kind of event)."""
    t = _telemetry(spark, sf)
    n = F.length("run_id") % 4
    runs = t.select("run_id").distinct().withColumn("state", F.when(n == 0, "running").when(n == 1, "complete").when(n == 2, "failed").otherwise("planned"))
    return selection.run_advice(t, runs, F.lit("2024-01-03").cast("timestamp")).select("run_id", "state", "first", "latest", F.round("change", 9).alias("change"), "advice")


_PREFIX = "sum(n) OVER (ORDER BY o, row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n"


@query(f"""WITH u AS (SELECT min(shard_id) AS shard_id, sha256(unhex('2A00000000000000') || encode(sha256)) AS o FROM shards GROUP BY sha256), t AS (SELECT shard_id, row_no, strlen(text) AS n, text, o FROM text_rows JOIN u USING (shard_id) WHERE strlen(text) > 0),
b AS (SELECT *, {_PREFIX} AS before FROM t), c AS (SELECT * FROM b WHERE before < 100000),
x AS (SELECT *, CASE WHEN n <= 100000 - before THEN n ELSE list_max([strlen(left(text, i)) FOR i IN range(0, length(text) + 1) IF strlen(left(text, i)) <= 100000 - before]) END AS take FROM (SELECT shard_id, row_no, n, before, CASE WHEN n > 100000 - before THEN text ELSE '' END AS text FROM c))
SELECT shard_id AS shard, row_no AS "row", CAST(take AS BIGINT) AS take, n > 100000 - before AS cut FROM x WHERE take > 0""")
def calibration_sample(spark, sf):
    """Rows of the shards in a seeded order until 100,000 bytes are taken, the last cut at a whole character."""
    rows = _rows(spark, sf).select(F.col("shard_id").alias("shard"), F.col("row_no").alias("row"), "text")
    return training.calibration_sample(rows, _shards(spark, sf).select(F.col("shard_id").alias("shard"), "sha256"), 100_000, 42)


@query(f"""WITH h AS (SELECT row_id, row_number() OVER (ORDER BY row_id) AS n FROM {_HELD}), k AS (SELECT row_id, row_number() OVER (ORDER BY row_id) AS n FROM text_rows WHERE row_id NOT IN (SELECT row_id FROM h)),
o AS (SELECT row_id, n AS place, 'evaluation_record' AS kind FROM h UNION ALL SELECT row_id, n + (SELECT count(*) FROM h), 'record' FROM k)
SELECT o.place, sha256('{{"type":"' || kind || '","id":"' || row_id || '","corpus":"' || source || '","tokens":[') AS head, strlen(text) AS tokens FROM o JOIN text_rows USING (row_id)
 UNION ALL SELECT 0, sha256('{{"type":"begin"}}'), 0 UNION ALL SELECT count(*) + 1, sha256('{{"type":"end"}}'), 0 FROM text_rows""")
def worker_lines(spark, sf):
    """What a training worker reads, in its order: the lines' beginnings (as digests) and numbers of tokens."""
    r = _rows(spark, sf).select(F.col("row_id").cast("string").alias("id"), "row_id", F.col("source").alias("corpus"), "text")
    held = training.holdout(r.select("id", F.octet_length("text").cast("bigint").alias("size")), 42, 0.01, 256, 1 << 40).select("id")
    place = lambda df: training.prefix_sums(df.withColumn("_k", F.lit(1)).withColumn("_one", F.lit(1)), ["_k"], "row_id", "_one").withColumnRenamed("before", "place")
    lines = training.worker_lines(place(r.join(F.broadcast(held), "id", "left_anti")), place(r.join(F.broadcast(held), "id", "left_semi")))
    head = F.when(F.col("line").contains('"tokens":['), F.substring_index("line", '"tokens":[', 1)).otherwise(F.col("line"))
    marked = F.when(F.col("line").contains('"tokens":['), F.concat(head, F.lit('"tokens":['))).otherwise(head)
    inside = F.substring_index(F.substring_index("line", '"tokens":[', -1), "]", 1)
    n = F.when(F.col("line").contains('"tokens":[') & (inside != ""), F.length(inside) - F.length(F.replace(inside, F.lit(","))) + 1).otherwise(0)
    return lines.select("place", F.sha2(marked, 256).alias("head"), n.cast("bigint").alias("tokens"))


# Text functions over whole tables


@query("SELECT row_id, len(regexp_extract_all(text, '-----BEGIN (?:[A-Z0-9 ]+ )?PRIVATE KEY-----')) > 0 AS has_key FROM text_rows")
def private_key_flag(spark, sf):
    """Whether a text has the beginning of a private key."""
    return _rows(spark, sf).select("row_id", F.col("text").rlike("-----BEGIN (?:[A-Z0-9 ]+ )?PRIVATE KEY-----").alias("has_key"))


@query("SELECT source, count(*) AS records, CAST(sum(strlen(text)) AS BIGINT) AS octets, CAST(sum(length(text)) AS BIGINT) AS characters FROM text_rows GROUP BY source")
def octet_counts(spark, sf):
    """Bytes and characters of every source."""
    return _rows(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum(F.octet_length("text")).cast("bigint").alias("octets"), F.sum(F.length("text")).cast("bigint").alias("characters"))


@query("SELECT row_id FROM text_rows WHERE regexp_full_match(source, 'web/[^/]*-[0-9][^/]*\\.example') OR regexp_full_match(source, '[bg]o[^/]*/[^/]ar[^/]*')")
def source_glob(spark, sf):
    """Rows whose source matches shell patterns."""
    return _rows(spark, sf).where(policy.any_match(F.col("source"), ["web/*-[0-9]*.example", "[bg]o*/?ar*"])).select("row_id")


_PARAS = f"[y FOR y IN [trim(regexp_replace(x, '{T.WHITE}+', ' ', 'g')) FOR x IN regexp_split_to_array(regexp_replace(text, '^{T.WHITE}+|{T.WHITE}+$', '', 'g'), '\\n(?:[\\t\\x0B\\f\\r \\x{{85}}\\p{{Z}}]*\\n)+')] IF y <> '']"


@query(f"""WITH e AS (SELECT row_id, text, {_PARAS} AS e FROM text_rows) SELECT row_id, len(e) >= 4 AND ((len(e) - len(list_distinct(e))) / len(e) > 0.30
 OR (list_sum([strlen(x) FOR x IN e]) - list_sum([strlen(x) FOR x IN list_distinct(e)])) / strlen(text) > 0.20) AS boilerplate FROM e""")
def boilerplate_paragraphs(spark, sf):
    """The boilerplate flag by paragraphs."""
    return _rows(spark, sf).select("row_id", T.is_boilerplate(F.col("text"), True).alias("boilerplate"))


@query("SELECT doc_id, CAST(strlen(q) + strlen(a) + 19 AS BIGINT) AS mask, CAST(strlen(a) + 1 AS BIGINT) AS supervised FROM (SELECT doc_id, source AS q, text AS a FROM documents WHERE trim(text) <> '')")
def loss_mask_bytes(spark, sf):
    """Length and supervised places of the loss mask of dialogues."""
    one = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"), F.lit(None).cast("string").alias("context"))
    d = table(spark, sf, "documents").where(F.trim("text") != "").select("doc_id", F.array(one("user", "source"), one("assistant", "text")).alias("messages"))
    m = d.select("doc_id", T.byte_mask(F.col("messages"), "user-assistant-v1").alias("m"))
    return m.select("doc_id", F.size("m").cast("bigint").alias("mask"), F.size(F.filter("m", lambda x: x)).cast("bigint").alias("supervised"))


def queries() -> dict:
    """All queries by name."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Their SQL."""
    return dict(SQL)
