"""Named queries of the training-text operators over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint, table
from . import language, lines, mainbody, mixing, packing, personal, subjects, tokens


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every occurrence of a line repeated excessively in its source."""
    return lines.repeated_lines(table(spark, sf, "text_rows"))


def p1_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Frequent sequences of lines: how many by source and length, and the greatest support."""
    found = lines.prefix_span(lines.sequences(table(spark, sf, "text_rows")))
    return found.groupBy("source", "length").agg(F.count(F.lit(1)).alias("sequences"), F.max("docs").alias("most_docs"))


def p1_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Every record without its repeated lines."""
    return lines.clean(table(spark, sf, "text_rows")).select("row_id", "text", "boilerplate_content")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose label is missing or wrong, and lines in another language."""
    return language.wrong_labels(table(spark, sf, "text_rows"))


def p2_languages(spark: SparkSession, sf: str) -> DataFrame:
    """Every document and every line in another language with its language and confidence."""
    rows = table(spark, sf, "text_rows")
    return language.identify(rows, language.train(rows))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every furniture line of web pages."""
    return mainbody.furniture_lines(table(spark, sf, "text_rows"))


def p3_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Every record with its body only."""
    return mainbody.clean(table(spark, sf, "text_rows")).select("row_id", "text", "main_content")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every personal item."""
    return personal.found(table(spark, sf, "text_rows"))


def p4_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Every record with placeholders for its personal items."""
    return personal.redact(table(spark, sf, "text_rows"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sources that cannot reach their share."""
    return mixing.short_sources(table(spark, sf, "text_rows"), table(spark, sf, "corpus_weights"), table(spark, sf, "planned_stages"))


def p6_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The mix of every stage."""
    return mixing.mix(table(spark, sf, "text_rows"), table(spark, sf, "corpus_weights"), table(spark, sf, "planned_stages"))


def p6_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual shares of the mix."""
    return mixing.mix_shares(p6_mix(spark, sf), table(spark, sf, "corpus_weights"), table(spark, sf, "planned_stages"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose token_count is missing or implausible."""
    return tokens.wrong_counts(table(spark, sf, "text_rows"))


def p7_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and tokens by source, language and domain."""
    return tokens.token_totals(table(spark, sf, "text_rows"))


def p7_longest(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of every text if the vocabulary is one of longest matches."""
    return tokens.count_tokens(table(spark, sf, "text_rows").select("row_id", "text"), longest=True)


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p9_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's place in the containers of every stage; a document without tokens has none (null container)."""
    sized = checkpoint(tokens.count_tokens(table(spark, sf, "documents").select("doc_id", "text")))
    # planned_stages has a fixed number of rows
    stages = sorted((r["name"], r["sequence_length"]) for r in table(spark, sf, "planned_stages").select("name", "sequence_length").collect())
    empty = sized.where(F.coalesce("n_tokens", F.lit(0)) == 0)
    none = F.lit(None).cast("long")
    with ThreadPoolExecutor(4) as pool:  # the stages do not hang on one another
        parts = list(pool.map(lambda s: packing.pack(sized, s[1]).withColumn("stage", F.lit(s[0])), stages))
    parts += [empty.select("doc_id", none.alias("piece"), none.alias("start"), F.lit(0).cast("long").alias("length"), none.alias("container"), F.lit(name).alias("stage")) for name, _ in stages]
    return reduce(DataFrame.unionByName, parts).select("stage", "doc_id", "piece", "start", "length", "container")


_LINES = """
WITH l AS (
  SELECT row_id, source, content_sha256, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS line_no
  FROM text_rows),
k AS (SELECT row_id, source, content_sha256, line_no, lower(regexp_replace(line, '[^\\p{L}]+', '', 'g')) AS k FROM l),
f AS (SELECT source, k FROM k WHERE k <> '' GROUP BY source, k HAVING count(DISTINCT content_sha256) >= 6)"""

P1_FOUND = f"{_LINES} SELECT row_id, CAST(line_no AS INTEGER) AS line_no FROM k JOIN f USING (source, k)"

P1_CLEAN = f"""{_LINES}, g AS (SELECT row_id, list(line_no) AS gone FROM k JOIN f USING (source, k) GROUP BY row_id)
SELECT t.row_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END AS text,
 gone IS NOT NULL AS boilerplate_content FROM text_rows t LEFT JOIN g USING (row_id)"""


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """The subject areas of every document."""
    return p10_subjects(spark, sf).select("doc_id", "subject")


def p10_subjects(spark: SparkSession, sf: str) -> DataFrame:
    """The subject areas of every document with posterior and share of sentences."""
    return subjects.assign(table(spark, sf, "documents"), table(spark, sf, "subject_labels"), table(spark, sf, "subjects"))


def p10_makeup(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and characters by corpus and subject."""
    return subjects.makeup(table(spark, sf, "documents"), p10_subjects(spark, sf))


def queries() -> dict:
    """All queries by name."""
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(v)}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express."""
    return {"p1_found": P1_FOUND, "p1_clean": P1_CLEAN}
