"""Tokens of text columns: ids (encode), numbers (count_tokens), totals by slice, and labels that disagree."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, counting

#: One worker's readers of vocabularies, by digest of the rank file and kind.
_WORKER: dict = {}


def _tool(kind: str, digest: str, raw: bytes, parts: np.ndarray | None):
    tool = _WORKER.get((kind, digest))
    if tool is None:
        ranks = bpe.parse_ranks(raw)
        splitter = _WORKER.setdefault("splitter", bpe.Splitter())
        tool = bpe.Encoder(ranks, splitter) if kind == "encode" else counting.LongestCounter(ranks, splitter) if kind == "longest" else counting.MergeCounter(ranks, parts, splitter)
        _WORKER[kind, digest] = tool
    return tool


def _texts(column: pa.Array, start: int, stop: int) -> list[str | None]:
    return column.slice(start, stop - start).to_pylist()


def _append(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])


def _attach(df: DataFrame, out: str, kind: T.DataType, make) -> DataFrame:
    """df with the column out, which make(batch iterator) appends; a column of that name is replaced."""
    kept = df.drop(out)
    return kept.mapInArrow(make, T.StructType([*kept.schema.fields, T.StructField(out, kind)]))


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """df with the token ids of ``text`` (array<int>) under the rank file at ``path``; no special tokens.

    An empty text has no ids (an empty array), a null text has null; strings that look like special tokens are
    ordinary text. Whole texts of any length are encoded. Other columns stay; a column named ``out`` is replaced.
    """
    raw = bpe.read_ranks(path)
    shared, digest = df.sparkSession.sparkContext.broadcast(raw), hashlib.sha256(raw).hexdigest()

    def make(batches):
        encoder = _tool("encode", digest, shared.value, None)
        for batch in batches:
            column = batch.column(batch.schema.names.index(text))
            for start, stop in _ranges(column):
                yield _append(batch.slice(start, stop - start), out, bpe.id_lists(encoder, _texts(column, start, stop)))

    return _attach(df, out, T.ArrayType(T.IntegerType()), make)


def _ranges(column: pa.Array, limit: int = 4 * bpe.BLOCK_CHARS):
    """Ranges of rows whose texts have about ``limit`` bytes together."""
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        stop = min(stop, len(column))
        yield start, stop
        start = stop


def count_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", path: str | None = None, drop_text: bool = True, longest: bool = False) -> DataFrame:
    """df with the exact number of tokens of ``text`` (bigint) under the rank file at ``path``.

    ``longest``: the file's tokens are a longest-match vocabulary, and of each pre-token the longest token at the front
    is cut off again and again; else they are merges by rank.

    A null text has null, an empty text 0. The text itself is dropped unless ``drop_text`` is false, so that only
    the other columns travel back. A column named ``out`` is replaced.
    """
    raw = bpe.read_ranks(path)
    sc = df.sparkSession.sparkContext
    digest = hashlib.sha256(raw).hexdigest()
    shared = sc.broadcast((raw, None if longest else counting.derivations(bpe.parse_ranks(raw))))
    kept = df.drop(out)
    fields = [f for f in kept.schema.fields if not (drop_text and f.name == text)]

    def make(batches):
        counter = _tool("longest" if longest else "count", digest, *shared.value)
        for batch in batches:
            column = batch.column(batch.schema.names.index(text))
            for start, stop in _ranges(column):
                texts = _texts(column, start, stop)
                filled = [t or "" for t in texts]
                n = np.concatenate([counter.counts(filled[a:b]) for a, b in bpe.blocks(filled)])
                part = batch.slice(start, stop - start)
                part = part.select([f.name for f in fields])
                yield _append(part, out, pa.array(n, pa.int64(), mask=np.fromiter((t is None for t in texts), bool, len(texts))))

    return kept.mapInArrow(make, T.StructType([*fields, T.StructField(out, T.LongType())]))


def language_name(c):
    """A language label in one spelling: lower case, no region, two letters; null for blank and undetermined labels."""
    base = F.split(F.lower(F.trim(c)), "[-_]").getItem(0)
    two = F.create_map(*[F.lit(x) for pair in THREE_LETTERS.items() for x in pair])
    base = F.coalesce(two[base], base)
    return F.when(base.isin("", *NO_LANGUAGE), None).otherwise(base)


#: Three-letter codes (bibliographic and terminological) and their two-letter codes.
THREE_LETTERS = {
    "eng": "en", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "spa": "es", "por": "pt", "nld": "nl", "dut": "nl",
    "ita": "it", "swe": "sv",
}

#: Labels that name no single language.
NO_LANGUAGE = ("und", "mul", "mis", "zxx", "unknown", "none", "null", "n/a", "xx")


def domain_of(meta):
    """The host of the url in a JSON meta text: lower case, without port and leading www.; null if it cannot be read."""
    host = F.regexp_extract(F.get_json_object(meta, "$.url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?(\[[^\]]*\]|[^/:?#]+)", 1)
    host = F.regexp_replace(F.lower(host), r"^www\.", "")
    return F.when(host == "", None).otherwise(host)


def token_totals(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Documents and tokens of rows (text, source, language, meta) by source, language and domain.

    Columns: slice (source, language, domain or all), name (null where the label is missing or unreadable), docs,
    tokens. Null texts count as documents with 0 tokens. An empty table gives no rows.
    """
    picked = rows.select("text", "source", language_name(F.col("language")).alias("language"), domain_of(F.col("meta")).alias("domain"))
    counted = count_tokens(picked, path=path)
    whole = counted.groupBy("source", "language", "domain").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.coalesce("n_tokens", F.lit(0))).alias("tokens"))
    slices = F.array(*[F.struct(F.lit(k).alias("slice"), (F.col(k) if k != "all" else F.lit(None).cast("string")).alias("name")) for k in ("source", "language", "domain", "all")])
    return whole.select(F.explode(slices).alias("s"), "docs", "tokens").groupBy("s.slice", "s.name").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


def wrong_counts(rows: DataFrame, factor: int = 5, path: str | None = None) -> DataFrame:
    """row_id of rows whose token_count is null or off by more than ``factor`` either way; a null text has 0 tokens."""
    counted = count_tokens(rows.select("row_id", "text", "token_count"), path=path)
    n, said = F.coalesce("n_tokens", F.lit(0)), F.col("token_count")
    return counted.where(said.isNull() | (said > factor * n) | (said * factor < n)).select("row_id")
