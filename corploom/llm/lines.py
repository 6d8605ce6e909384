"""Lines repeated across the documents of one source: distributed PrefixSpan over sequences of line identifiers.

A document is the sequence of its lines' identifiers (a hash of their letters), support the number of distinct
documents of the source. The frequent lines are found over all sources at once, as an aggregation with map-side sums.
Every document keeps the places at which frequent sequences start (its projections). Sources with few places are grown to
the end by one task each; a source with many, which may hold a third of all rows, is grown level by level, every level an
aggregation over all its documents, until its places are few or none. A place whose sequence cannot be grown, to either
side, is done: the lines of that sequence are deleted. There is no longest sequence.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import HEAVY, semi_join

#: Distinct documents of a source from which a line or sequence is repeated excessively.
SUPPORT = 6

#: Places of frequent sequences up to which a source is finished by one task; they are counted first.
LOCAL = 2_000_000


def letters(line):
    """The letters of a line in lower case, everything else dropped."""
    return F.lower(F.regexp_replace(line, r"[^\p{L}]+", ""))


def letters_of_text(text):
    """letters() of every line of a text at once: line feeds stay."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\n]+", ""))


def sequences(rows: DataFrame) -> DataFrame:
    """row_id, source, w and k: the lines with letters of every row in order, as (no, id); w is 1 for the first row of each document.

    Rows delivered again (same source and digest) have w 0: their lines are deleted, too, but do not count. Only the
    ids of repeated digests are shuffled, not the texts. A null digest is a document of its own. Rows with a null text
    or source have no sequence.
    """
    rows = rows.where("text is not null and source is not null")
    seen = rows.where("content_sha256 is not null").groupBy("source", "content_sha256").agg(F.min("row_id").alias("first"), F.count(F.lit(1)).alias("n"))
    again = seen.where("n > 1").select("source", "content_sha256", "first")
    plain = F.split(letters_of_text(F.col("text")), "\n", -1)
    known = F.filter(F.transform(plain, lambda x, i: F.struct(i.alias("no"), F.when(x != "", F.xxhash64(x, F.lit(0))).alias("id"))), lambda e: e["id"].isNotNull())
    each = rows.select("row_id", "source", "content_sha256", known.alias("k")).join(again, ["source", "content_sha256"], "left")
    return each.select("row_id", "source", F.when(F.col("first").isNull() | (F.col("first") == F.col("row_id")), 1).otherwise(0).alias("w"), "k")


def frequent_lines(docs: DataFrame, support: int = SUPPORT) -> DataFrame:
    """source, id, docs: the sequences of one line."""
    items = docs.where("w = 1").select("source", F.explode(F.array_distinct(F.transform("k", lambda e: e["id"]))).alias("id"))
    return items.groupBy("source", "id").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= support)


_FINISHED = {
    "counts": ("source string, length int, h long, docs long", [("source", pa.string()), ("length", pa.int32()), ("h", pa.int64()), ("docs", pa.int64())]),
    "spans": ("row_id long, first int, length int, lines array<int>", [("row_id", pa.int64()), ("first", pa.int32()), ("length", pa.int32()), ("lines", pa.list_(pa.int32()))]),
}


def _finish(table: pa.Table, support: int, what: str) -> pa.Table:
    """Grows the sequences of one source to their end, from the places where those of length n start.

    table: source, row_id, w, no and id (arrays over a document's frequent lines), at and h (arrays over its places), n.
    Gives the counts of all longer sequences, or the spans that cannot be grown.
    """
    flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    sizes = lambda c: np.diff(np.asarray(table.column(c).combine_chunks().offsets))
    n = table.column("n")[0].as_py()
    row, w = table.column("row_id").to_numpy(), table.column("w").to_numpy()
    no, ids, length = flat("no"), flat("id"), sizes("no")
    begin = np.concatenate([[0], np.cumsum(length)])
    doc = np.repeat(np.arange(len(row)), sizes("at"))
    place, h = begin[doc] + flat("at"), flat("h")
    out: list[tuple] = []
    while len(place):
        # a place grows if the sequence that starts one further on is frequent, too, in the same document
        grows = np.zeros(len(place), bool)
        grows[:-1] = (place[1:] == place[:-1] + 1) & (doc[1:] == doc[:-1])
        at = np.flatnonzero(grows)
        pair, label = np.unique(np.stack([h[at], ids[place[at] + n]]), axis=1, return_inverse=True)
        label = label.ravel()
        once = np.unique(np.stack([label, doc[at]])[:, w[doc[at]] == 1], axis=1)
        docs = np.bincount(once[0], minlength=pair.shape[1])
        kept = at[docs[label] >= support] if len(at) else at
        if what == "counts":
            frequent = np.flatnonzero(docs >= support)
            key = (pair[0] * np.int64(0x5851F42D4C957F2D)) ^ (pair[1] + np.int64(n)) if pair.shape[1] else np.zeros(0, np.int64)
            out.append((np.full(len(frequent), n + 1, np.int32), key[frequent], docs[frequent]))
        else:
            over = np.ones(len(place), bool)
            over[kept] = False
            over[kept + 1] = False
            out += [(row[doc[i]], no[place[i] : place[i] + n]) for i in np.flatnonzero(over)]
        if not len(kept):
            break
        # the labels are exact names of the sequences
        h = label[docs[label] >= support].astype(np.int64)
        place, doc, n = place[kept], doc[kept], n + 1
    kinds = _FINISHED[what][1]
    if what == "counts":
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        arrays = [pa.array([table.column("source")[0].as_py()] * len(columns[0]), pa.string()), *columns]
    else:
        offsets = np.concatenate([[0], np.cumsum([len(x) for _, x in out])]).astype(np.int32)
        lines = np.concatenate([x for _, x in out]).astype(np.int32) if out else np.zeros(0, np.int32)
        arrays = [np.array([r for r, _ in out], np.int64), lines[offsets[:-1]], np.diff(offsets), pa.ListArray.from_arrays(pa.array(offsets), pa.array(lines))]
    return pa.table([pa.array(x, t) if isinstance(x, np.ndarray) else x for x, (_, t) in zip(arrays, kinds)], names=[k for k, _ in kinds])


def _grow(docs: DataFrame, support: int, what: str, heavy: int = HEAVY, local: int = LOCAL) -> DataFrame:
    """The counts of all frequent sequences, or the spans that cannot be grown (what; see _FINISHED).

    The frequent lines of a document are its first projection, so what stands between them does not separate them. A
    source whose places are at most ``local`` is finished by one task; the others are grown by one level, as
    aggregations and joins over all of them, and are counted again. live are the places where a frequent sequence of the
    level's length starts, with its hash.
    """
    from ..session import checkpoint

    docs = checkpoint(docs.withColumn("doc", F.monotonically_increasing_id()))
    level = checkpoint(frequent_lines(docs, support))
    each = docs.select("doc", "source", F.explode("k").alias("e")).select("doc", "source", "e.no", "e.id")
    kept = semi_join(each, level, ["source", "id"], "docs", heavy).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("no", "id"))).alias("k"))
    live = F.transform("k", lambda e, i: F.struct(i.alias("at"), e["id"].alias("h")))
    state = checkpoint(docs.select("doc", "row_id", "source", "w").join(kept, "doc").withColumn("live", live))
    schema = _FINISHED[what][0]
    parts = [level.select("source", F.lit(1).alias("length"), F.col("id").alias("h"), "docs")] if what == "counts" else []
    n = 1
    while True:
        sizes = checkpoint(state.groupBy("source").agg(F.sum(F.size("live")).alias("places")))
        large = sizes.where(F.col("places") > local).select("source")
        any_large = not large.isEmpty()
        small = state.join(large, "source", "left_anti") if any_large else state
        take = lambda c, f: F.transform(c, lambda e: e[f])
        part = small.select("source", "row_id", "w", take("k", "no").alias("no"), take("k", "id").alias("id"), take("live", "at").alias("at"), take("live", "h").alias("h"), F.lit(n).alias("n"))
        parts.append(part.groupBy("source").applyInArrow(lambda t: _finish(t, support, what), schema))
        if not any_large:
            break
        state = state.join(large, "source", "left_semi")
        n += 1
        grown = F.transform(F.filter("live", lambda e, i: F.get("live", i + 1)["at"] == e["at"] + 1), lambda e: F.struct(e["at"].alias("at"), F.xxhash64(e["h"], F.get("k", e["at"] + n - 1)["id"]).alias("h")))  # noqa: B023
        tried = state.withColumn("tried", grown)
        once = tried.where("w = 1").select("source", F.explode(F.array_distinct(F.transform("tried", lambda e: e["h"]))).alias("h"))
        counts = checkpoint(once.groupBy("source", "h").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= support))
        places = semi_join(tried.select("doc", "source", F.explode("tried").alias("e")).select("doc", "source", "e.at", "e.h"), counts, ["source", "h"], "docs", heavy)
        places = places.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("at", "h"))).alias("next"))
        starts = F.transform("next", lambda e: e["at"])
        stuck = F.filter(F.transform("live", lambda e: e["at"]), lambda a: F.col("next").isNull() | ~(F.array_contains(starts, a) | F.array_contains(starts, a - 1)))
        joined = checkpoint(state.join(places, "doc", "left").withColumn("over", stuck).withColumn("live", F.coalesce("next", F.array().cast("array<struct<at:int,h:bigint>>"))).drop("next"))
        if what == "counts":
            parts.append(counts.select("source", F.lit(n).alias("length"), "h", "docs"))
        else:
            # what is over at this level was frequent at the one before, with n - 1 lines
            over = joined.where("size(over) > 0").select("row_id", "k", F.explode("over").alias("at"))
            parts.append(over.select("row_id", F.get("k", F.col("at"))["no"].alias("first"), F.lit(n - 1).alias("length"), F.transform(F.slice("k", F.col("at") + 1, n - 1), lambda e: e["no"]).alias("lines")))
        state = joined.drop("over").where("size(live) > 0")
    return reduce(DataFrame.unionByName, parts)


def prefix_span(docs: DataFrame, support: int = SUPPORT, local: int = LOCAL) -> DataFrame:
    """source, length, h (a hash of the sequence), docs of every frequent sequence of every length. docs: sequences(rows).

    A sequence's lines follow one another among the frequent lines of a document; with any gaps allowed every subset of
    a menu would be a sequence of its own. The identifiers and hashes have 64 bits and are compared within a source.
    """
    return _grow(docs, support, "counts", local=local)


def spans(docs: DataFrame, support: int = SUPPORT, heavy: int = HEAVY, local: int = LOCAL) -> DataFrame:
    """row_id, first, length, lines: every occurrence of a frequent sequence that no longer frequent one holds, with its line numbers.

    Lines and sequences of ``heavy`` documents or more are looked up by broadcast; sources with more than ``local`` places
    are grown level by level.
    """
    return _grow(docs, support, "spans", heavy, local)


def repeated_lines(rows: DataFrame, support: int = SUPPORT) -> DataFrame:
    """row_id, line_no of every line of an occurrence of a frequent sequence of ``support`` or more distinct texts of its source.

    Lines are split at LF and numbered from 0; two are the same when their letters are. A line without letters, a
    null text and a null source are never cases. A line stands in a frequent sequence exactly if it is frequent itself,
    since the sequence of that line alone is one.
    """
    found = spans(sequences(rows), support).groupBy("row_id").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines"))
    return found.select("row_id", F.explode("lines").alias("line_no"))


def clean(rows: DataFrame, support: int = SUPPORT) -> DataFrame:
    """rows with the repeated lines deleted from text; boilerplate_content tells whether any was found; all rows stay.

    A null text stays null and has the flag false.
    """
    found = repeated_lines(rows, support).groupBy("row_id").agg(F.array_sort(F.collect_list("line_no")).alias("_gone"))
    both = rows.drop("_gone").join(found, "row_id", "left")
    gone = F.coalesce("_gone", F.array().cast("array<int>"))
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(gone, i))
    return both.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).withColumn("boilerplate_content", F.col("_gone").isNotNull()).drop("_gone")
