"""The main body of web pages: a site style tree whose unimportant branches are removed.

The pages of a host are merged into one tree: host, presentation (whole lines; the parts of lines that are joined by
separators), content. A content node that stands on many pages of its host, or on many hosts, has a low importance,
1 - log(pages) / log(all pages) (one minus the entropy of an even spread).

What a node is for is learnt from where it stands, over all pages; there are no word lists. A low node that mostly
stands just below titles belongs to the head of a page (a byline, a date line) and stays there. A low node that is
mostly followed by lines of their own that are no sentences is the heading of a list; the list below it goes with it.
A beginning of lines (their first two words) that many hosts have, never as a title or a sentence and spread over the
page, is that of a link: the lines differ, but their presentation node holds no content of the page.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import HEAVY, semi_join
from ..session import checkpoint
from .lines import letters

#: Importance up to which a node is removed, and pages (or hosts) that it must at least stand on.
IMPORTANCE, LEAST = 0.75, 3

#: Importance up to which a node with the letters of a sentence is removed if it stands on one host only: a quotation recurs, too.
SENTENCE_IMPORTANCE, SENTENCE_LETTERS = 0.45, 45

#: What separates the parts of a line.
PARTS = r"\s*[·|/>–]\s*|\s{2,}|\s*:\s"

#: A cheap sign that a line may have parts.
SOME_PARTS = r"[·|/>–:]|\s\s"

#: Sources whose names are broadcast (some 60 bytes each); more are joined.
NAMES = 100_000

#: Lines below the title, before its first sentence, that are the head of a page, and the share of a node's places there from which it belongs to it.
HEAD, HEAD_SHARE = 3, 0.7

#: Share of a node's places with a line of its own below, beyond those with a title below, from which it is a heading of lists.
LIST_SHARE = 0.8

#: Of the lines with a beginning, shares of titles, of sentences and of lines in the head up to which it is that of links.
LINK_TITLE, LINK_SENTENCE, LINK_HEAD = 0.02, 0.1, 0.5

#: Learnt nodes up to which they are broadcast (8 bytes each); beyond that they are joined.
BROADCAST = 1_000_000

#: What lines are, as bits: a sentence's end, a letter at the start; the bits above count the signs of a trail (" > ").
ENDS, LETTER, TRAIL = 1, 2, 4

#: Share of low lines among those with a number of trail signs from which all lines of that shape are trails.
TRAIL_SHARE = 0.5

#: What the learnt nodes are.
IN_HEAD, HEADING, LINK, TRAILS = 0, 1, 2, 3


def _names(rows: DataFrame) -> DataFrame:
    """source, name: the name that most rows of a source have, its letters only, in lower case."""
    n = rows.where("source_name is not null").groupBy("source", letters(F.col("source_name")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("source").agg(F.max_by("name", F.struct("n", "name")).alias("name")).where("name <> ''")


def nodes(pages: DataFrame) -> DataFrame:
    """The nodes of every page, one row a page: row_id, site (a hash of the source), arrays over its lines, and contents; the site's name left out.

    Over the lines that are not blank: no, key (a hash of the letters, 0 without letters), lead (of the first two words),
    flags, and parts (keys of the parts of a line with separators). contents: the different keys with the number of
    their letters.
    """
    names = checkpoint(_names(pages))
    names = F.broadcast(names) if names.count() <= NAMES else names
    named = pages.join(names, "source", "left").select("row_id", F.xxhash64("source").alias("site"), F.lower("text").alias("t"), F.coalesce("name", F.lit("")).alias("name"))
    blank = F.lit(" \t\r\x0b\x0c\u00a0")
    split = F.filter(F.transform(F.split("t", "\n", -1), lambda x, i: F.struct(i.alias("no"), F.trim(x, blank).alias("x"))), lambda e: e["x"] != "")
    bare = lambda x: F.replace(F.regexp_replace(x, r"[^\p{L}]+", ""), F.col("name"))

    def known(e):
        x = e["x"]
        parts = F.when(x.rlike(SOME_PARTS), F.filter(F.split(x, PARTS), lambda p: p.rlike(r"\p{L}")))
        flags = F.when(x.rlike(r"[.!?;,][\s•»›—*…|·«‹]*$"), ENDS).otherwise(0) + F.when(x.rlike(r"^\p{L}"), LETTER).otherwise(0) + F.when(x.contains(" > "), (F.size(F.split(x, r"\s>\s")) - 1) * TRAIL).otherwise(0)
        return F.struct(e["no"].alias("no"), bare(x).alias("l"), F.xxhash64(F.regexp_replace(F.regexp_extract(x, r"^[^\p{L}]*\p{L}+(?:[^\p{L}]+\p{L}+)?", 0), r"[^\p{L}]+", " ")).alias("lead"), flags.alias("flags"), parts.alias("p"))

    def keyed(e):
        node = lambda l: F.struct(F.when(l == "", F.lit(0).cast("long")).otherwise(F.xxhash64(l)).alias("key"), F.length(l).alias("letters"))  # noqa: E731, E741
        return F.struct(e["no"].alias("no"), node(e["l"]).alias("whole"), e["lead"].alias("lead"), e["flags"].alias("flags"), F.when(F.size(e["p"]) > 1, F.transform(F.transform(e["p"], bare), node)).otherwise(F.array().cast("array<struct<key:bigint,letters:int>>")).alias("p"))

    each = named.select("row_id", "site", "name", F.transform(split, known).alias("s"))
    each = each.select("row_id", "site", F.transform("s", keyed).alias("s"))
    contents = F.filter(F.array_distinct(F.flatten(F.transform("s", lambda e: F.concat(F.array(e["whole"]), e["p"])))), lambda c: c["key"] != 0)
    take = lambda f: F.transform("s", f)
    return each.select(
        "row_id", "site", take(lambda e: e["no"]).alias("no"), take(lambda e: e["whole"]["key"]).alias("key"), take(lambda e: e["lead"]).alias("lead"), take(lambda e: e["flags"]).alias("flags"),
        take(lambda e: F.transform(e["p"], lambda p: p["key"])).alias("parts"), contents.alias("contents"),
    )


def again(rows: DataFrame) -> DataFrame:
    """row_id of rows delivered again: their source and digest stand in an earlier row. Rows with a null digest are none."""
    ids = rows.where("content_sha256 is not null").select("row_id", "source", "content_sha256")
    seen = ids.groupBy("source", "content_sha256").agg(F.min("row_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return ids.join(seen, ["source", "content_sha256"]).where("row_id <> first").select("row_id")


def unimportant(pages: DataFrame, every: DataFrame, importance: float = IMPORTANCE, least: int = LEAST) -> DataFrame:
    """site, key, n (pages) of the unimportant nodes of the site style trees, by host or over all hosts. every: nodes(pages). Texts delivered again count once."""
    skip = again(pages)
    contents = every.select("row_id", "site", "contents").join(skip, "row_id", "left_anti").select("site", F.explode("contents").alias("c")).select("site", "c.key", "c.letters")
    counts = contents.groupBy("site", "key").agg(F.count(F.lit(1)).alias("n"), F.max("letters").alias("letters"))
    size = pages.join(skip, "row_id", "left_anti").groupBy(F.xxhash64("source").alias("site")).agg(F.count(F.lit(1)).alias("m"))
    hosts = size.count()  # one number
    value = lambda n, m: 1 - F.log(n) / F.log(F.greatest(m, F.lit(2)))
    most = F.when(F.col("letters") >= SENTENCE_LETTERS, min(SENTENCE_IMPORTANCE, importance)).otherwise(importance)
    everywhere = counts.groupBy("key").agg(F.count(F.lit(1)).alias("h")).where((F.col("h") >= least) & (value(F.col("h"), F.lit(hosts)) <= importance)).select("key", F.lit(True).alias("_all"))
    by_host = (F.col("n") >= least) & (value(F.col("n"), F.col("m")) <= most)
    return counts.join(size, "site").join(everywhere, "key", "left").where(by_host | F.col("_all")).select("site", "key", "n")


def _columns(batch, names):
    """The list columns of a batch, flattened, and the row of each element."""
    first = batch.column(batch.schema.names.index(names[0]))
    sizes = np.diff(np.asarray(first.offsets))
    return [batch.column(batch.schema.names.index(n)).flatten().to_numpy(zero_copy_only=False) for n in names], np.repeat(np.arange(batch.num_rows), sizes), sizes


def _mark(every: DataFrame, low: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """row_id, site and the lines of every page (no, key, lead, flags), low if their content is unimportant: the whole line, or enough of its parts.

    Of a trail as many parts as it has signs (the last may be the title), of other lines seven in ten of three or more, or all.
    """
    lows = F.array_sort(F.collect_list("key"))
    marks = every.select("row_id", "site", F.explode("contents.key").alias("key"))
    marks = semi_join(marks, low, ["site", "key"], "n", heavy).groupBy("row_id").agg(lows.alias("lows"))
    lines = every.select("row_id", "site", "no", "key", "lead", "flags", "parts").join(marks, "row_id", "left")
    is_low = lambda k: F.array_contains("lows", k)
    hit = F.transform("parts", lambda p: F.struct(F.size(p).alias("n"), F.size(F.filter(p, is_low)).alias("m")))
    enough = F.zip_with(hit, "flags", lambda h, f: (h["n"] > 1) & (h["m"] > 0) & F.when(f >= TRAIL, h["m"] >= F.shiftright(f, 2)).otherwise((h["m"] == h["n"]) | ((h["n"] >= 3) & (h["m"] >= 0.7 * h["n"]))))
    both = F.when(F.col("lows").isNull(), F.transform("no", lambda x: F.lit(False))).otherwise(F.zip_with(F.transform("key", is_low), enough, lambda a, b: a | b))
    return lines.select("row_id", "site", "no", "key", "lead", "flags", both.alias("low"))


def _places(row, low, ends):
    """Of every line: whether it is the title of its page (the first line that is not low and no sentence), and whether it is in the head below it, before its first sentence."""
    n = len(row)
    order = np.arange(n)
    own = np.flatnonzero(~low & ~ends)
    title = np.zeros(n, bool)
    if len(own):
        title[own[np.r_[True, row[own][1:] != row[own][:-1]]]] = True
    last = np.maximum.accumulate(np.where(title, order, -1))
    far = order - last
    head = (last >= 0) & (far > 0) & (far <= HEAD)
    said = np.cumsum(~low & ends)
    head[head] = (row[last[head]] == row[head]) & (said[last[head]] == said[head])
    return title, head


def signs(state: DataFrame, least: int = LEAST) -> DataFrame:
    """kind, key of the nodes whose purpose their places tell: IN_HEAD and HEADING (keys of low lines), LINK (leads of other lines), TRAILS (numbers of signs).

    Places are counted within each batch first, then over all pages.
    """

    def count(batches):
        for batch in batches:
            (no, key, lead, flags, low), row, _ = _columns(batch, ["no", "key", "lead", "flags", "low"])
            site = batch.column(batch.schema.names.index("site")).to_numpy(zero_copy_only=False)
            if not len(row):
                continue
            low = low.astype(bool)
            ends = flags & ENDS > 0
            title, head = _places(row, low, ends)
            below = np.zeros(len(row), bool)
            below[:-1] = (row[1:] == row[:-1]) & (no[1:] == no[:-1] + 1)
            after = lambda x: below & np.r_[x[1:], False]
            listed, titled = after(~low & ~ends), after(title)
            signs_of = (flags // TRAIL).astype(np.int64)
            for kind, at, what, a, b, c in (
                (IN_HEAD, low & (key != 0), key, head, listed, titled),
                (LINK, ~low & (flags & LETTER > 0), lead, title, ends, head),
                (TRAILS, (signs_of > 0) & (flags & LETTER > 0), signs_of, low, ends, head),
            ):
                where = np.flatnonzero(at)
                if not len(where):
                    continue
                of = site[row[where]] if kind != IN_HEAD else np.zeros(len(where), np.int64)
                pairs, back = np.unique(np.stack([what[where], of]), axis=1, return_inverse=True)
                back = back.ravel()
                sums = [np.bincount(back, x[where]).astype(np.int64) for x in (a, b, c)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(pairs.shape[1], kind, np.int32)), pa.array(pairs[0]), pa.array(pairs[1]), pa.array(np.bincount(back)), *map(pa.array, sums)], names=["kind", "key", "site", "n", "a", "b", "c"])

    counted = state.select("site", "no", "key", "lead", "flags", "low").mapInArrow(count, "kind int, key bigint, site bigint, n bigint, a bigint, b bigint, c bigint")
    sums = [F.sum(x).alias(x) for x in "nabc"]
    by_site = counted.groupBy("kind", "key", "site").agg(*sums)
    total = by_site.groupBy("kind", "key").agg(*sums, F.count(F.lit(1)).alias("sites")).where(F.col("n") >= least)
    n, a, b, c = (F.col(x) for x in "nabc")
    low, other = F.col("kind") == IN_HEAD, F.col("kind") == LINK
    kinds = F.array(
        F.when(low & (a >= HEAD_SHARE * n), IN_HEAD),
        F.when(low & (b - c >= LIST_SHARE * n), HEADING),
        # of few lines none need be a title by chance: the rate counts with one more
        F.when(other & (F.col("sites") >= least) & (a + 1 < LINK_TITLE * (n + 2)) & (b <= LINK_SENTENCE * n) & (c <= LINK_HEAD * n), LINK),
        F.when((F.col("kind") == TRAILS) & (F.col("sites") >= least) & (a >= TRAIL_SHARE * n), TRAILS),
    )
    return total.select(F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"), "key")


def _furniture(no, row, flags, low, in_head, heading, link, trail):
    """Whether each line is furniture. in_head, heading, link and trail tell of what learnt kind its node is."""
    low = low | trail
    ends = flags & ENDS > 0
    _, head = _places(row, low, ends)
    out = (low & ~(in_head & head)) | (link & ~low & ~ends)
    for i in np.flatnonzero(heading & out):
        # the list below a heading: lines that follow at once, are no sentences and no furniture of their own
        j = i + 1
        while j < len(row) and row[j] == row[i] and no[j] == no[j - 1] + 1 and not ends[j] and not out[j] and not (in_head[j] and head[j]):
            out[j] = True
            j += 1
    return out


def furniture(rows: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """row_id, lines (array of line numbers) of every page of a web source that has furniture.

    Rows of other sources, null sources and null texts have none. Lines are split at LF and numbered from 0; blank
    lines are never cases. Lines may be of any length. The text is read once and never shuffled; ``broadcast`` bounds
    the number of learnt nodes sent to every task, beyond it they are joined.
    """
    pages = rows.where("source like 'web/%' and text is not null").select("row_id", "source", "source_name", "content_sha256", "text")
    every = checkpoint(nodes(pages))
    state = checkpoint(_mark(every, checkpoint(unimportant(pages, every))))
    known = checkpoint(signs(state))
    names = ["no", "key", "lead", "flags", "low"]
    if known.count() <= broadcast:
        found = known.toPandas()
        sets = state.sparkSession.sparkContext.broadcast([np.sort(found["key"].to_numpy(np.int64)[found["kind"].to_numpy() == k]) for k in (IN_HEAD, HEADING, LINK, TRAILS)])
        joined = state
    else:
        kinds = F.concat(F.transform("key", lambda k: F.struct(F.lit(IN_HEAD).alias("kind"), k.alias("key"))), F.transform("key", lambda k: F.struct(F.lit(HEADING).alias("kind"), k.alias("key"))), F.transform("lead", lambda k: F.struct(F.lit(LINK).alias("kind"), k.alias("key"))), F.transform("flags", lambda f: F.struct(F.lit(TRAILS).alias("kind"), F.shiftright(f, 2).cast("long").alias("key"))))
        each = state.select("row_id", F.explode(F.array_distinct(kinds)).alias("e")).select("row_id", "e.kind", "e.key").join(known, ["kind", "key"]).groupBy("row_id").agg(F.collect_set(F.struct("kind", "key")).alias("known"))
        joined, sets = state.join(each, "row_id", "left"), None

    def member(x, sorted_keys):
        if not len(sorted_keys):
            return np.zeros(len(x), bool)
        at = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
        return sorted_keys[at] == x

    def make(batches):
        for batch in batches:
            (no, key, lead, flags, low), row, sizes = _columns(batch, names)
            if not len(row):
                continue
            low = low.astype(bool)
            values = (key, key, lead, (flags // TRAIL).astype(np.int64))
            if sets is not None:
                in_head, heading, link, trail = (member(x, s) for x, s in zip(values, sets.value))
            else:
                have = [{(g["kind"], g["key"]) for g in x or ()} for x in batch.column(batch.schema.names.index("known")).to_pylist()]
                in_head, heading, link, trail = (np.array([(k, v) in have[r] for v, r in zip(x.tolist(), row.tolist())], bool) for k, x in enumerate(values))
            out = np.flatnonzero(_furniture(no, row, flags, low, in_head & low, heading & low, link & (flags & LETTER > 0), trail & (flags & LETTER > 0)))
            offsets = np.searchsorted(row[out], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index("row_id")), pa.ListArray.from_arrays(pa.array(offsets), pa.array(no[out].astype(np.int32)))], names=["row_id", "lines"])

    return joined.mapInArrow(make, "row_id bigint, lines array<int>").where("size(lines) > 0")


def furniture_lines(rows: DataFrame) -> DataFrame:
    """row_id, line_no of every furniture line."""
    return furniture(rows).select("row_id", F.explode("lines").alias("line_no"))


def clean(rows: DataFrame) -> DataFrame:
    """rows with the furniture of web pages removed from text; main_content tells whether any line with letters is left.

    Rows of other sources keep their text, and have main_content true if it has letters; null texts have false.
    """
    both = rows.join(furniture(rows).withColumnRenamed("lines", "_gone"), "row_id", "left")
    gone = F.coalesce("_gone", F.array().cast("array<int>"))
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(gone, i)), "\n")
    both = both.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.trim(kept)))
    return both.withColumn("main_content", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).drop("_gone")
