"""Subject areas of documents: labelling functions combined by a latent model that learns their accuracies.

Six labelling functions vote on what each sentence is about: single words and pairs of words by a lexicon, the section
it stands in, the title, addresses, and the source of the document. The lexicon is fitted on a bounded sample of
labelled documents. The ways of voting are few and are counted over all sentences of all documents;
expectation-maximisation on these counts learns how often each function names which area, and gives the posterior of
each way of voting. A document's areas are those that at least a quarter of its sentences about any area are about.
"""

from __future__ import annotations

import difflib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LETTER, SPACE, blocks, char_classes
from .sampling import sample as sample_rows, short

#: Labelled documents, about, from which the lexicon is fitted, chosen by a hash of doc_id over all labelled documents.
SAMPLE = 6000

#: Share of the sentences about any area from which an area is a case.
SHARE = 0.25

#: Hash bits of terms; what the share of a term in its best area is shrunk with, and must reach; documents it must be in.
BITS, SHRINK, PURE, LEAST_DOCS = 20, 2.0, 0.5, 2

#: Score from which a sentence is about an area, and its lead over the next area.
SCORE, LEAD = 1.0, 0.7

#: Rounds in which sentences are assigned anew and the lexicon is counted again.
ROUNDS = 4


class Terms:
    """Hashed words and pairs of words of texts, with their sentences."""

    def __init__(self):
        self.classes = char_classes()
        low = np.arange(0x110000, dtype=np.uint32)
        low[:0x3000] = [ord(c) if len(c := chr(i).lower()) == 1 else i for i in range(0x3000)]
        self.low = low
        power, p = [], 1
        for _ in range(64):
            power.append(p)
            p = p * 0x01000193 % (1 << 32)
        self.power = np.array(power, np.uint32)

    def of(self, texts: list[str]):
        """(terms, the sentence of each, the document of each sentence, whether a sentence is a heading). Words are runs of letters.

        The first ``self.words`` terms are single words, the others pairs.
        """
        whole = "\n".join(texts) + "\n"
        cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        cls = self.classes[cp]
        ends = np.cumsum([len(t) + 1 for t in texts])
        line = cp == 0x0A
        stop = ((cp == 0x2E) | (cp == 0x21) | (cp == 0x3F) | (cp == 0x3002))
        stop[:-1] &= cls[1:] == SPACE
        cut = line | stop
        sentence = np.cumsum(cut) - cut  # a stop belongs to its sentence
        at = np.flatnonzero(cut)
        # a heading is a whole line without a stop at its end
        before = np.concatenate([[True], line[at[:-1]]])
        heading = before & line[at]
        document = np.searchsorted(ends, at, "right")
        document = np.minimum(document, len(texts) - 1)
        document[line[at]] = np.searchsorted(ends - 1, at[line[at]], "left")
        letter = cls == LETTER
        begin = letter.copy()
        begin[1:] &= ~letter[:-1]
        starts = np.flatnonzero(begin)
        self.words = 0
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), document, heading
        where = np.flatnonzero(letter)
        word = np.cumsum(begin)[where] - 1
        place = np.minimum(where - starts[word], 63)
        value = (self.low[cp[where]] + np.uint32(1)) * self.power[place]
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        h = np.add.reduceat(value, first).astype(np.uint32)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        of = sentence[starts]
        self.words = len(h)
        mix = lambda x: ((x ^ (x >> np.uint32(13))) * np.uint32(0x297A2D39) >> np.uint32(32 - BITS)).astype(np.int64)
        same = of[1:] == of[:-1]
        pair = (h[:-1] * np.uint32(0x85EBCA6B) + h[1:])[same]
        return np.concatenate([mix(h), mix(pair)]), np.concatenate([of, of[1:][same]]), document, heading


def sentence_scores(terms: np.ndarray, of: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
    """The sum of the scores of each sentence's terms: (sentences, areas)."""
    hit = np.flatnonzero(table.any(axis=1)[terms])
    known, of = table[terms[hit]].astype(np.float32), of[hit]
    return np.stack([np.bincount(of, known[:, k], n) for k in range(table.shape[1])], axis=1).astype(np.float32)


def areas_of(scores: np.ndarray) -> np.ndarray:
    """The area of each sentence, -1 for none."""
    if not len(scores):
        return np.zeros(0, np.int64)
    order = np.sort(scores, axis=1)
    best = scores.argmax(axis=1)
    lead = order[:, -1] - (order[:, -2] if scores.shape[1] > 1 else 0)
    return np.where((order[:, -1] >= SCORE) & (lead >= LEAD), best, -1)


def subject_name(label: str | None, subjects: list[str], titles: list[str] | None = None) -> str | None:
    """The subject that a label in any spelling means: case, signs and slips are forgiven; None if it means none."""
    if label is None:
        return None
    plain = re.sub(r"[\W\d_]+", "", label.lower())
    names = {re.sub(r"[\W\d_]+", "", s.lower()): s for s in subjects} | {re.sub(r"[\W\d_]+", "", t.lower()): s for s, t in zip(subjects, titles or []) if t}
    if plain in names:
        return names[plain]
    near = difflib.get_close_matches(plain, names, 1, 0.75)
    return names[near[0]] if near else None


def fit(texts: list[str], labels: list[list[int]], areas: int, described: list[str] | None = None) -> np.ndarray:
    """The lexicon: scores (2**BITS, areas) as log-ratios, 0 for terms that are not of one area.

    labels: the areas each text was labelled with. described: a description of each area, counted as one of its texts.
    Sentences of texts with several or wrong labels are assigned anew by the lexicon found so far.
    """
    if described:
        texts, labels = texts + described, labels + [[k] for k in range(len(described))]
    kept = [(t, x) for t, x in zip(texts, labels) if t and x]
    if not kept:
        return np.zeros((1 << BITS, areas), np.float16)
    tool, parts, sentences = Terms(), [], 0
    for a, b in blocks([t for t, _ in kept]):
        x, y, z, _ = tool.of([t for t, _ in kept[a:b]])
        parts.append((x.astype(np.int32), (y + sentences).astype(np.int32), (z + a).astype(np.int32)))
        sentences += len(z)
    terms, of, document = (np.concatenate(c) for c in zip(*parts))
    del parts
    prior = np.zeros((len(kept), areas), np.float32)
    for d, (_, x) in enumerate(kept):
        for k in x:
            prior[d, k] += 1
    prior /= prior.sum(axis=1, keepdims=True)
    weight = prior[document]
    # a term counts once in a document, by the mean of its sentences there; terms of one document are left out at once
    uniq, inverse, times = np.unique(document[of].astype(np.int64) << BITS | terms, return_inverse=True, return_counts=True)
    inverse = inverse.astype(np.int32)
    docs = np.bincount(uniq & ((1 << BITS) - 1), None, 1 << BITS)
    common = docs[terms] >= LEAST_DOCS
    terms, of, inverse = terms[common], of[common], inverse[common]
    used, term = np.unique(uniq & ((1 << BITS) - 1), return_inverse=True)
    table = np.zeros((1 << BITS, areas), np.float16)
    for _ in range(ROUNDS):
        count = np.zeros((len(used), areas), np.float32)
        for k in range(areas):
            count[:, k] = np.bincount(term, np.bincount(inverse, weight[of, k], len(uniq)) / times, len(used))
        base = (count.sum(axis=0) + 1) / (count.sum() + areas)
        # areas of different size weigh the same
        even = count / (base * areas)
        purity = (even + SHRINK / areas) / (even.sum(axis=1, keepdims=True) + SHRINK)
        pure = (purity.max(axis=1) >= PURE) & (docs[used] >= LEAST_DOCS)
        table[:] = 0
        table[used[pure]] = np.maximum(np.log(purity[pure] * areas), -3)
        found = areas_of(sentence_scores(terms, of, len(document), table))
        weight = prior[document]
        weight[found >= 0] = np.eye(areas, dtype=np.float32)[found[found >= 0]]
    return table


def label_table(labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """doc_id, subject of the labels that mean a subject; each once. Spellings are few, so they are read one by one on the driver."""
    known = sorted((r["subject"], r["title"]) for r in subjects.collect())
    names, titles = [s for s, _ in known], [t for _, t in known]

    def plain(batches):
        seen: dict = {}
        for batch in batches:
            ids, given = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for g in set(given) - set(seen):
                seen[g] = subject_name(g, names, titles)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([seen[g] for g in given], pa.string())], names=["doc_id", "subject"])

    return labels.select("doc_id", "subject").mapInArrow(plain, "doc_id bigint, subject string").where("subject is not null").distinct()


def train(documents: DataFrame, labels: DataFrame, subjects: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """The subjects in order and the lexicon, from about ``sample`` labelled documents."""
    known = sorted((r["subject"], r["title"] or "", r["description"] or "") for r in subjects.collect())
    names = [s for s, *_ in known]
    each = label_table(labels, subjects).groupBy("doc_id").agg(F.collect_list("subject").alias("subjects"))
    picked = sample_rows(each, sample, "doc_id")
    got = documents.where(short()).select("doc_id", "text").join(F.broadcast(picked), "doc_id").toPandas().sort_values("doc_id")
    lists = [[names.index(s) for s in x] for x in got["subjects"]]
    return names, fit(got["text"].tolist(), lists, len(names), [f"{t}. {d}" for _, t, d in known])


_ADDRESS = re.compile(r"(?:https?://|www\.)\S+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
_TOOLS: list[Terms] = []

#: The labelling functions that read the text; source is added to them by document.
FUNCTIONS = ("words", "pairs", "section", "title", "address")

VOTES = "doc_id bigint, source string, patterns array<int>, counts array<int>"


def votes(documents: DataFrame, names: list[str], table: np.ndarray) -> DataFrame:
    """One row per document with text: VOTES, how many of its sentences the functions vote on in each way.

    Of every sentence each function names an area or none. words and pairs: by the lexicon of single words and of pairs
    of words; section: what the last heading above it is about; title: what the document's first line is about, if that
    is a heading; address: an area named in a link or mail address of the document. A pattern has one digit for each
    function, to the base of one more than the areas, 0 for no vote. Documents with null or blank texts have no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(table)
    k = len(names)

    def make(batches):
        if not _TOOLS:
            _TOOLS.append(Terms())
        for batch in batches:
            ids, sources, texts = (batch.column(batch.schema.names.index(c)).to_pylist() for c in ("doc_id", "source", "text"))
            some = [i for i, t in enumerate(texts) if t is not None and not t.isspace() and t]
            ids, sources, texts = ([x[i] for i in some] for x in (ids, sources, texts))
            for a, b in blocks(texts):
                docs, patterns, counts = _vote(_TOOLS[0], shared.value, names, texts[a:b])
                offsets = pa.array(np.searchsorted(docs, np.arange(b - a + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (patterns, counts)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), pa.array(sources[a:b], pa.string()), *lists], names=["doc_id", "source", "patterns", "counts"])

    return documents.select("doc_id", "source", "text").mapInArrow(make, VOTES)


def _vote(tool: Terms, table: np.ndarray, names: list[str], texts: list[str]):
    """(document, pattern, number of sentences), by document."""
    n, k = len(texts), len(names)
    terms, of, document, heading = tool.of(texts)
    single = np.arange(len(terms)) < tool.words
    words, pairs = (sentence_scores(terms[x], of[x], len(document), table) for x in (single, ~single))
    both = areas_of(words + pairs) + 1
    order = np.arange(len(document))
    # the last heading above with an area, and the area of the first line
    at = np.maximum.accumulate(np.where(heading & (both > 0), order, -1))
    above = np.concatenate([[-1], at[:-1]])
    section = np.where((above >= 0) & (document[above] == document), both[above], 0)
    first = np.flatnonzero(np.concatenate([[True], document[1:] != document[:-1]])) if len(document) else np.zeros(0, int)
    title = np.zeros(n, np.int64)
    title[document[first]] = np.where(heading[first], both[first], 0)
    titled = title[document]
    titled[first] = 0  # a title is no evidence for itself
    address = np.zeros(n, np.int64)
    for i, t in enumerate(texts):
        if "://" in t or "@" in t or "www." in t:
            found = " ".join(_ADDRESS.findall(t)).lower()
            address[i] = max(((found.count(s), -j) for j, s in enumerate(names) if s in found), default=(0, 1))[1] * -1 + 1
    pattern = np.zeros(len(document), np.int64)
    for vote in (areas_of(words) + 1, areas_of(pairs) + 1, section, titled, address[document]):
        pattern = pattern * (k + 1) + vote
    size = (k + 1) ** len(FUNCTIONS)
    keys, counts = np.unique(document.astype(np.int64) * size + pattern, return_counts=True)
    return keys // size, keys % size, counts


def source_votes(documents: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    """source, said (1 and up) of sources with at least five labelled documents: the area that most of them have, if a quarter do."""
    of = labels.join(documents.select("doc_id", "source"), "doc_id")
    n = of.groupBy("source").agg(F.countDistinct("doc_id").alias("n")).where("n >= 5")
    number = F.create_map(*[F.lit(x) for i, s in enumerate(names) for x in (s, i + 1)])
    each = of.groupBy("source", number[F.col("subject")].alias("area")).agg(F.count(F.lit(1)).alias("m"))
    top = each.groupBy("source").agg(F.max(F.struct("m", (-F.col("area")).alias("area"))).alias("top"))
    return top.join(n, "source").where(F.col("top.m") >= SHARE * F.col("n")).select("source", (-F.col("top.area")).alias("said"))


def learn(patterns: np.ndarray, counts: np.ndarray, areas: int, functions: int = len(FUNCTIONS) + 1, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """The posterior (patterns, areas + 1) of what the sentences of each pattern are about, column 0 for no area; and each function's table (area, vote).

    Given the truth the functions vote independently, each with its own table of how often it names which area, or
    none; the tables are learnt by expectation-maximisation from the patterns' counts alone. The start takes a sentence
    to be about what words and pairs say, and about nothing where both are silent.
    """
    base = areas + 1
    digits = np.stack([patterns // base ** (functions - 1 - f) % base for f in range(functions)])
    q = np.full((len(patterns), base), 0.02 / base)
    w, p = digits[0], digits[1]
    rows = np.arange(len(patterns))
    q[rows, np.where(w > 0, w, p)] += 0.6
    q[rows, np.where(p > 0, p, w)] += 0.38
    n = counts.astype(float)
    tables = np.zeros((functions, base, base))
    for _ in range(rounds):
        weighted = q * n[:, None]
        prior = (weighted.sum(axis=0) + 1) / (n.sum() + base)
        odds = np.tile(np.log(prior), (len(patterns), 1))
        for f in range(functions):
            table = np.full((base, base), 0.1)
            for area in range(base):
                table[area] += np.bincount(digits[f], weighted[:, area], base)
            tables[f] = table / table.sum(axis=1, keepdims=True)
            odds += np.log(tables[f][:, digits[f]]).T
        odds -= odds.max(axis=1, keepdims=True)
        q = np.exp(odds)
        q /= q.sum(axis=1, keepdims=True)
    return q, tables


def assign(documents: DataFrame, labels: DataFrame, subjects: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, subject, posterior (mean, of the sentences about the area), share (of the sentences about any area) of every area of every document with text.

    A sentence is about the area of the greatest posterior of its votes, or about none. An area is a case if it has at
    least SHARE of the sentences about any. A document without a sentence about any area gets the area with the greatest
    sum of posteriors (of equals the first by name), so every document that is not null or blank has one.
    """
    from ..session import checkpoint

    spark = documents.sparkSession
    names, table = train(documents, labels, subjects, sample)
    k = len(names)
    said = source_votes(documents, label_table(labels, subjects), names)
    cast = checkpoint(votes(documents, names, table)).join(said, "source", "left").withColumn("said", F.coalesce("said", F.lit(0)))
    of = F.explode(F.arrays_zip(F.transform("patterns", lambda p: p.cast("long") * (k + 1) + F.col("said")).alias("pattern"), F.col("counts").alias("n")))
    # the number of patterns is bounded by the areas: (areas + 1) to the power of the functions
    got = cast.select(of.alias("e")).select("e.*").toDF("pattern", "n").groupBy("pattern").agg(F.sum("n").alias("n")).toPandas().sort_values("pattern")
    keys = got["pattern"].to_numpy(np.int64)
    posterior, _ = learn(keys, got["n"].to_numpy(), k)
    shared = spark.sparkContext.broadcast((keys, posterior.astype(np.float32)))

    def decide(batches):
        known, q = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, said_of = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            lists, counts = batch.column(1), batch.column(2).flatten().to_numpy().astype(float)
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            pattern = np.searchsorted(known, lists.flatten().to_numpy().astype(np.int64) * (k + 1) + said_of[row])
            post = q[pattern]
            best = post.argmax(axis=1)
            number, mass, any_mass = (np.zeros((batch.num_rows, k + 1)) for _ in range(3))
            np.add.at(number, (row, best), counts)
            np.add.at(mass, (row, best), counts * post[np.arange(len(best)), best])
            np.add.at(any_mass, row, counts[:, None] * post)
            total = number[:, 1:].sum(axis=1)
            share = number[:, 1:] / np.maximum(total, 1)[:, None]
            take = share >= SHARE
            silent = np.flatnonzero(total == 0)
            top = any_mass[silent, 1:].argmax(axis=1)
            take[silent, top] = True
            d, area = np.nonzero(take)
            p = np.where(total[d] > 0, mass[d, area + 1] / np.maximum(number[d, area + 1], 1), any_mass[d, area + 1] / np.maximum(any_mass[d].sum(axis=1), 1e-9))
            yield pa.RecordBatch.from_arrays([pa.array(ids[d]), pa.array([names[j] for j in area], pa.string()), pa.array(np.round(p, 6)), pa.array(np.round(share[d, area], 6))], names=["doc_id", "subject", "posterior", "share"])

    return cast.select("doc_id", "patterns", "counts", F.col("said").cast("int").alias("said")).mapInArrow(decide, "doc_id bigint, subject string, posterior double, share double")


def makeup(documents: DataFrame, assigned: DataFrame) -> DataFrame:
    """corpus, subject, docs, chars: a document with several areas is split evenly among them in chars."""
    n = assigned.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"))
    each = assigned.join(n, "doc_id").join(documents.select("doc_id", "corpus", F.length("text").alias("size")), "doc_id")
    return each.groupBy("corpus", "subject").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("size").cast("decimal(20,0)") / F.col("k")).cast("bigint").alias("chars"))
