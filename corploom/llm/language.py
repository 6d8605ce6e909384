"""Language of documents and of their lines: multilingual mixtures of character n-gram models.

Every line has a likelihood under each language from hashed 3- and 4-grams of its letters. Expectation-maximisation
finds the document's language proportions from its lines, languages that do not pay for themselves under a penalised
likelihood are left out one after another, and each line gets the language with the greatest posterior.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LETTER, blocks, char_classes
from .sampling import place, short

LANGUAGES = ("en", "fr", "de", "es", "pt", "nl")

#: Labelled rows of each language, about, from which the models are fitted; chosen by a hash of row_id over the whole table.
SAMPLE = 1200

#: Letters and words that a line of another language must have: fewer say nothing about a language.
LEAST_LETTERS, LEAST_WORDS = 10, 2

#: Letters from which a line is assigned by itself when the models are fitted again.
LONG = 40

#: Hash bits of the n-gram tables, weight of an added count, and the share of n-gram evidence kept (n-grams overlap).
BITS, ADDED, TEMPER = 17, 0.7, 0.35

#: What each further language of a document must add to the log-likelihood; rounds of expectation-maximisation.
PENALTY, ROUNDS = 6.0, 8

#: Log-odds that a line of another language must have over the document's main language.
MARGIN = 3.0

#: Letters from which a text can be in none of the languages, and the part of what the least likely texts of the sample reach below which it is.
LEAST_TEXT, NONE = 60, 0.5

#: Rounds in which the models are fitted again to the lines as they were found, since labels are noisy.
REFITS = 3

#: Names of the languages, beside their codes.
NAMES = {
    "english": "en", "french": "fr", "francais": "fr", "français": "fr", "german": "de", "deutsch": "de", "spanish": "es", "espanol": "es",
    "español": "es", "castellano": "es", "portuguese": "pt", "portugues": "pt", "português": "pt", "dutch": "nl", "nederlands": "nl",
    "eng": "en", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "spa": "es", "por": "pt", "nld": "nl", "dut": "nl",
}

#: Names of mail header fields.
HEADERS = ("from", "to", "cc", "bcc", "subject", "date", "sent", "reply-to", "sender", "message-id", "in-reply-to", "references", "received", "return-path", "content-type", "content-transfer-encoding", "mime-version", "list-id", "list-unsubscribe", "delivered-to", "user-agent", "organization", "importance", "precedence", "authentication-results", "dkim-signature")


def label(text: str | None) -> str | None:
    """The code of a language label in any spelling (case, region, three letters, name); other labels lower-cased; None for blank."""
    if text is None:
        return None
    base = text.strip().lower().replace("_", "-").split("-")[0].strip()
    return NAMES.get(base, base) or None


class Models(NamedTuple):
    """Log-probabilities of hashed 3- and 4-grams over those of the background (all languages alike): two arrays (2**BITS, languages).

    least: the log-likelihood a letter over the background below which a text is in none of the languages.
    """

    three: np.ndarray
    four: np.ndarray
    least: float = 0.0


class Grams:
    """Hashed n-grams of batches of lines."""

    def __init__(self):
        classes = char_classes()
        low = np.arange(0x110000, dtype=np.uint32)
        small = np.array([ord(c) if len(c := chr(i).lower()) == 1 else i for i in range(0x3000)], np.uint32)
        low[:0x3000] = small
        low[classes != LETTER] = 0
        self.low = low
        self.upper = np.zeros(0x110000, bool)
        self.upper[:0x3000] = [chr(i).isupper() for i in range(0x3000)]

    def of(self, whole: str) -> list[tuple[np.ndarray, np.ndarray]]:
        """For 3- and 4-grams: the places of the grams' last letters and their hashes. A gram has letters inside and one sign at most at each end."""
        cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        c = self.low[cp]
        if len(c):
            # words that begin with a capital are names more often than not; names have no language
            begins = c != 0
            begins[1:] &= c[:-1] == 0
            start = np.maximum.accumulate(np.where(begins, np.arange(len(c), dtype=np.int32), np.int32(0)))
            c = np.where(self.upper[cp][start], np.uint32(0), c)
        c = np.concatenate([np.zeros(1, np.uint32), c, np.zeros(2, np.uint32)])
        x = [c[:-3] * np.uint32(0x9E3779B1), c[1:-2] * np.uint32(0x85EBCA6B), c[2:-1] * np.uint32(0xC2B2AE35), c[3:] * np.uint32(0x27D4EB2F)]
        inside = c[1:-2] != 0
        three = np.flatnonzero(inside)
        shift = np.uint32(32 - BITS)
        h = (x[0] + x[1]) ^ x[2]
        h3 = ((h * np.uint32(0x165667B1)) >> shift)[three]
        four = np.flatnonzero(inside & (c[2:-1] != 0))
        h4 = (((h + x[3]) * np.uint32(0x2545F491)) >> shift)[four]
        return [(three, h3), (four, h4)]

    def scores(self, lines: list[str], models: Models) -> tuple[np.ndarray, np.ndarray]:
        """Tempered log-likelihoods (lines, languages), and the number of letters of each line."""
        parts = [self._scores(lines[a:b], models) for a, b in blocks(lines)]
        if not parts:
            return np.zeros((0, models.three.shape[1])), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts])

    def _scores(self, lines: list[str], models: Models) -> tuple[np.ndarray, np.ndarray]:
        whole = "\n".join(lines)
        begin = np.zeros(len(lines) + 1, np.int64)
        np.cumsum(np.fromiter((len(t) + 1 for t in lines), np.int64, len(lines)), out=begin[1:])
        out = np.zeros((len(lines), models.three.shape[1]))
        letters = None
        for (at, h), table in zip(self.of(whole), models[:2]):
            edge = np.searchsorted(at, begin)
            if letters is None:
                letters = np.diff(edge)
            if len(at):
                some = np.flatnonzero(np.diff(edge))
                out[some] += np.add.reduceat(table[h], edge[some], axis=0)
        return TEMPER * out, letters

    def count(self, lines: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weighted gram counts: two arrays (2**BITS, languages). weights: (lines, languages)."""
        k = weights.shape[1]
        out = (np.zeros((1 << BITS, k)), np.zeros((1 << BITS, k)))
        for a, b in blocks(lines):
            begin = np.cumsum([0, *(len(t) + 1 for t in lines[a:b])])
            for total, (at, h) in zip(out, self.of("\n".join(lines[a:b]))):
                line = np.searchsorted(begin, at, "right") - 1
                for j in range(k):
                    total[:, j] += np.bincount(h, weights[a:b][line, j], 1 << BITS)
        return out


def log_table(counts: np.ndarray) -> np.ndarray:
    """Smoothed log-probabilities, relative to the mean over the languages (a constant per gram does not matter).

    Counts are first scaled to one total: else grams that are rare everywhere would speak for the languages with little text.
    """
    total = counts.sum(axis=0)
    some = total[total > 0]
    p = np.log(counts * ((some.min() if len(some) else 0) / np.maximum(total, 1e-9)) + ADDED)
    return (p - p.mean(axis=1, keepdims=True)).astype(np.float32)


def fit(texts: list[str], labels: list[str | None], languages: tuple[str, ...] = LANGUAGES, refits: int = REFITS) -> Models:
    """Models from labelled texts; wrong labels are outvoted, as the lines are assigned anew and counted again."""
    grams = Grams()
    pairs = [(t, languages.index(x)) for t, s in zip(texts, labels) if t and (x := label(s)) in languages]
    lines, of, start = [], [], []
    for d, (t, k) in enumerate(pairs):
        part = [plain(x) for x in dict.fromkeys(t.split("\n")) if x.strip() and not is_header(x)]
        lines += part
        of += [d] * len(part)
        start += [k] * len(part)
    if not lines:
        empty = np.zeros((1 << BITS, len(languages)), np.float32)
        return Models(empty, empty)
    weights = np.eye(len(languages))[start]
    models = None
    for _ in range(refits + 1):
        models = Models(*map(log_table, grams.count(lines, weights)))
        got, letters, _, (main, _, _, total, own) = infer(grams, models, lines, np.array(of), len(pairs))
        # short lines go with their document: alone they say little, and a wrong turn would confirm itself
        weights = np.eye(len(languages))[np.where(letters >= LONG, got, main[of])]
    long = total >= LEAST_TEXT
    return models._replace(least=float(NONE * np.percentile(own[long] / total[long], 1)) if long.any() else 0.0)


def infer(grams: Grams, models: Models, lines: list[str], of: np.ndarray, n: int):
    """For lines of n documents (of: the document of each line): each line's language, letters, log-odds over the document's
    main language and its posterior; as (language, letters, (odds, posterior), (main, share of main, evidence, letters in main, their log-likelihood over the background)) by line and document."""
    s, letters = grams.scores(lines, models)
    k = s.shape[1]
    top = s.max(axis=1, keepdims=True) if len(s) else np.zeros((0, 1))
    like = np.exp(np.maximum(s - top, -60))
    allowed = np.ones((n, k), bool)
    share = np.full((n, k), 1 / k)

    def spread(rounds: int) -> np.ndarray:
        nonlocal share
        weight = np.minimum(letters, 200) + 1e-9
        for _ in range(rounds):
            post = like * share[of]
            post /= post.sum(axis=1, keepdims=True) + 1e-300
            total = np.stack([np.bincount(of, post[:, j] * weight, n) for j in range(k)], axis=1)
            share = np.where(allowed, total + 1e-6, 0)
            share /= share.sum(axis=1, keepdims=True) + 1e-300
        return share

    spread(ROUNDS)
    for _ in range(k - 1):
        mixed = like * share[of]
        whole = np.log(mixed.sum(axis=1) + 1e-300)
        gain = np.full((n, k), np.inf)
        for j in range(k):
            rest = np.maximum(1 - share[of, j], 1e-12)
            without = np.log((mixed.sum(axis=1) - mixed[:, j]).clip(1e-300) / rest)
            gain[:, j] = np.bincount(of, whole - without, n)
        gain[~allowed] = np.inf
        worst = gain.argmin(axis=1)
        drop = (gain[np.arange(n), worst] < PENALTY) & (allowed.sum(axis=1) > 1)
        if not drop.any():
            break
        allowed[np.flatnonzero(drop), worst[drop]] = False
        share = np.where(allowed, share, 0)
        share /= share.sum(axis=1, keepdims=True) + 1e-300
        spread(3)
    post = like * share[of]
    post /= post.sum(axis=1, keepdims=True) + 1e-300
    language = post.argmax(axis=1)
    size = np.stack([np.bincount(of, post[:, j] * letters, n) for j in range(k)], axis=1)
    main = size.argmax(axis=1)
    odds = s[np.arange(len(s)), language] - s[np.arange(len(s)), main[of]]
    language = np.where(odds >= MARGIN, language, main[of])
    size = np.stack([np.bincount(of[language == j], letters[language == j], n) for j in range(k)], axis=1)
    main2 = size.argmax(axis=1)
    total = size.sum(axis=1)
    score = size[np.arange(n), main2] / np.maximum(total, 1)
    best = np.sort(np.stack([np.bincount(of, s[:, j], n) for j in range(k)], axis=1), axis=1)
    evidence = best[:, -1] - best[:, -2]
    own = np.bincount(of, s[np.arange(len(s)), main2[of]] * (language == main2[of]), n)
    return language, letters, (odds, post[np.arange(len(s)), language]), (main2, score, evidence, size[np.arange(n), main2], own)


_ADDRESS = re.compile(r"\S*[  ]?(?:@|[(\[{]at[)\]}]|(?<=[  ])AT(?=[  ]))[  ]?\S*(?:[  ](?:[(\[{]dot[)\]}]|DOT)[  ]\S+)*|\S*/\S*")
_SIGNS = ("@", "/", "(at)", "[at]", "{at}", " AT ")


def plain(line: str) -> str:
    """A line without addresses (disguised ones as well) and handles; a long line in capitals only in lower case."""
    if any(x in line for x in _SIGNS):
        line = _ADDRESS.sub(" ", line)
    return line.lower() if len(line) > 60 and line.isupper() else line


def is_header(line: str) -> bool:
    """Whether a line is a mail header field (quoted ones as well)."""
    name, colon, _ = line.lstrip("> \t").partition(":")
    return bool(colon) and name.strip().lower() in HEADERS


def train(rows: DataFrame, sample: int = SAMPLE) -> Models:
    """Models from about ``sample`` labelled rows of each language (text, language, row_id), the first by a hash of row_id."""
    spelled = F.create_map(*[F.lit(x) for pair in (NAMES | {k: k for k in LANGUAGES}).items() for x in pair])
    base = F.trim(F.split(F.translate(F.lower(F.trim("language")), "_", "-"), "-")[0])
    labelled = rows.where(short() & F.col("language").isNotNull()).select("text", spelled[base].alias("label"), place("row_id").alias("_at")).where("label is not null")
    # at most one row for each language
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return fit([], [])
    edge = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, float(sample) / n)])
    got = labelled.where(F.col("_at") < edge[F.col("label")]).limit(2 * sample * len(LANGUAGES)).select("text", "label").toPandas()
    got = got.sort_values(["label", "text"])
    return fit(got["text"].tolist(), got["label"].tolist())


_GRAMS: list[Grams] = []
_WORDS = re.compile(r"[^\W\d_]{2,}")

FOUND = "row_id bigint, line_no int, language string, confidence int"


def identify(rows: DataFrame, models: Models, every: bool = True) -> DataFrame:
    """row_id, line_no, language, confidence (0..1000): line_no -1 is the whole document, then its lines in another language.

    With ``every`` each document has its row; without, only those whose label is missing, names no single language or
    names another one. Documents without letters have no language: null with confidence 0 (no row without ``every``);
    so have null texts, and texts that are no likelier in any of the languages than in their background. Mail header lines and lines without enough words are never lines of another language.
    """
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def make(batches):
        if not _GRAMS:
            _GRAMS.append(Grams())
        for batch in batches:
            ids, texts, labels = (batch.column(batch.schema.names.index(c)).to_pylist() for c in ("row_id", "text", "language"))
            texts = [t or "" for t in texts]
            for a, b in blocks(texts):
                yield from _found(_GRAMS[0], shared.value, ids[a:b], texts[a:b], labels[a:b], every)

    return rows.select("row_id", "text", "language").mapInArrow(make, FOUND)


def _found(grams: Grams, models: Models, ids: list, texts: list[str], labels: list, every: bool):
    lines, of, number, skip = [], [], [], []
    for d, t in enumerate(texts):
        for i, x in enumerate(t.split("\n")):
            if x and not x.isspace():
                lines.append(x)
                of.append(d)
                number.append(i)
                skip.append(":" in x and is_header(x))
    of = np.array(of, np.int64)
    out = []
    if lines:
        # header lines have no part in what the text is written in
        read = ["" if s else plain(x) for x, s in zip(lines, skip)]
        language, letters, (odds, post), (main, score, evidence, total, own) = infer(grams, models, read, of, len(texts))
        known = (total < LEAST_TEXT) | (own >= models.least * total)
        other = np.flatnonzero(known[of] & (language != main[of]) & ~np.array(skip) & (letters >= LEAST_LETTERS))
        other = other[[len(_WORDS.findall(lines[i])) >= LEAST_WORDS for i in other.tolist()]] if len(other) else other
        for i in other.tolist():
            out.append((ids[of[i]], number[i], LANGUAGES[language[i]], int(round(1000 * post[i]))))
    for d, row in enumerate(ids):
        name = LANGUAGES[main[d]] if lines and total[d] > 0 and known[d] else None
        if every or (name is not None and label(labels[d]) != name):
            out.append((row, -1, name, int(round(1000 * score[d] * (1 - np.exp(-max(evidence[d], 0)))))  if name else 0))
    cols = list(zip(*out)) if out else [[], [], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.int32()))], names=["row_id", "line_no", "language", "confidence"])


def wrong_labels(rows: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """row_id, line_no, language of documents whose label is missing or wrong (line_no -1) and of lines in another language."""
    return identify(rows, train(rows, sample), every=False).select("row_id", "line_no", "language")
