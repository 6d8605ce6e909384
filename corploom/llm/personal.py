"""Personal items in free text: high-recall candidates, boosted trees on format and context, calibrated thresholds.

Generators propose overlapping spans of five kinds. Trees of each kind are trained here on all rows whose wording
tells what some spans are (a mail header before a name, "passport" before a number, "docket" before another); in half
of the training rows the wording is hidden from the trees, so that they also know the items by their format where
nothing announces them. Overlaps go to the greater probability.

The texts are read once: spans and what is known of them are kept in blocks of rows. Words are counted over all blocks,
spans that look alike to the trees are added up, and the trees are grown from these sums.
"""

from __future__ import annotations

import marshal
import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from . import boosting

#: Rows to which counts of words are referred in tables with more rows: a word is often a name, or written small, by its count in so many rows.
PER = 4000

#: Rows of a block, and training rows that are told apart by their bins up to which the trees are grown on the driver; more stay in blocks that tasks add up. Both ways give the same trees.
BLOCK, TOGETHER = 2000, 1_000_000

KINDS = ("email", "phone", "id_number", "address", "name")

#: Placeholders by kind.
PLACEHOLDER = {"email": "<EMAIL_ADDRESS>", "phone": "<PHONE_NUMBER>", "id_number": "<ID_NUMBER>", "address": "<STREET_ADDRESS>", "name": "<PERSON_NAME>"}

#: Wording before telephone numbers, numbers of persons and other numbers, in en, fr, de, es, pt, nl.
PHONE_WORDS = ("call", "phone", "tel", "telephone", "mobile", "cell", "fax", "reach me on", "ring", "appelez le", "appeler le", "téléphone", "tél", "portable", "rufen sie", "telefon", "handy", "anrufen unter", "llame al", "llamar al", "teléfono", "móvil", "ligue para", "ligar para", "telefone", "telemóvel", "bel", "telefoon", "mobiel", "bereikbaar op")
ID_WORDS = ("identity number", "identity no", "passport", "social security", "ssn", "national insurance", "tax number", "driving licence", "id number", "numéro d'identité", "passeport", "sécurité sociale", "carte d'identité", "ausweisnummer", "ausweis", "reisepass", "sozialversicherungsnummer", "steuernummer", "número de identidad", "pasaporte", "dni", "nie", "número de identidade", "passaporte", "cartão de cidadão", "nif", "identiteitsnummer", "paspoort", "burgerservicenummer", "bsn")
OTHER_WORDS = ("docket", "file", "case", "version", "part with number", "part", "order", "catalogue", "catalog", "reference", "invoice", "isbn", "number of the list", "dossier", "référence", "commande", "facture", "version", "aktenzeichen", "bestellnummer", "rechnung", "fassung", "expediente", "referencia", "pedido", "versión", "factura", "processo", "referência", "encomenda", "versão", "zaak", "zaaknummer", "bestelnummer", "referentie", "versie", "dossiernummer", "updated", "mis à jour", "stand", "actualizado", "atualizado", "bijgewerkt", "queue id")

#: Wording before addresses.
LIVES_WORDS = ("lives at", "living at", "resides at", "address", "sent to", "habite", "demeurant", "adresse", "wohnhaft", "wohnt", "anschrift", "vive en", "domicilio", "dirección", "reside", "mora na", "morada", "residente", "woont", "wonende", "woonachtig", "adres")

#: Words beside names: titles, wording before names, wording before places, words of organisations.
TITLES = ("dr", "mr", "mrs", "ms", "miss", "prof", "sir", "mme", "mlle", "monsieur", "madame", "frau", "herr", "herrn", "sr", "sra", "señor", "señora", "don", "doña", "senhor", "senhora", "dhr", "mevr", "mevrouw", "meneer", "drs")
NAME_WORDS = ("by", "words", "from", "author", "authors", "signed by", "to", "par", "auteur", "auteurs", "selon", "von", "autor", "autoren", "por", "autores", "según", "segundo", "door", "volgens", "auteurs", "ask for", "according to", "an", "nach angaben von")
PLACE_WORDS = ("in", "near", "at", "around", "of", "the", "through", "à", "près de", "de", "du", "le", "la", "les", "autour de", "des", "aus", "rund um", "bei", "das", "die", "der", "den", "im", "en", "cerca de", "el", "los", "las", "em", "perto de", "o", "a", "os", "as", "uit", "rond", "het", "op", "bij")
GROUP_WORDS = ("institute", "archive", "archives", "council", "sons", "review", "papers", "post", "courier", "lab", "society", "office", "university", "company", "institut", "société", "verein", "söhne", "instituto", "sociedad", "oficina", "sociedade", "vereniging", "zonen", "street", "road", "lane", "close", "avenue", "code", "lake", "mount", "port", "upper", "lower", "new", "old", "saint", "section", "page", "version", "docket")

#: Words of streets, before or after the name or at its end.
STREET_AFTER = ("street", "road", "lane", "close", "avenue", "drive", "way", "court", "place", "terrace", "crescent", "gardens", "square", "grove", "hill", "row", "boulevard", "st", "rd", "ave")
STREET_BEFORE = ("rue", "avenue", "boulevard", "allée", "chemin", "place", "quai", "impasse", "cours", "route", "passage", "square")
STREET_FIRST = ("calle", "avenida", "plaza", "paseo", "camino", "ronda", "rua", "travessa", "praça", "largo", "alameda", "estrada")
STREET_END = ("straße", "strasse", "weg", "platz", "allee", "gasse", "ring", "ufer", "damm", "laan", "straat", "plein", "gracht", "kade", "dreef", "singel", "steeg")

_SP = r"[  \t]+"
_UP = r"A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĢĪĮİĶĹĽŁŃŇŌŐŒŘŚŞŠŤŢŪŮŰŲŹŻŽ"
_AT = r"(?:[  ]?@[  ]?|[  ]?[(\[{]\s?(?:at|AT|arroba|chez|bei)\s?[)\]}][  ]?|[  ](?:AT|at|arroba)[  ])"
_DOT = r"(?:\.|[  ]?[(\[{]\s?(?:dot|DOT|punto|point|punkt|ponto|punt)\s?[)\]}][  ]?|[  ](?:DOT|dot)[  ])"
EMAIL = re.compile(rf"(?<![\w.+@-])[^\W_][\w.+'-]*{_AT}[^\W_][\w-]*(?:{_DOT}[^\W_][\w-]*)+(?![\w.+-]*(?:@|{_AT}[^\W_]))")
NUMBER = re.compile(rf"(?<![\w@+/.,-])(?:\(?\+|\(|[{_UP}]{{1,3}}[ -]?)?\(?\d(?:\d|\)?[  ./-]?\(?(?=[\d(]))*\d\)?(?:[ -]?[{_UP}](?![\w]))?")
WORDS = re.compile(rf"(?<![\w@.+'’-])(?:[{_UP}]\.|[{_UP}][\w'’]+(?:-[{_UP}][\w'’]+)*)(?:{_SP}(?:[{_UP}]\.|[{_UP}][\w'’]+(?:-[{_UP}][\w'’]+)*))+")
_CAP = rf"[{_UP}][\w'’-]*"
_REST = rf"(?:,{_SP}\d\.?º{_SP}\w\b)?(?:,{_SP}\d{{4,5}}(?![\w-]|{_SP}\d)(?:{_SP}{_CAP})?)?"
#: Addresses: the house number first (found from the number, a flat before it is added); the kind of street first; the kind of street at the end of its name.
NUMBER_FIRST = re.compile(rf"\d+(?:[a-zA-Z]|[\u00a0 ](?:bis|ter|BIS|TER))?,?{_SP}(?:(?:{_CAP}{_SP}){{1,3}}(?i:{'|'.join(STREET_AFTER)})\b|(?i:{'|'.join(STREET_BEFORE)})\b{_SP}(?:(?i:de|du|des|de la|d[’'])[\u00a0 ’']?\s?)?{_CAP}){_REST}")
FLAT = re.compile(r"(?<![\w-])(?:flat|apt\.?|apartment|unit|suite)\s\d+\w?,\s$", re.IGNORECASE)
KIND_FIRST = re.compile(rf"(?<![\w-])(?i:{'|'.join(STREET_FIRST)}){_SP}(?:(?i:de|del|da|do|dos|das|de la){_SP})?{_CAP}(?:{_SP}{_CAP})?,?{_SP}(?:n\.?º{_SP})?\d+\w?{_REST}")
KIND_LAST = re.compile(rf"(?<![\w-])(?:{_CAP}{_SP})?[{_UP}]\w*(?i:{'|'.join(STREET_END)}){_SP}\d+(?:-?[\w]+)?{_REST}")
_RUN = re.compile(r"\d+")
_BLANK = ("\u00a0", " ", "\t")
_FIRST_SIGN = re.compile(f"(?:{'|'.join(STREET_FIRST)})[\u00a0 \t]")
_DATE = re.compile(r"^(?:\d{4}[-./]\d{1,2}(?:[-./]\d{1,2})?|\d{1,2}[-./]\d{1,2}[-./]\d{2,4})$")
_GROUPS = re.compile(r"\d+")
_MESSAGE = re.compile(r"(?i)(?:message-id|in-reply-to|references|content-id|resent-message-id)\s*:[^\n]*$")


class Span(NamedTuple):
    start: int
    end: int
    first: str = ""  # of names: the given name or initial
    last: str = ""  # of names: the family name
    small: bool = False  # of names: written in small letters


def _words(words: tuple[str, ...]) -> re.Pattern:
    return re.compile(r"(?<!\w)(?:" + "|".join(re.escape(w) for w in sorted(set(words), key=len, reverse=True)) + r")(?!\w)")


_PHONE, _ID, _OTHER, _LIVES = map(_words, (PHONE_WORDS, ID_WORDS, OTHER_WORDS, LIVES_WORDS))
_LOOSE = "".join(c for c in map(chr, range(0x3001)) if re.match(r"[\s.:(]", c))
_GROUP = frozenset(GROUP_WORDS)

#: What words announce, as bits, and the words with theirs.
TITLE, NAME, PLACE = 1, 2, 4
_ENDING = {w: TITLE * (w in TITLES) | NAME * (w in NAME_WORDS) | PLACE * (w in PLACE_WORDS) for w in TITLES + NAME_WORDS + PLACE_WORDS}
_SIZES, _TAILS = sorted({len(w) for w in _ENDING}), frozenset(w[-2:] for w in _ENDING)


def _announced(low: str) -> int:
    """What the words at the end of the text announce."""
    low, out = low.rstrip(_LOOSE), 0
    for n in _SIZES if low[-2:] in _TAILS or low[-1:] in _TAILS else ():
        if n > len(low):
            break
        bits = _ENDING.get(low[-n:])
        if bits and (n == len(low) or not (low[-n - 1].isalnum() or low[-n - 1] == "_")):
            out |= bits
    return out


def _said(t: str, s: Span) -> int:
    """What the words before a name announce."""
    return _announced(t[max(0, s.start - 24) : s.start].lower())


_BEFORE_NAMES = frozenset(TITLES + NAME_WORDS)


def small_names(text: str, letters: Letters) -> list[Span]:
    """Names written in small letters: a known given name and a known family name after it, neither of them a word that is written small elsewhere."""
    out = []
    for word in letters.small_givens.intersection(text.split()):
        at = text.find(word)
        while at >= 0:
            m = _SMALL_NAME.match(text, at)
            if m and (at == 0 or not (text[at - 1].isalnum() or text[at - 1] in "_.@+-'’")) and m.group(1) == word and letters.families.get(m.group(2).split("-")[0]) and m.group(2).split("-")[0] not in letters.small:
                out.append(Span(at, m.end(), word.capitalize(), m.group(2).title(), True))
            at = text.find(word, at + 1)
    return sorted(out)


def candidates(text: str) -> dict[str, list[Span]]:
    """Spans that could be items, by generator: email, number, address, name (in capitals or with capitals). They may overlap."""
    out: dict[str, list[Span]] = {"email": [], "number": [], "address": [], "name": []}
    end = -1
    for hit in _MAYBE_AT.finditer(text) if any(x in text for x in _AT_SIGNS) else ():  # only lines with a sign of an address are read for one
        if hit.start() < end or not _HOST.match(text, hit.start()):
            continue
        begin, end = text.rfind("\n", 0, hit.start()) + 1, text.find("\n", hit.end())
        end = len(text) if end < 0 else end
        out["email"] += [Span(m.start(), m.end()) for m in EMAIL.finditer(text, begin, end) if any(c.isalpha() for c in m.group()[-4:])]
    runs, end = [m.start() for m in _RUN.finditer(text)], -1
    for at in runs:  # only lines with so many digits are read for numbers
        if at < end or not _DIGITS.match(text, at):
            continue
        begin, end = text.rfind("\n", 0, at) + 1, text.find("\n", at)
        end = len(text) if end < 0 else end
        for m in NUMBER.finditer(text, begin, end):
            s = m.group()
            if sum(map(str.isdigit, s)) >= 6:
                loose = s.count(")") > s.count("(") and s[-1] == ")"
                out["number"].append(Span(m.start(), m.end() - loose))
    out["address"] = _addresses(text, runs)
    for m in WORDS.finditer(text):
        words = m.group().split()
        if len(words) == 2:
            if not (len(words[1]) == 2 and words[1][1] == "."):
                out["name"].append(Span(m.start(), m.end(), *words))
            continue
        parts = [(m.start() + x.start(), m.start() + x.end(), x.group()) for x in _TOKEN.finditer(m.group())]
        for i, (a, _, w) in enumerate(parts[:-1]):
            j = i + 1
            while j < len(parts) and len(parts[j][2]) == 2 and parts[j][2][1] == ".":
                j += 1
            # a title or an announcing word before a whole name is no given name
            if j < len(parts) and not (i + 2 < len(parts) and j - i > 1 and w.lower() in _BEFORE_NAMES):
                out["name"].append(Span(a, parts[j][1], w, parts[j][2]))
    return out


def _addresses(text: str, runs: list[int]) -> list[Span]:
    """Spans that look like street addresses. They are looked for at numbers (runs: where they begin), which every address has and most lines have not."""
    found: set[tuple[int, int]] = set()
    for a in runs:
        if a and (text[a - 1].isalnum() or text[a - 1] in "_-"):
            continue
        if x := NUMBER_FIRST.match(text, a):
            line = text.rfind("\n", 0, a) + 1
            f = FLAT.search(text[line:a])
            found.add((line + f.start() if f else a, x.end()))
        if a and text[a - 1] in _BLANK and text[max(0, a - 16) : a].rstrip(" \t\u00a0").lower().endswith(STREET_END):
            line, end = text.rfind("\n", 0, a) + 1, text.find("\n", a)
            found.update(x.span() for x in KIND_LAST.finditer(text, line, end if end >= 0 else len(text)))
    low = text.lower() if runs else ""
    if any(w in low for w in STREET_FIRST) and _FIRST_SIGN.search(low):
        found.update(x.span() for x in KIND_FIRST.finditer(text))
    return [Span(a, b) for a, b in sorted(found)]


_AT_SIGNS = ("@", "at)", "AT)", "at]", "AT]", "at}", "AT}", "arroba", " AT ", " at ", "\u00a0AT", "\u00a0at", "AT\u00a0", "at\u00a0", "chez", "bei", "at ", "AT ")
_MAYBE_AT = re.compile(r"@|[(\[{]\s?(?:at|AT|arroba|chez|bei)\s?[)\]}]|[  ](?:AT|at|arroba)[  ]")
#: Six digits with at most what NUMBER lets stand between them.
_DIGITS = re.compile(r"\d(?:\)?[\u00a0 ./-]?\(?\d){5}")
#: What must follow the sign of an address: a host with a dot. Most signs are words like "at" and have none.
_HOST = re.compile(rf"(?:@[\u00a0 ]?|[(\[{{]\s?(?:at|AT|arroba|chez|bei)\s?[)\]}}][\u00a0 ]?|[\u00a0 ](?:AT|at|arroba)[\u00a0 ])[^\W_][\w-]*{_DOT}[^\W_]")
_TOKEN = re.compile(r"\S+")

#: Features that tell the wording around a span, by kind, and what those of numbers are where there is none.
HIDDEN = {"email": [0, 1, 8], "number": [0, 1, 2, 3, 4, 28], "address": [0, 1, 2, 3], "name": [0, 1, 2, 3, 4, 5, 6]}


NOTHING = {0: -1, 1: -1, 2: -1}

#: Features of names that count how often their words were names, and the share of training rows in which they are hidden.
COUNTED, UNCOUNTED = [11, 12], 0.35


def _email(t: str, s: Span) -> list[float]:
    before = t[max(0, s.start - 60) : s.start]
    x = t[s.start : s.end]
    local = re.split(_AT, x)[0]
    letters = [c for c in local.lower() if c.isalpha()]
    vowels = sum(c in "aeiouy" for c in letters)
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(local, local[1:]))
    run = max(map(len, re.findall(r"[b-df-hj-np-tv-xz]+", local.lower())), default=0)
    return [bool(_MESSAGE.search(before)), before.endswith("<"), len(local), vowels / max(1, len(letters)), switches, run, sum(c.isdigit() for c in local), any(c in ".-_+" for c in local), "://" in t[max(0, s.start - 12) : s.start], len(x)]


def _number(t: str, s: Span, ends: list[int]) -> list[float]:
    """ends: where the mail and street addresses of the text end; what follows one at once is of the same contact."""
    before = t[max(0, s.start - 34) : s.start].lower()
    x = t[s.start : s.end]
    last = lambda p: max((m.end() for m in p.finditer(before)), default=-1)
    phone, id_, other = last(_PHONE), last(_ID), last(_OTHER)
    g = [len(m) for m in _GROUPS.findall(x)]
    digits = sum(g)
    lead = len(x) - len(x.lstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    size = (g + [0] * 6)[:6]
    return [phone, id_, other, phone > max(id_, other), before.rstrip().endswith((",", "·")) , digits, len(g), *size, lead, x[-1:].isalpha(), x[0] == "+", "(" in x, x.lstrip("(+")[:1] == "0", x.count(" ") + x.count(" "), x.count("."), x.count("-"), x.count("/"), bool(_DATE.match(x)), x[1:2] == "-" or x[2:3] == "-" and lead > 0, g[0] if g else 0, x.lstrip("(+")[:2] == "00", len(x), len(set(g)), any(0 < s.start - e <= 8 for e in ends)]


def _ends(c: dict[str, list[Span]]) -> list[int]:
    return [s.end for k in ("email", "address") for s in c[k]]


def _address(t: str, s: Span) -> list[float]:
    return _address_facts(t[max(0, s.start - 40) : s.start], t[s.start : s.end], t[s.end : s.end + 24])


def _address_facts(before: str, x: str, after: str) -> list[float]:
    """Wording and format of an address: whether somebody lives there, what stands around it, its number, its kind of street, what follows."""
    number = re.search(r"\d+", x)
    digits = number.group() if number else ""
    low, words = before.lower().rstrip(), x.split()
    nxt = after.lstrip(" \t\u00a0")
    follows = re.match(r"[^\W\d_]+", nxt)
    year = len(digits) == 4 and digits[:2] in ("18", "19", "20")
    kind = next((i for i, w in enumerate(words) if w.strip(",").lower() in _KINDS), -1)
    return [
        bool(_LIVES.search(low)), low.endswith((",", "·", ":", ";")), bool(_announced(low) & PLACE), low.endswith((".", "!", "?")) or not low, bool(number), x[:1].isdigit(), len(digits), year, x.count(","), bool(re.search(r",\s\d{4,5}\b", x)),
        any(x.rstrip(" 0123456789abcdiI-").lower().endswith(w) for w in STREET_END), kind >= 0, kind, len(words), bool(follows) and follows.group()[:1].isupper(), bool(follows) and follows.group().lower() in _GROUP, nxt[:1] in (",", "·"), nxt[:1] in (".", "\n", ""), x.lower().startswith(("flat", "apt", "apartment", "unit", "suite")),
    ]


_KINDS = frozenset(STREET_AFTER + STREET_BEFORE + STREET_FIRST)


def _decoys(t: str, s: Span) -> list[list[float]]:
    """What an address is mistaken for, made from a real one: the street without a number, as a place; a year before it; a house named after it; its number alone in a sentence."""
    x = t[s.start : s.end].split(",")[0]
    street = re.sub(r"^\d+\w*\s+|\s+\d\S*$", "", x)
    year = f"{1900 + (s.start * 7 + s.end) % 120}"
    return [
        _address_facts("They met again in ", street, " before noon"), _address_facts("As early as in ", f"{year} {street}", " was closed"), _address_facts("The work began in ", f"{year} {street}", " Archive"),
        _address_facts("It was moved to ", street, f" in {year}"), _address_facts("There were ", f"{len(x)} {street}", " Council papers"), _address_facts("", street, "."),
    ]


class Letters(NamedTuple):
    """Log-odds of letter triples in given names, family names and other words; how often words are given and family names; words that are also written small."""

    given: dict
    family: dict
    givens: dict
    families: dict
    small: frozenset
    small_givens: frozenset  # given names that are never words written small
    scale: float = 1.0  # what a count is in PER rows

    def of(self, table: dict, word: str) -> float:
        w = f"^{word.lower()}$"
        g = [table.get(w[i : i + 3], -0.5) for i in range(len(w) - 2)]
        return sum(g) / max(1, len(g))


def _letters(p: Counter, q: Counter) -> dict:
    a, b = sum(p.values()) + 1, sum(q.values()) + 1
    return {g: float(np.clip(np.log((p[g] + 0.5) / a) - np.log((q[g] + 0.5) / b), -4, 4)) for g in set(p) | set(q)}


def _told(word: str, letters: Letters, cache: dict) -> tuple:
    """What letters and counts tell of a word: as given name, as family name, how often it was either, whether it is written small."""
    got = cache.get(word)
    if got is None:
        if len(cache) > 100_000:
            cache.clear()
        low = word.lower()
        got = cache[word] = (letters.of(letters.given, word), letters.of(letters.family, word), letters.givens.get(low, 0), letters.families.get(low, 0), low in letters.small)
    return got


def _score(first: str, last: str, own: int, letters: Letters, cache: dict) -> tuple:
    """What letters and counts tell of a name. own: 1 if it is itself among the counted names, so that it is not evidence for itself."""
    a, b = _told(first, letters, cache), _told(last.split("-")[0], letters, cache)
    return 0.0 if len(first) == 2 and first[1] == "." else a[0], b[1], b[0], min(6, max(0, a[2] - own) * letters.scale), min(3, max(0, b[3] - own) * letters.scale), a[4], b[4]


def _name(t: str, s: Span, said: int) -> list[float]:
    """Wording (said: what it announces) and format of a name; the places of its score are left empty."""
    before = t[max(0, s.start - 24) : s.start]
    low = before.lower().rstrip(" \t (:")
    after = t[s.end : s.end + 3]
    initial = len(s.first) == 2 and s.first[1] == "."
    word = (low.rsplit(None, 1) or [""])[-1]  # what is before may be blank lines only
    nxt = after.lstrip("  ")[:1]
    return [
        bool(said & TITLE), bool(said & NAME), bool(said & PLACE), before[-1:] in ("", "\n", ",", " ") and (not low or before.rstrip(" ")[-1:] in ("\n", ",", "·")), nxt == "<", nxt in ",·(", before.rstrip("  ")[-1:] == ":",
        initial, *_NO_SCORE, s.first.lower() in _GROUP, s.last.lower() in _GROUP, s.first.isupper() and not initial, "-" in s.last, len(s.first), len(s.last), s.end - s.start, word.istitle(), after[:1] == "-", nxt.isalpha() and nxt.isupper(),
    ]


#: Features of a name from letters and counts, and their places.
_NO_SCORE, SCORE = (0.0,) * 7, slice(8, 15)


class Model(NamedTuple):
    """Letters of names and the trees of each kind (None: every candidate of the kind counts)."""

    letters: Letters
    trees: dict


_HEADER = re.compile(rf"(?m)^(?:From|To|Cc|Sender|Reply-To): *((?:[{_UP}]\.|[{_UP}][\w'’]+)(?:{_SP}[{_UP}]\.)*{_SP}[{_UP}][\w'’-]+) *<")
_REPLY = re.compile(rf"(?m)^(?:On .{{0,60}})?((?:[{_UP}]\.|[{_UP}][\w'’]+)(?:{_SP}[{_UP}]\.)*{_SP}[{_UP}][\w'’-]+) *<[^>\n]+> ?\w+ ?:")
_INITIAL = re.compile(r".\.$")


def _label_names(t: str, spans: list[Span], said: list[int]) -> list[int]:
    """1 for names that a mail header or a title announces, 0 for places and groups, -1 where the wording is silent."""
    known = {m.start(1) for p in (_HEADER, _REPLY) for m in p.finditer(t)} if "<" in t else set()
    out = []
    for s, announced in zip(spans, said):
        group = s.first.lower() in _GROUP or s.last.lower() in _GROUP
        if s.start in known and not group:
            out.append(1)
        elif known and any(0 < s.start - k < 40 for k in known):
            out.append(-1)
        elif group:
            out.append(0)
        elif announced & TITLE:
            out.append(1)
        else:
            out.append(0 if announced & PLACE and not announced & NAME else -1)
    return out


def _second(name: tuple, letters: Letters, other: dict) -> int:
    """The label after all wording was read: what a header announced once is a name elsewhere; words also written small, or after articles, are none."""
    *_, as_written, whole, y = name
    first, last = as_written.lower(), whole.lower().split("-")[0]
    if y == 1 or first in _GROUP or whole.lower() in _GROUP:
        return y
    if first in letters.small or last in letters.small:
        return 0
    if letters.givens.get(first, 0) * letters.scale >= 2 or len(first) == 2 and first[1] == "." and last in letters.families:
        return 1
    if len(first) == 2 and first[1] == ".":
        return -1
    return 0 if y == 0 or other.get(as_written, 0) * letters.scale > 1 else -1


#: Values of features are kept as whole multiples of 1/64; how many features each kind of span has.
_PART, WIDTH = 64, {"email": 10, "number": 29, "address": 19, "name": 25}


def _parts(rows: list, kind: str) -> np.ndarray:
    return np.clip(np.rint(np.array(rows, float).reshape(len(rows), WIDTH[kind]) * _PART), -32768, 32767).astype(np.int16)


class Block(NamedTuple):
    """Some rows, read: ids, texts, spans by kind (place of the row, start, end; for names also given name, family name, label) and their features; decoys are addresses that are none."""

    ids: list
    texts: list
    spans: dict
    features: dict
    decoys: np.ndarray

    def packed(self) -> bytes:
        return _pressed(marshal.dumps((self.ids, self.texts, self.spans, {k: v.tobytes() for k, v in self.features.items()}, self.decoys.tobytes())))


def _pressed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _loosened(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> Block:
    ids, texts, spans, features, decoys = marshal.loads(_loosened(data))
    of = lambda x, kind: np.frombuffer(x, np.int16).reshape(-1, WIDTH[kind])
    return Block(ids, texts, spans, {k: of(v, k) for k, v in features.items()}, of(decoys, "address"))


def _read(ids: list, texts: list[str], learn: bool = True) -> Block:
    """learn: whether labels and decoys are wanted."""
    spans: dict[str, list] = {k: [] for k in WIDTH}
    rows: dict[str, list] = {k: [] for k in WIDTH}
    decoys: list = []
    for d, t in enumerate(texts):
        c = candidates(t)
        ends = _ends(c) if c["number"] else []
        for kind, facts in (("email", _email), ("address", _address)):
            for s in c[kind]:
                spans[kind].append((d, s.start, s.end))
                rows[kind].append(facts(t, s))
        for s in c["number"]:
            spans["number"].append((d, s.start, s.end))
            rows["number"].append(_number(t, s, ends))
        said = [_said(t, s) for s in c["name"]]
        for s, announced, y in zip(c["name"], said, _label_names(t, c["name"], said) if learn else [-1] * len(said)):
            spans["name"].append((d, s.start, s.end, s.first, s.last, y))
            rows["name"].append(_name(t, s, announced))
        for s in c["address"] if learn else ():
            decoys += _decoys(t, s)
    return Block(ids, texts, spans, {k: _parts(v, k) for k, v in rows.items()}, _parts(decoys, "address"))


class _Small(dict):
    """The words written small in a string between blanks. No word goes over a blank, so every such string is read once only."""

    def __missing__(self, x: str) -> tuple:
        if len(self) > 200_000:
            self.clear()
        words = self[x] = tuple(w for w in _SMALL.findall(x) if w.islower())
        return words

    def of(self, text: str) -> set[str]:
        return set(chain.from_iterable(map(self.__getitem__, set(text.split()))))


def _counted(block: Block, known: _Small) -> dict[str, list[int]]:
    """How often words are given names, family names, other words in capitals, and in how many texts they are written small."""
    given, family, other, small = (Counter() for _ in range(4))
    for *_, first, last, y in block.spans["name"]:
        if y == 1:
            family.update(last.split("-"))
            if not _INITIAL.match(first):
                given[first] += 1
        elif y == 0:
            other.update((first, last))
    for t in block.texts:
        other.update(_PLACED.findall(t))
        small.update(known.of(t))
    out: dict[str, list[int]] = {}
    for k, counts in enumerate((given, family, other, small)):
        for w, n in counts.items():
            out.setdefault(w, [0] * 4)[k] = n
    return out


def _tables(words: dict) -> list[Counter]:
    """Letter triples of given names and of other words beside them, of family names and of other words beside them; each word counts three times at most."""
    out: list[Counter] = [Counter() for _ in range(4)]
    for word, (given, family, other, _) in words.items():
        if given or family or other:
            w = f"^{word.lower()}$"
            triples = [w[i : i + 3] for i in range(len(w))]
            for table, n in zip(out, (given, family + other, family, given + other)):
                if n:
                    n = min(n, 3)
                    for g in triples:
                        table[g] += n
    return out


def _known(words: dict, tables: list[Counter], rows: int) -> tuple[Letters, dict]:
    """The letters, and how often words are no names."""
    scale = min(1.0, PER / max(1, rows))
    givens, families = Counter(), Counter()
    for w, c in words.items():
        if c[0]:
            givens[w.lower()] += c[0]
        if c[1]:
            families[w.lower()] += c[1]
    small = frozenset(w for w, c in words.items() if c[3] * scale >= 3)
    often = frozenset(w for w, n in givens.items() if n * scale >= 2 and len(w) > 2 and w not in small)
    return Letters(_letters(*tables[:2]), _letters(*tables[2:]), dict(givens), dict(families), small, often, scale), {w: c[2] for w, c in words.items() if c[2] * scale > 1}


def _chance(key: np.ndarray, salt: int) -> np.ndarray:
    """A number from 0 to 1 for each key, the same wherever its row is."""
    with np.errstate(over="ignore"):
        x = key + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15)
        for by, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(by))) * np.uint64(times)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def _examples(block: Block, letters: Letters, other: dict, cache: dict) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Training rows by kind: features and weights (rows that trees are fitted to, positive ones of them, rows that calibrate, positive ones of them)."""
    ids = np.array([i or 0 for i in block.ids], np.int64).astype(np.uint64)

    def made(kind: str, spans: list, x: np.ndarray, y: np.ndarray, turn: int = 0):
        key = (ids[[s[0] for s in spans]] * np.uint64(1_000_003) + np.array([s[1] for s in spans], np.uint64)) * np.uint64(8) + np.uint64(turn)
        number = kind in ("phone", "id_number")
        hide, nothing = HIDDEN["number" if number else kind], [NOTHING.get(j, 0) * _PART if number else 0 for j in HIDDEN["number" if number else kind]]
        x, blank = x.copy(), np.ones(len(x), bool) if number else _chance(key, 1) < 0.5
        if kind == "name":
            # a name that no wording has announced yet must be known by its letters: in some rows the counts are hidden
            x[np.ix_(_chance(key, 2) < UNCOUNTED, COUNTED)] = 0
        hidden = x[blank]
        hidden[:, hide] = nothing
        hold = _chance(key, 3) < 0.2
        w = np.stack([~hold, ~hold & y, hold, hold & y], axis=1).astype(np.int64)
        # numbers of persons are few, so each is learnt both with and without its wording
        return kind, np.concatenate([x if number else x[~blank], hidden]), np.concatenate([w if number else w[~blank], w[blank]])

    names = [(k, n, y) for k, n in enumerate(block.spans["name"]) if (y := _second(n, letters, other)) >= 0]
    if names:
        x = block.features["name"][[k for k, *_ in names]]
        x[:, SCORE] = np.rint(np.array([_score(n[3], n[4], y, letters, cache) for _, n, y in names]) * _PART)
        yield made("name", [n for _, n, _ in names], x, np.array([y for *_, y in names], bool))
    if spans := block.spans["address"]:
        yield made("address", spans, block.features["address"], np.ones(len(spans), bool), 1)
        for k in range(each := len(block.decoys) // len(spans)):
            yield made("address", spans, block.decoys[k::each], np.zeros(len(spans), bool), 2 + k)
    if spans := block.spans["email"]:
        f = block.features["email"]
        yield made("email", spans, f, ~((f[:, 0] != 0) | (f[:, 8] != 0)))
    if spans := block.spans["number"]:
        f = block.features["number"]
        # what stands last before it; else what follows a mail or street address is a telephone number, and a date is neither
        kind = np.where(f[:, :3].max(axis=1) >= 0, f[:, :3].argmax(axis=1), np.where(f[:, -1] != 0, 0, np.where(f[:, 22] != 0, 2, -1)))
        told = np.flatnonzero(kind >= 0)
        if len(told):
            for k, name in enumerate(("phone", "id_number")):
                yield made(name, [spans[i] for i in told], f[told], kind[told] == k)


def _alike(parts: list[tuple[str, np.ndarray, np.ndarray]]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Training rows with the same features added up."""
    for kind in KINDS:
        if own := [p for p in parts if p[0] == kind]:
            x = np.ascontiguousarray(np.concatenate([p[1] for p in own]))
            w = np.concatenate([p[2] for p in own])
            _, first, at = np.unique(x.view(f"V{x.shape[1] * x.itemsize}").ravel(), return_index=True, return_inverse=True)
            yield kind, x[first], np.stack([np.bincount(at.ravel(), w[:, k], len(first)) for k in range(4)], axis=1).astype(np.int64)


def _values(kind: str, x: np.ndarray, w: np.ndarray) -> Iterator[tuple[str, int, int, int]]:
    """How often each feature has each value."""
    for j in range(x.shape[1]):
        v, at = np.unique(x[:, j], return_inverse=True)
        yield from ((kind, j, a, b) for a, b in zip(v.tolist(), np.bincount(at, w[:, 0] + w[:, 2]).astype(np.int64).tolist()))


def _edges(values: list[tuple[str, int, int, int]]) -> dict[str, list[np.ndarray]]:
    """Edges between the bins of each feature, by kind."""
    by: dict[str, dict[int, list]] = {}
    for kind, j, v, n in values:
        by.setdefault(kind, {}).setdefault(j, []).append((v, n))
    return {k: [boosting.edges_of(*map(np.array, zip(*x[j]))) for j in range(len(x))] for k, x in by.items()}


def train(texts: list[str]) -> Model:
    """The model of texts, as ``fit`` makes it of a table with their places as row_id."""
    block, cache = _read(list(range(len(texts))), texts), {}
    words = _counted(block, _Small())
    letters, other = _known(words, _tables(words), len(texts))
    alike = list(_alike(list(_examples(block, letters, other, cache))))
    edges = _edges([v for a in alike for v in _values(*a)])
    rows = {k: boosting.Rows(x, w.astype(float)) for k, x, w in _alike([(k, boosting.bins_of(x, edges[k]), w) for k, x, w in alike])}
    return _model(letters, edges, lambda f: boosting.summed([rows], f))


def _model(letters: Letters, edges: dict, total: Callable, keep: Callable | None = None) -> Model:
    """The model, with trees over the features as they are."""
    trees = boosting.grow(edges, total, keep=keep)
    return Model(letters, {k: (t := trees.get(k)) and t._replace(edge=t.edge / _PART) for k in KINDS})


_SMALL_NAME = re.compile(rf"([^\W\d_]+){_SP}(?:[^\W\d_]\.{_SP})*([^\W\d_][\w'’]+(?:-[^\W\d_][\w'’]+)*)(?![\w@+-]|\.\w)")
_SMALL = re.compile(r"(?<![\w@.+_-])[^\W\d_]{2,}(?![\w@+_-]|\.\w)")
_BEFORE_PLACES = "in near around from of à de aus um bei en em uit rond bij the der die das dem den des het le la el o a".split()
#: Single words in capitals after words of place. They are looked for at the blank, since most words of place have no such word after them.
_PLACED = re.compile(" (?:" + "|".join(rf"(?<=\b(?:{'|'.join(w for w in _BEFORE_PLACES if len(w) == n)}) )" for n in sorted({len(w) for w in _BEFORE_PLACES})) + rf")([{_UP}][\w'’]+)(?![\w'’-]| [{_UP}])")


#: The letters of the last model used by a worker, and the scores of names under them.
_KNOWN: list = [None, {}]


def find(model: Model, texts: list[str]) -> list[list[tuple[str, int, int, float]]]:
    """For each text its items: kind, start, end, probability; without overlaps, from left to right."""
    return _decided(model, _read([], texts, learn=False))


def _decided(model: Model, block: Block) -> list[list[tuple[str, int, int, float]]]:
    """``find`` for texts that are read."""
    texts, letters = block.texts, model.letters
    if _KNOWN[0] is not letters:
        _KNOWN[:] = [letters, {}]
    cache = _KNOWN[1]
    small = [(d, s.start, s.end, s.first, s.last, t, s) for d, t in enumerate(texts) for s in small_names(t, letters)]
    where = {"email": block.spans["email"], "phone": block.spans["number"], "id_number": block.spans["number"], "address": block.spans["address"], "name": [*block.spans["name"], *small]}
    names = np.concatenate([block.features["name"], _parts([_name(*x[5:], _said(*x[5:])) for x in small], "name")])
    if len(names):
        names[:, SCORE] = np.rint(np.array([_score(x[3], x[4], 0, letters, cache) for x in where["name"]]) * _PART)
    features = {"email": block.features["email"], "phone": block.features["number"], "id_number": block.features["number"], "address": block.features["address"], "name": names}
    kept: list[list] = [[] for _ in texts]
    for kind in KINDS:
        trees = model.trees.get(kind)
        p = boosting.predict(trees, features[kind] / _PART) if trees is not None else np.full(len(features[kind]), 0.9 if kind in ("email", "address") else 0.0)
        cut = trees.cut if trees is not None else 0.5
        for k in np.flatnonzero(p >= cut).tolist():
            d, start, end = where[kind][k][:3]
            if kind == "phone":
                while start < end and not (texts[d][start].isdigit() or texts[d][start] in "+("):
                    start += 1
            kept[d].append((kind, start, end, float(p[k])))
    out = []
    for items in kept:
        taken: list = []
        # an address or mail address holds numbers and words that could be something else
        # and of two names with one end the longer has the given name before the initials
        begins = {}
        for kind, start, end, _ in items:
            if kind == "name":
                begins[end] = min(start, begins.get(end, start))
        items = [x for x in items if x[0] != "name" or x[1] == begins[x[2]]]
        for it in sorted(items, key=lambda x: (x[0] not in ("email", "address"), -x[3], x[1])):
            if all(it[2] <= o[1] or it[1] >= o[2] for o in taken):
                taken.append(it)
        out.append(sorted(taken, key=lambda x: x[1]))
    return out


def blocks(rows: DataFrame) -> DataFrame:
    """The rows read, in blocks, with how many of them have a text and the counts of their words."""
    kind = pa.list_(pa.struct([("word", pa.string()), *((k, pa.int64()) for k in ("given", "family", "other", "small"))]))

    def make(batches):
        known = _Small()
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                texts = part.column(1).to_pylist()
                block = _read(part.column(0).to_pylist(), [t or "" for t in texts])
                words = [dict(zip(("word", "given", "family", "other", "small"), (w, *c))) for w, c in _counted(block, known).items()]
                yield pa.RecordBatch.from_arrays([pa.array([block.packed()], pa.binary()), pa.array([sum(t is not None for t in texts)], pa.int64()), pa.array([words], kind)], names=["block", "texts", "words"])

    return checkpoint(rows.select("row_id", "text").mapInArrow(make, "block binary, texts bigint, words array<struct<word:string,given:bigint,family:bigint,other:bigint,small:bigint>>"))


def _vocabulary(read: DataFrame) -> tuple[Letters, dict]:
    """Letters and counts of words over all blocks. Only words that are names, or no names often, reach the driver."""
    n = read.agg(F.sum("texts")).first()[0] or 0
    scale = min(1.0, PER / max(1, n))
    kinds = ("given", "family", "other", "small")
    words = checkpoint(read.select(F.explode("words").alias("w")).groupBy("w.word").agg(*(F.sum(f"w.{k}").alias(k) for k in kinds)))

    def triples(batches):
        for batch in batches:
            tables = _tables({w: (g, f, o, 0) for w, g, f, o in zip(*(c.to_pylist() for c in batch.columns))})
            rows = [(k, g, c) for k, t in enumerate(tables) for g, c in t.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["k", "triple", "n"])

    tables: list[Counter] = [Counter() for _ in range(4)]
    for k, g, c in words.where("given + family + other > 0").select("word", "given", "family", "other").mapInArrow(triples, "k int, triple string, n bigint").groupBy("k", "triple").agg(F.sum("n").alias("n")).collect():
        tables[k][g] = c
    some = words.where((F.col("given") > 0) | (F.col("family") > 0) | (F.col("other") * F.lit(scale) > 1) | (F.col("small") * F.lit(scale) >= 3)).select("word", *kinds).collect()
    return _known({r[0]: tuple(r[1:]) for r in some}, tables, n)


_BINNED = "kind string, x binary, w0 bigint, w1 bigint, w2 bigint, w3 bigint"


def _batch(kind: str, x: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    each = pa.Array.from_buffers(pa.binary(x.shape[1]), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(x), pa.string()), each, *(pa.array(w[:, k], pa.int64()) for k in range(4))], names=["kind", "x", "w0", "w1", "w2", "w3"])


def _of_batch(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    kinds, xs = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
    w = np.stack([batch.column(2 + k).to_numpy() for k in range(4)], axis=1)
    for kind in KINDS:
        at = np.flatnonzero(kinds == kind)
        if len(at):
            yield kind, np.frombuffer(b"".join([xs[i] for i in at]), np.uint8).reshape(len(at), -1), w[at]


def learn(read: DataFrame, together: int = TOGETHER) -> Model:
    """The model of all rows in ``blocks``."""
    letters, other = _vocabulary(read)
    shared = read.sparkSession.sparkContext.broadcast((letters, other))

    def examples(batches):
        cache: dict = {}
        for batch in batches:
            for a in range(0, batch.num_rows, 16):
                parts = [p for data in batch.column(0)[a : a + 16] for p in _examples(_unpacked(data.as_py()), *shared.value, cache)]
                rows = [(kind, _pressed(x.tobytes()), _pressed(w.tobytes())) for kind, x, w in _alike(parts)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.binary(), pa.binary()))], names=["kind", "x", "w"])

    def read_again(batch):
        for kind, x, w in zip(*(c.to_pylist() for c in batch.columns)):
            yield kind, np.frombuffer(_loosened(x), np.int16).reshape(-1, WIDTH.get(kind, WIDTH["number"])), np.frombuffer(_loosened(w), np.int64).reshape(-1, 4)

    def values(batches):
        for batch in batches:
            rows = [v for a in read_again(batch) for v in _values(*a)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64()))], names=["kind", "j", "v", "n"])

    alike = checkpoint(read.select("block").mapInArrow(examples, "kind string, x binary, w binary"))
    edges = _edges([tuple(r) for r in alike.mapInArrow(values, "kind string, j int, v int, n bigint").groupBy("kind", "j", "v").agg(F.sum("n")).collect()])

    def binned(batches):
        for batch in batches:
            for a in _alike([(kind, boosting.bins_of(x, edges[kind]), w) for kind, x, w in read_again(batch)]):
                yield _batch(*a)

    def together_by_kind(batches):
        for batch in batches:
            rows = [(kind, len(x), x.tobytes(), w.astype(float).tobytes(), None, 0) for kind, x, w in _of_batch(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    names, types = ["kind", "n", "x", "w", "margin", "trees"], (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32())
    schema = "kind string, n bigint, x binary, w binary, margin binary, trees int"
    # rows that are alike to the trees, in the same bins, are added up: names have many counts and few bins
    bins = checkpoint(alike.mapInArrow(binned, _BINNED).groupBy("kind", "x").agg(*(F.sum(f"w{k}").alias(f"w{k}") for k in range(4))).mapInArrow(together_by_kind, schema))
    of = lambda n, x, w, margin, trees: boosting.Rows(np.frombuffer(x, np.uint8).reshape(n, -1), np.frombuffer(w, float).reshape(n, 4), None if margin is None else np.frombuffer(margin, float).copy(), trees)
    if (bins.agg(F.sum("n")).first()[0] or 0) <= together:
        got: dict[str, list] = {}
        for kind, *x in bins.collect():
            got.setdefault(kind, []).append(of(*x))
        rows = {k: boosting.Rows(np.concatenate([r.binned for r in v]), np.concatenate([r.weights for r in v])) for k, v in got.items()}
        return _model(letters, edges, lambda f: boosting.summed([rows], f))

    def total(f: Callable) -> dict:
        def add(batches):
            sums = boosting.summed(({kind: of(*x)} for batch in batches for kind, *x in zip(*(c.to_pylist() for c in batch.columns))), f)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(sums)], pa.binary())], names=["sums"])

        return boosting.summed([pickle.loads(r[0]) for r in bins.mapInArrow(add, "sums binary").collect()], lambda _, x: x)

    def keep(f: Callable) -> None:
        def grown(batches):
            for batch in batches:
                rows = []
                for kind, n, x, w, *known in zip(*(c.to_pylist() for c in batch.columns)):
                    r = of(n, x, w, *known)
                    m = f(kind, r)
                    rows.append((kind, n, x, w, m if m is None else m.tobytes(), r.trees))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

        nonlocal bins
        bins = checkpoint(bins.mapInArrow(grown, schema))

    return _model(letters, edges, total, keep)


def fit(rows: DataFrame) -> Model:
    """The model of all rows."""
    return learn(blocks(rows))


_ITEMS = "row_id bigint, items array<struct<kind:string,start_char:int,end_char:int,probability:double>>"


def _listed(ids: list, found: list) -> pa.RecordBatch:
    """The rows with any items."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("probability", pa.float64())]))
    some = [i for i, x in enumerate(found) if x]
    values = [[dict(zip(("kind", "start_char", "end_char", "probability"), x)) for x in found[i]] for i in some]
    return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in some], pa.int64()), pa.array(values, kind)], names=["row_id", "items"])


def items(rows: DataFrame, model: Model | None = None) -> DataFrame:
    """row_id, items (kind, start_char, end_char, probability) of every row with any; positions are code points from 0. Null texts have none. Without a model, the one of the rows."""
    read = blocks(rows) if model is None else None
    shared = rows.sparkSession.sparkContext.broadcast(model or learn(read))

    def make(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                yield _listed(part.column(0).to_pylist(), find(shared.value, [t or "" for t in part.column(1).to_pylist()]))

    def decide(batches):
        for batch in batches:
            for data in batch.column(0):
                block = _unpacked(data.as_py())
                yield _listed(block.ids, _decided(shared.value, block))

    return rows.select("row_id", "text").mapInArrow(make, _ITEMS) if read is None else read.select("block").mapInArrow(decide, _ITEMS)


def found(rows: DataFrame, model: Model | None = None) -> DataFrame:
    """row_id, kind, start_char of every item."""
    each = items(rows, model).select("row_id", F.explode("items").alias("i"))
    return each.select("row_id", F.col("i.kind").alias("kind"), F.col("i.start_char").alias("start_char"))


def redact(rows: DataFrame, model: Model | None = None) -> DataFrame:
    """row_id, text with placeholders, email_addresses (whether a mail address was found) and the number of items; every row, null texts stay null."""
    got = items(rows, model)
    both = rows.select("row_id", "text").join(got, "row_id", "left")

    def make(batches):
        for batch in batches:
            ids, texts, lists = (batch.column(i).to_pylist() for i in range(3))
            out = []
            for t, found_items in zip(texts, lists):
                at, piece = 0, []
                for x in found_items or ():
                    piece += [t[at : x["start_char"]], PLACEHOLDER[x["kind"]]]
                    at = x["end_char"]
                out.append(None if t is None else "".join(piece) + t[at:])
            has = [any(x["kind"] == "email" for x in i or ()) for i in lists]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string()), pa.array(has), pa.array([len(i or ()) for i in lists], pa.int32())], names=["row_id", "text", "email_addresses", "items"])

    return both.mapInArrow(make, "row_id bigint, text string, email_addresses boolean, items int")
