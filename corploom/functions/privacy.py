"""Privacy redaction of texts until nothing more is found, as an Arrow function; meta and other JSON values as well."""

from __future__ import annotations

import ipaddress
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from . import text as T

#: Placeholders, passes at most, and names of routing headers.
PLACEHOLDERS = {"email": "<EMAIL_ADDRESS>", "ip": "<IP_ADDRESS>", "phone": "<PHONE_NUMBER>", "credential": "<CREDENTIAL>"}
PASSES = 8
ROUTING = (
    "received", "return-path", "x-originating-ip", "authentication-results", "arc-authentication-results", "arc-message-signature", "arc-seal", "dkim-signature", "received-spf", "x-received", "delivered-to", "message-id",
)

COUNTS = ("emails", "ips", "phones", "headers", "credentials")

_KEY = re.compile(T.PRIVATE_KEY)
_CREDENTIAL = re.compile(T.CREDENTIAL, re.ASCII)
#: What a text with a valid address has: four numbers with dots, two colons in a row, or seven groups with colons.
_MAYBE_IP = re.compile(r"::|\d\.\d{1,3}\.\d{1,3}\.\d|(?:[0-9A-Fa-f]{1,4}:){7}")
_EMAIL, _IP, _PHONE = re.compile(T.EMAIL), re.compile(T.IP), re.compile(T.PHONE)


def _is_ip(found: str) -> bool:
    bare = found.strip("[].,;()")
    if "." not in bare and ":" not in bare:
        return False
    try:
        ipaddress.ip_address(bare)
    except ValueError:
        return False
    return True


def _is_phone(found: str) -> bool:
    n = sum(c.isdigit() for c in found)
    return n <= 15 and (n >= 10 or n >= 7 and (found[0] == "+" or "(" in found or ")" in found))


def _headers(text: str) -> tuple[str, int]:
    """text without routing headers of a leading header block of two fields or more, and their number."""
    end = text.find("\r\n\r\n")
    if end < 0:
        end = text.find("\n\n")
    if end <= 0:
        return text, 0
    newline = "\r\n" if "\r\n" in text[:end] else "\n"
    groups: list[list[str]] = []  # a field and its folded lines
    for line in text[:end].split(newline):
        if line[:1] in (" ", "\t") and line and groups:
            groups[-1].append(line)
        else:
            groups.append([line])
    named = [g[0].partition(":")[0] if ":" in g[0] and g[0][:1] not in (" ", "\t", "") else "" for g in groups]
    if sum(n != "" for n in named) < 2:
        return text, 0
    kept = [g for g, n in zip(groups, named) if n.strip().lower() not in ROUTING]
    if len(kept) == len(groups):
        return text, 0
    return newline.join(x for g in kept for x in g) + text[end:], len(groups) - len(kept)


def redact_text(text: str) -> tuple[str, list[int]]:
    """The redacted text and the counts (COUNTS). Passes repeat until one finds nothing; more than PASSES is an error."""
    total = [0] * 5
    for _ in range(PASSES + 1):
        text, n = _headers(text)
        found = [0, 0, 0, n, 0]

        def put(name: str, at: int, valid=None):
            def swap(m: re.Match) -> str:
                if valid is not None and not valid(m.group()):
                    return m.group()
                found[at] += 1
                return PLACEHOLDERS[name]

            return swap

        text = _KEY.sub(put("credential", 4), text)
        text = _CREDENTIAL.sub(put("credential", 4), text)
        text = _EMAIL.sub(put("email", 0), text)
        if _MAYBE_IP.search(text):
            text = _IP.sub(put("ip", 1, _is_ip), text)
        text = _PHONE.sub(put("phone", 2, _is_phone), text)
        if not any(found):
            return text, total
        total = [a + b for a, b in zip(total, found)]
    raise ValueError(f"redaction did not settle within {PASSES} passes: {total}")


def redact_json(document: str) -> tuple[str, list[int]]:
    """A JSON document with every string value (not keys) redacted; keys sorted; what is not JSON is redacted as text."""
    try:
        value = json.loads(document)
    except ValueError:
        return redact_text(document)
    total = [0] * 5

    def walk(v):
        if isinstance(v, str):
            new, n = redact_text(v)
            total[:] = [a + b for a, b in zip(total, n)]
            return new
        if isinstance(v, list):
            return [walk(x) for x in v]
        if isinstance(v, dict):
            return {k: walk(x) for k, x in v.items()}
        return v

    new = walk(value)
    if not any(total):
        return document, total
    dumped = json.dumps(new, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    for char, escape in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        dumped = dumped.replace(char, escape)
    return dumped, total


def redact_conversation(document: str) -> tuple[str, list[int]]:
    """A conversation ({"messages": [...], "tools": ...}) with every content and context redacted by itself, so that no header block runs across messages."""
    value = json.loads(document)
    total = [0] * 5
    for m in value["messages"]:
        for key in ("content", "context"):
            if m.get(key):
                m[key], n = redact_text(m[key])
                total = [a + b for a, b in zip(total, n)]
    if value.get("tools"):
        value["tools"], n = redact_json(value["tools"]) if isinstance(value["tools"], str) else (lambda r: (json.loads(r[0]), r[1]))(redact_json(json.dumps(value["tools"])))
        total = [a + b for a, b in zip(total, n)]
    return (json.dumps(value, ensure_ascii=False, separators=(",", ":")) if any(total) else document), total


_SCHEMA = "text string, " + ", ".join(f"{c} bigint" for c in COUNTS)


def _function(one):
    @F.pandas_udf(_SCHEMA)
    def apply(s: pd.Series) -> pd.DataFrame:
        rows = [(None, *[0] * 5) if t is None else (lambda r: (r[0], *r[1]))(one(t)) for t in s]
        return pd.DataFrame(rows, columns=["text", *COUNTS])

    return apply


def redacted(text: Column) -> Column:
    """struct(text, emails, ips, phones, headers, credentials); null texts stay null with counts 0."""
    return _function(redact_text)(text)


def redacted_conversation(document: Column) -> Column:
    """The same for conversations kept as JSON."""
    return _function(redact_conversation)(document)


def redacted_json(document: Column) -> Column:
    """The same for JSON documents (meta, tools)."""
    return _function(redact_json)(document)


def eightgram_share(words: list[str]) -> float:
    """The share of words in repeated 8-grams: a repeated one counts 8 words and is skipped as a whole."""
    seen: set = set()
    i = repeated = 0
    while i + 8 <= len(words):
        gram = tuple(words[i : i + 8])
        if gram in seen:
            repeated += 8
            i += 8
        else:
            seen.add(gram)
            i += 1
    return repeated / len(words) if len(words) >= 8 else 0.0


@F.pandas_udf(BooleanType())
def is_repetitive(words: pd.Series) -> pd.Series:
    """The repetition flag over arrays of words: fifty words or more, and a frequent 3-gram or repeated 8-grams."""

    def one(w) -> bool:
        if w is None or len(w) < T.LEAST_WORDS:
            return False
        w = list(w)
        counts: dict = {}
        for g in zip(w, w[1:], w[2:]):
            counts[g] = counts.get(g, 0) + 1
        return max(counts.values()) * 3 / len(w) > T.TOP_TRIGRAM or eightgram_share(w) > T.DUPLICATE_EIGHTGRAM

    return words.map(one)


@F.pandas_udf(StringType())
def truncate_utf8(text: pd.Series, limit: pd.Series) -> pd.Series:
    """The longest prefix of whole characters within a number of bytes."""
    return pd.Series([None if t is None else t.encode()[: int(n)].decode("utf-8", "ignore") for t, n in zip(text, limit)])
