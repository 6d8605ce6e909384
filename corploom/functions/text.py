"""Column functions over a document's text: digests, counts, flags, licences, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The mail address pattern of the content flag (case does not matter).
EMAIL = r"[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)+"

#: Private keys, credentials, candidates of IP addresses and telephone numbers. White space is spelled out so that engines agree.
PRIVATE_KEY = r"(?s)-----BEGIN (?:[A-Z0-9 ]+ )?PRIVATE KEY-----.*?-----END (?:[A-Z0-9 ]+ )?PRIVATE KEY-----"
CREDENTIAL = r"""(?i)authorization[\t\n\f\r ]*:[\t\n\f\r ]*(?:bearer|basic)[\t\n\f\r ]+[A-Za-z0-9._~+/=-]+|(?:password|passwd|api[_-]?key|access[_-]?token|secret)[\t\n\f\r ]*[:=][\t\n\f\r ]*(?:"[^"\r\n]{8,}"|'[^'\r\n]{8,}'|[A-Za-z0-9_./+=-]{16,})|\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,})\b"""
IP = r"\[?[0-9A-Fa-f:.]*[0-9A-Fa-f][0-9A-Fa-f:.]*\]?"
PHONE = r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{2,4}[ .-][0-9]{3,4}"

#: Unicode white space, the characters at which fields are split.
WHITE = r"[\t\n\x0B\f\r \x{85}\p{Z}]"

#: Thresholds of the boilerplate and repetition flags.
LEAST_ELEMENTS, DUPLICATE_ELEMENTS, DUPLICATE_BYTES = 4, 0.30, 0.20
LEAST_WORDS, TOP_TRIGRAM, DUPLICATE_EIGHTGRAM = 50, 0.18, 0.12

#: Licence names and their identifiers (compared without case).
LICENSES = {
    "apache 2 license - https://www.apache.org/licenses/license-2.0": "Apache-2.0",
    "bsd 2-clause": "BSD-2-Clause",
    "bsd 3-clause": "BSD-3-Clause",
    "community data license agreement - permissive 1.0 - https://cdla.dev/": "CDLA-Permissive-1.0",
    "isc license": "ISC",
    "mit license": "MIT",
    "public domain": "LicenseRef-Public-Domain",
}


def text_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, lower-case hexadecimal."""
    return F.sha2(text, 256)


def has_email(text: Column) -> Column:
    """Whether a mail address occurs; null texts have none."""
    return F.coalesce(text.rlike(EMAIL), F.lit(False))


def redact(text: Column, pattern: str, placeholder: str) -> Column:
    """text with every match replaced; whole matches, as often as they occur."""
    return F.regexp_replace(text, pattern, placeholder)


def redact_if(text: Column, pattern: str, placeholder: str, valid) -> Column:
    """struct(text, n): matches that pass ``valid`` replaced, all inside the JVM: the text is split at the matches and joined again."""
    between, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    new = F.transform(hits, lambda m: F.when(valid(m), F.lit(placeholder)).otherwise(m))
    parts = F.zip_with(between, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.struct(F.array_join(parts, "").alias("text"), F.size(F.filter(hits, valid)).cast("long").alias("n"))


def likely_phone(match: Column) -> Column:
    """Ten to fifteen digits, or seven to fifteen with a leading + or any bracket."""
    digits = F.length(F.regexp_replace(match, "[^0-9]", ""))
    return (digits <= 15) & ((digits >= 10) | ((digits >= 7) & (match.startswith("+") | match.contains("(") | match.contains(")"))))


def valid_ipv4(match: Column) -> Column:
    """A dotted quad without leading zeros, after trimming brackets and punctuation."""
    bare = F.regexp_replace(match, r"^[\[\].,;()]+|[\[\].,;()]+$", "")
    return bare.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$")


def elements(text: Column, paragraphs: bool = False) -> Column:
    """Non-blank lines (or paragraphs) with white space collapsed."""
    parts = F.split(F.regexp_replace(text, rf"^{WHITE}+|{WHITE}+$", ""), r"\n(?:[\t\x0B\f\r \x{85}\p{Z}]*\n)+", -1) if paragraphs else F.split(text, "\n", -1)
    return F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(x, rf"{WHITE}+", " "))), lambda x: x != "")


def is_boilerplate(text: Column, paragraphs: bool = False) -> Column:
    """At least four elements, of which more than 30 % are duplicates or hold more than 20 % of the text's bytes."""
    e = elements(text, paragraphs)
    d = F.array_distinct(e)
    size = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.octet_length(x))
    share = (F.size(e) - F.size(d)) / F.size(e)
    heavy = (size(e) - size(d)) / F.octet_length(text)
    return F.coalesce((F.size(e) >= LEAST_ELEMENTS) & ((share > DUPLICATE_ELEMENTS) | (heavy > DUPLICATE_BYTES)), F.lit(False))


def words(text: Column) -> Column:
    """Lower-case runs of letters and numbers."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def normalize_license(raw: Column) -> Column:
    """Known licence names, Creative Commons addresses and short names as identifiers; anything else trimmed."""
    v = F.regexp_replace(raw, rf"^{WHITE}+|{WHITE}+$", "")
    known = F.create_map(*[F.lit(x) for pair in LICENSES.items() for x in pair])[F.lower(v)]
    url = r"(?i)https?://creativecommons\.org/licenses/([a-z-]+)/([0-9.]+)"
    zero = r"(?i)https?://creativecommons\.org/publicdomain/zero/([0-9.]+)"
    name = r"(?i)^CC[ _-]*(BY(?:[ _-]*(?:NC|ND|SA)){0,2}|ZERO|0)[ _-]*([0-9]+(?:\.[0-9]+)?)$"
    short = F.regexp_replace(F.upper(F.regexp_extract(v, name, 1)), "[ _]", "-")
    return (
        F.when(known.isNotNull(), known)
        .when(v.rlike(url), F.concat(F.lit("CC-"), F.upper(F.regexp_extract(v, url, 1)), F.lit("-"), F.regexp_extract(v, url, 2)))
        .when(v.rlike(zero), F.concat(F.lit("CC0-"), F.regexp_extract(v, zero, 1)))
        .when(v.rlike(name) & short.isin("ZERO", "0"), F.concat(F.lit("CC0-"), F.regexp_extract(v, name, 2)))
        .when(v.rlike(name), F.concat(F.lit("CC-"), short, F.lit("-"), F.regexp_extract(v, name, 2)))
        .otherwise(v)
    )


def license_set(raw: Column) -> Column:
    """An array of raw licences as one conjunction: normalised, blank and repeated terms dropped, sorted, joined with AND."""
    terms = F.filter(F.transform(raw, normalize_license), lambda x: x.isNotNull() & (x != ""))
    return F.array_join(F.array_sort(F.array_distinct(terms)), " AND ")


def normalize_raw_license(raw: Column) -> Column:
    """A raw licence, or a JSON list of them as one conjunction; null stays null."""
    terms = F.when(F.trim(raw).startswith("["), F.from_json(raw, "array<string>"))
    return F.when(terms.isNotNull(), license_set(terms)).otherwise(normalize_license(raw))


def json_string(text: Column) -> Column:
    """text as a JSON string: quotes, backslashes and control characters escaped, everything else verbatim."""
    s = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for char, short in (("\b", "\\b"), ("\t", "\\t"), ("\n", "\\n"), ("\f", "\\f"), ("\r", "\\r")):
        s = F.replace(s, F.lit(char), F.lit(short))
    for code in [*range(0x00, 0x08), 0x0B, *range(0x0E, 0x20)]:
        s = F.replace(s, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), s, F.lit('"'))


def canonical_json(c: dict[str, Column]) -> Column:
    """One canonical JSON object per row: fixed key order, optional keys left out when null, empty or zero, meta verbatim."""
    pairs = [F.concat(F.lit('"sha256":"'), c["sha256"], F.lit('"')), F.lit('"kind":"pretrain"')]
    for key in ("text", "source"):
        pairs.append(F.concat(F.lit(f'"{key}":'), json_string(c[key])))
    for key in ("source_name", "license", "license_raw", "lang"):
        pairs.append(F.when(c[key] != "", F.concat(F.lit(f'"{key}":'), json_string(c[key]))))
    pairs.append(F.when(c["lang_score"] != 0, F.concat(F.lit('"lang_score":'), c["lang_score"].cast("string"))))
    pairs.append(F.when(c["date"] != "", F.concat(F.lit('"date":'), json_string(c["date"]))))
    pairs.append(F.when(c["tokens"] != 0, F.concat(F.lit('"tokens":'), c["tokens"].cast("string"))))
    pairs.append(F.when(c["meta"] != "", F.concat(F.lit('"meta":'), c["meta"])))
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))


def byte_ids(text: Column) -> Column:
    """Ids of the byte tokenizer: every byte plus 3 (0 pads, 1 begins, 2 ends)."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int") + 3)


def render(messages: Column, template: str) -> Column:
    """A conversation (array of struct role, content, context) as text: user-assistant-v1 or chatml-v1."""
    body = lambda m: F.when(F.coalesce(m["context"], F.lit("")) != "", F.concat(m["content"], F.lit("\n\n"), m["context"])).otherwise(m["content"])
    if template == "user-assistant-v1":
        one = lambda m: F.concat(F.initcap(m["role"]), F.when(m["role"] == "assistant", ":").otherwise(": "), body(m))
        return F.array_join(F.transform(messages, one), "\n\n")
    if template == "chatml-v1":
        return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), body(m), F.lit("<|im_end|>\n"))), "")
    raise ValueError(f"unknown template {template!r}")


def with_tools(messages: Column, tools: Column) -> Column:
    """messages with the tools put into the leading system message, or before the first message."""
    note = F.concat(F.lit("Available tools:\n"), tools)
    first = messages[0]
    merged = F.struct(first["role"].alias("role"), F.concat(F.regexp_replace(first["content"], "\n+$", ""), F.lit("\n\n"), note).alias("content"), first["context"].alias("context"))
    new = F.struct(F.lit("system").alias("role"), note.alias("content"), F.lit(None).cast("string").alias("context"))
    rest = F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0)))
    return F.when(F.coalesce(tools, F.lit("")) == "", messages).when(first["role"] == "system", F.concat(F.array(merged), rest)).otherwise(F.concat(F.array(new), messages))


def segments(messages: Column, template: str, supervised: tuple[str, ...] = ("assistant",)) -> Column:
    """A rendered conversation in pieces: array of struct(text, supervised). The end marker of a message goes with its content."""
    body = lambda m: F.when(F.coalesce(m["context"], F.lit("")) != "", F.concat(m["content"], F.lit("\n\n"), m["context"])).otherwise(m["content"])
    piece = lambda t, s: F.struct(t.alias("text"), s.alias("supervised"))
    no = F.lit(False)
    if template == "user-assistant-v1":
        marker = lambda m, i: F.concat(F.when(i > 0, F.lit("\n\n")).otherwise(F.lit("")), F.initcap(m["role"]), F.when(m["role"] == "assistant", ":").otherwise(": "))
        one = lambda m, i: F.array(piece(marker(m, i), no), piece(body(m), m["role"].isin(*supervised)))
    elif template == "chatml-v1":
        one = lambda m, i: F.array(piece(F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n")), no), piece(F.concat(body(m), F.lit("<|im_end|>\n")), m["role"].isin(*supervised)))
    else:
        raise ValueError(f"unknown template {template!r}")
    return F.flatten(F.transform(messages, one))


def byte_mask(messages: Column, template: str, causal: bool = False, supervised: tuple[str, ...] = ("assistant",)) -> Column:
    """Whether each byte token of a rendered conversation is a target, and the end token: it follows the last message's role; all are, if causal."""
    parts = segments(messages, template, supervised)
    flags = F.flatten(F.transform(parts, lambda p: F.array_repeat(p["supervised"] | F.lit(causal), F.octet_length(p["text"]))))
    return F.concat(flags, F.array(F.element_at(messages, -1)["role"].isin(*supervised) | F.lit(causal)))
