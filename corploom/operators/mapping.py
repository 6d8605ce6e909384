"""Mapping raw JSON records to canonical records by a declared profile."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of roles in conversations.
ROLES = {"system": "system", "user": "user", "human": "user", "prompter": "user", "assistant": "assistant", "gpt": "assistant", "bot": "assistant", "model": "assistant", "tool": "tool", "function": "tool"}


class Spelled(str):
    """A JSON number as it is written."""


def load(raw: str):
    """A JSON value whose numbers keep their spelling (2.50, 1e5)."""

    def no(name):
        raise ValueError(f"{name} is no JSON")

    return json.loads(raw, parse_float=Spelled, parse_int=Spelled, parse_constant=no)


def values(record, path: str) -> list[str]:
    """Scalars below a dotted path, [] after a name for every element of an array; nulls are left out, other values raise."""
    found = [record]
    for step in path.split("."):
        many = step.endswith("[]")
        name = step.removesuffix("[]")
        below = [x[name] for x in found if isinstance(x, dict) and x.get(name) is not None]
        found = [y for x in below for y in (x if isinstance(x, list) else [x])] if many else below
    out = []
    for x in found:
        if x is None:
            continue
        if isinstance(x, (dict, list)):
            raise ValueError(f"{path} is not a scalar")
        out.append(str(x) if isinstance(x, str) else json.dumps(x))
    return out


@dataclass(frozen=True)
class Profile:
    """What each canonical field is made of. kind: record, dialogue, chat or tree.

    text: paths joined by blank lines (record), or the user's text, context and response (dialogue), or roles and
    contents (chat), or the path of the tree's root (tree). main: scalars that must all be equal for main content.
    on_empty: skip (an empty text is an outcome) or fail (it ends the job). longest: bytes beyond which a text is a
    mapping error.
    """

    kind: str = "record"
    text: tuple[str, ...] = ("text",)
    fallback: str | None = None
    source: str | None = None
    source_id: str | None = None
    license: tuple[str, ...] = ()
    language: str | None = None
    date: str | None = None
    meta: dict = field(default_factory=dict)
    main: dict = field(default_factory=dict)
    nul: str = "space"
    on_empty: str = "skip"
    longest: int | None = None
    system: str | None = None
    source_order: bool = False

    def __post_init__(self):
        if self.kind not in ("record", "dialogue", "chat", "tree") or self.nul not in ("space", "error") or self.on_empty not in ("skip", "fail"):
            raise ValueError(f"unknown kind {self.kind!r} or NUL policy {self.nul!r}")
        if self.kind == "chat" and len(self.text) != 2 or self.kind == "dialogue" and len(self.text) not in (2, 3):
            raise ValueError("a chat needs the paths of roles and contents, a dialogue those of text, (context,) response")


def columns(p: Profile) -> list[str]:
    """The top-level fields that a profile reads, in order of their names."""
    paths = [*p.text, p.fallback, p.source, p.source_id, *p.license, p.language, p.date, *p.meta.values(), *p.main, p.system]
    return sorted({x.split(".")[0].removesuffix("[]") for x in paths if x})


def _one(record, path: str | None) -> str:
    got = values(record, path) if path else []
    if len(got) > 1:
        raise ValueError(f"{path} has more than one value")
    return got[0] if got else ""


def chat(roles: list[str], contents: list[str], system: str = "") -> list[dict]:
    """Messages from roles and contents; at least one of the user and one of the assistant."""
    if len(roles) != len(contents):
        raise ValueError("roles and contents differ in number")
    messages = [{"role": "system", "content": system}] if system.strip() else []
    for r, c in zip(roles, contents):
        if r.lower() not in ROLES:
            raise ValueError(f"unknown role {r!r}")
        messages.append({"role": ROLES[r.lower()], "content": c})
    said = {m["role"] for m in messages}
    if not {"user", "assistant"} <= said:
        raise ValueError("a conversation needs a user and an assistant")
    return messages


def ranked_path(root: dict, source_order: bool = False) -> list[dict]:
    """The conversation from the root along the replies of lowest rank; the first of equals; unranked replies only in source order."""
    messages, node = [], root
    while True:
        role = "user" if len(messages) % 2 == 0 else "assistant"
        messages.append({"role": role, "content": node["text"]})
        replies = node.get("replies") or []
        ranked = [r for r in replies if r.get("rank") is not None]
        if ranked:
            node = min(ranked, key=lambda r: float(r["rank"]))
        elif replies and source_order:
            node = replies[0]
        elif replies:
            raise ValueError("replies without rank")
        else:
            break
    if len(messages) % 2:
        messages.pop()
    if not messages:
        raise ValueError("the tree has no reply")
    return messages


def map_one(raw: str, p: Profile) -> dict:
    """One record: outcome (ok, empty, malformed), text and the other fields."""
    try:
        record = load(raw)
        if not isinstance(record, dict):
            raise ValueError("not an object")
    except ValueError as e:
        return {"outcome": "malformed", "error": str(e)}
    try:
        messages = None
        if p.kind == "record":
            parts = [v for path in p.text for v in values(record, path) if v.strip()]
            text = "\n\n".join(parts) or (_one(record, p.fallback) if p.fallback else "")
        elif p.kind == "dialogue":
            parts = [_one(record, x) for x in p.text]
            user, context, response = parts if len(parts) == 3 else (parts[0], "", parts[1])
            messages = [{"role": "user", "content": user} | ({"context": context} if context else {}), {"role": "assistant", "content": response}] if response.strip() else []
        elif p.kind == "chat":
            messages = chat(values(record, p.text[0]), values(record, p.text[1]), _one(record, p.system))
        else:
            messages = ranked_path(record[p.text[0]] if p.text[0] in record else record, p.source_order)
        if messages is not None:
            text = json.dumps({"messages": messages}, ensure_ascii=False, separators=(",", ":")) if messages else ""
        if not text.strip():
            if p.on_empty == "fail":
                raise KeyError("a record has no text")
            return {"outcome": "empty"}
        if p.longest is not None and len(text.encode()) > p.longest:
            raise ValueError(f"the text has more than {p.longest} bytes")
        if "\0" in text:
            if p.nul == "error":
                raise ValueError("the text has a NUL character")
            text = text.replace("\0", " ")
        meta = {} if messages is None else {"format": "structured-conversation", "turns": len(messages)}
        for name, path in p.meta.items():
            got = values(record, path)
            if got:
                meta[name] = got[0] if len(got) == 1 else got
        main = True
        for path, wanted in p.main.items():
            got = values(record, path)
            if len(got) != 1:
                raise KeyError(f"{path} must have one value")
            main &= got[0] == wanted
        return {
            "outcome": "ok", "text": text, "kind": "pretrain" if messages is None else "conversation", "source": _one(record, p.source), "source_id": _one(record, p.source_id), "licenses": [v for x in p.license for v in values(record, x)],
            "language": _one(record, p.language) or None, "date": _one(record, p.date) or None, "meta": json.dumps(meta, ensure_ascii=False, sort_keys=True) if meta else None, "main_content": main,
        }
    except ValueError as e:
        return {"outcome": "mapping", "error": str(e)}


MAPPED = "outcome string, error string, text string, kind string, source string, source_id string, licenses array<string>, language string, date string, meta string, main_content boolean"


def map_records(records: DataFrame, profile: Profile, record: str = "record") -> DataFrame:
    """records with the mapped fields (MAPPED) beside their other columns; every record comes out, with its outcome.

    Null records are malformed. A missing or repeated main-content field fails the job. Columns of records that clash
    with a mapped one are replaced.
    """
    names = [f.strip().split(" ")[0] for f in MAPPED.split(", ")]

    @F.pandas_udf(MAPPED)
    def apply(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([{n: None for n in names} | (map_one(r, profile) if r is not None else {"outcome": "malformed", "error": "null"}) for r in s], columns=names)

    kept = [c for c in records.columns if c not in names or c == record]
    return records.select(*kept, apply(F.col(record)).alias("_m")).select(*[c for c in kept if c not in names], "_m.*")


def canonical(mapped: DataFrame, fallback: str = "origin", extra: tuple[str, ...] = ()) -> DataFrame:
    """Mapped records (and the columns ``extra``) as rows of the current layout (first eleven columns and main_content): licences normalised, source from its fallbacks, digest computed."""
    from ..functions import text as T

    blank = lambda c: F.when(F.trim(c) != "", F.col(c))
    return mapped.where("outcome = 'ok'").select(
        *extra,
        F.unhex(F.sha2("text", 256)).alias("content_sha256"), "text", F.coalesce(blank("source"), blank("source_id"), F.col(fallback)).alias("source"), F.lit(None).cast("string").alias("source_name"),
        T.license_set(F.col("licenses")).alias("license"), F.when(F.size("licenses") > 1, F.to_json("licenses")).when(F.size("licenses") == 1, F.col("licenses")[0]).alias("license_raw"),
        "language", F.lit(None).cast("int").alias("language_score"), "date", F.lit(None).cast("bigint").alias("token_count"), "meta", "main_content",
    )
