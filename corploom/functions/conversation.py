"""Conversations as canonical JSON text: encoding as a column expression, strict decoding as an Arrow function."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import json_string

ROLES = ("system", "user", "assistant", "tool")

#: Characters that the canonical form writes as code points beside the control characters.
ESCAPED = ("<", ">", "&", "\u2028", "\u2029")


def canonical_string(text: Column) -> Column:
    """text as a canonical JSON string."""
    out = json_string(text)
    for c in ESCAPED:
        out = F.replace(out, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return out


def encode(messages: Column, tools: Column | None = None) -> Column:
    """An array of struct(role, content, context) as canonical JSON; an empty or null context is left out, and so are null tools (JSON text, kept verbatim)."""
    extra = lambda m: F.when(F.coalesce(m["context"], F.lit("")) != "", F.concat(F.lit(',"context":'), canonical_string(m["context"]))).otherwise(F.lit(""))
    one = lambda m: F.concat(F.lit('{"role":'), canonical_string(m["role"]), F.lit(',"content":'), canonical_string(m["content"]), extra(m), F.lit("}"))
    end = F.lit("") if tools is None else F.when(F.coalesce(tools, F.lit("")) != "", F.concat(F.lit(',"tools":'), tools)).otherwise(F.lit(""))
    return F.concat(F.lit('{"messages":['), F.array_join(F.transform(messages, one), ","), F.lit("]"), end, F.lit("}"))


def valid(messages: Column) -> Column:
    """Whether messages have known roles and content, and a user and an assistant speak."""
    good = F.forall(messages, lambda m: m["role"].isin(*ROLES) & (F.coalesce(m["content"], F.lit("")) != ""))
    has = lambda r: F.exists(messages, lambda m: m["role"] == r)
    return F.coalesce(good & has("user") & has("assistant"), F.lit(False))


def _text(s: str) -> str:
    out = json.dumps(s, ensure_ascii=False)
    for c in ESCAPED:
        out = out.replace(c, f"\\u{ord(c):04x}")
    return out


def read(encoded: str) -> tuple[list[dict], str | None]:
    """Messages and tools (JSON text) of a conversation; ValueError for anything but its canonical form."""
    value, end = json.JSONDecoder().raw_decode(encoded)
    if end != len(encoded):
        raise ValueError("something follows the conversation")
    if not isinstance(value, dict) or set(value) - {"messages", "tools"}:
        raise ValueError("unknown fields")
    messages = value.get("messages")
    if not isinstance(messages, list) or not messages:
        raise ValueError("no messages")
    for m in messages:
        if not isinstance(m, dict) or set(m) - {"role", "content", "context"}:
            raise ValueError("unknown fields of a message")
        if m.get("role") not in ROLES or not isinstance(m.get("content"), str) or not m["content"] or not isinstance(m.get("context", ""), str):
            raise ValueError("a message without a known role and content")
    if not {"user", "assistant"} <= {m["role"] for m in messages}:
        raise ValueError("a conversation needs a user and an assistant")
    body = ",".join(f'{{"role":{_text(m["role"])},"content":{_text(m["content"])}' + (f',"context":{_text(m["context"])}' if m.get("context") else "") + "}" for m in messages)
    tools = None
    if "tools" in value:
        head = f'{{"messages":[{body}],"tools":'
        if not encoded.startswith(head):
            raise ValueError("not canonical")
        tools = encoded[len(head) : -1]
        json.loads(tools)
    if encoded != f'{{"messages":[{body}]' + (f',"tools":{tools}' if tools is not None else "") + "}":
        raise ValueError("not canonical")
    return messages, tools


_MESSAGE = T.StructType([T.StructField(n, T.StringType()) for n in ("role", "content", "context")])
DECODED = T.StructType([T.StructField("messages", T.ArrayType(_MESSAGE)), T.StructField("tools", T.StringType()), T.StructField("error", T.StringType())])


@F.pandas_udf(DECODED)
def decode(encoded: pd.Series) -> pd.DataFrame:
    """struct(messages, tools, error): what a canonical conversation holds, or why it is none; a null text is none."""
    out = []
    for text in encoded:
        try:
            if text is None:
                raise ValueError("null")
            messages, tools = read(text)
            out.append(([{"role": m["role"], "content": m["content"], "context": m.get("context")} for m in messages], tools, None))
        except ValueError as e:
            out.append((None, None, str(e)))
    return pd.DataFrame(out, columns=["messages", "tools", "error"])
