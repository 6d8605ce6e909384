"""Readers of raw files: probe, whole text, mailboxes, JSON, JSON Lines, XML, Parquet columns, opaque chunks."""

from __future__ import annotations

import base64
import codecs
import gzip
import html
import io
import json
import os
import re
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint

#: Bytes looked at to tell a format; text files beyond LARGE are cut into chunks of at most CHUNK bytes.
HEAD, LARGE, CHUNK = 65536, 64 << 20, 16 << 20

#: Blocks of text files whose line numbers are broadcast (some hundred bytes each); more are joined.
BLOCKS = 100_000

#: First bytes of compressed and media files.
COMPRESSED = [(b"\x1f\x8b", "gzip"), (b"\x28\xb5\x2f\xfd", "zstd"), (b"BZh", "bzip2"), (b"\xfd7zXZ\x00", "xz"), (b"PK\x03\x04", "zip")]
MEDIA = [(b"\x89PNG\r\n\x1a\n", "png"), (b"\xff\xd8\xff", "jpeg"), (b"GIF8", "gif"), (b"%PDF-", "pdf"), (b"ID3", "mp3"), (b"OggS", "ogg"), (b"fLaC", "flac")]


def roots(paths) -> list[str]:
    """paths without those that are the same as or below another one, so that no file is listed twice."""
    plain = sorted({("file:/" + p[5:].lstrip("/") if p.startswith("file:") else p).rstrip("/") or "/" for p in paths})
    return [p for p in plain if not any(p != q and p.startswith(q + "/") for q in plain)]


def binary(spark: SparkSession, *paths: str) -> DataFrame:
    """path, length, content of regular files, folders read to any depth, each file once. Empty files are not listed: they hold no records.

    Repeated paths are taken out before anything is read; the files' content is not shuffled.
    """
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots(paths)).select("path", "length", "content")


def empty_files(spark: SparkSession, *paths: str) -> DataFrame:
    """path of the files without content, which file sources leave out: the listed files that a scan of sizes does not see."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots(paths))
    plain = lambda p: "file:/" + p[5:].lstrip("/") if p.startswith("file:") else p
    listed = spark.createDataFrame([(plain(unquote(p)),) for p in df.inputFiles()], "path string")
    same = F.regexp_replace("path", "^file:/+", "file:/")
    return listed.join(df.select(same.alias("path")), "path", "left_anti")


def numbered_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """path, block, line (from 1), value of every line (split at LF) of text files of any size, compressed ones by their extension.

    A file is read by as many tasks as it has blocks. A line's number is its place in its block plus the lines of the
    blocks before, which are counted first; the text is not shuffled. Blocks are few: one for each part of a file.
    """
    df = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(roots(paths))
    lines = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    blocks = lines.groupBy("path", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = checkpoint(blocks.select("path", "block", "first", F.coalesce(before, F.lit(0)).alias("before")))
    starts = F.broadcast(starts) if starts.count() <= BLOCKS else starts
    return lines.join(starts, ["path", "block"]).select("path", "block", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "value")


def decompress(content: bytes) -> bytes:
    """gzip and zstd content unpacked, anything else as it is."""
    if content[:2] == b"\x1f\x8b":
        return gzip.decompress(content)
    if content[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor(max_window_size=1 << 28).stream_reader(io.BytesIO(content)).read()
    return content


def sniff(head: bytes, path: str = "", length: int | None = None) -> tuple[str, str]:
    """(format, compression) from the first bytes and the name, by rules tried in order."""
    if not head:
        return "empty", "none"
    if head[:4] in (b"PAR1", b"PARE"):
        return "parquet", "none"
    for magic, name in COMPRESSED:
        if head.startswith(magic):
            inner = "unknown"
            if name in ("gzip", "zstd"):
                try:
                    inner = sniff(_some(head, name), re.sub(r"\.(gz|zst|zstd)$", "", path))[0]
                except Exception:  # noqa: BLE001 - a head that cannot be unpacked is unknown
                    inner = "unknown"
            return inner, name
    for magic, name in MEDIA:
        if head.startswith(magic):
            return name, "none"
    text = head.lstrip(b"\xef\xbb\xbf \t\r\n")
    low = text[:512].lower()
    if head.startswith(b"From ") and re.match(rb"From [^\n]*\n(?:[\w-]+:)", head):
        return "mbox", "none"
    if text.startswith(b"WARC/"):
        return "warc", "none"
    if low.startswith((b"<!doctype html", b"<html")):
        return "html", "none"
    if text.startswith((b"<?xml", b"<")) and re.match(rb"<(\?xml|[A-Za-z_!])", text):
        return "xml", "none"
    if text[:1] in (b"{", b"["):
        lines = [x for x in text.split(b"\n")[:2] if x.strip()]
        try:
            json.loads(lines[0])
            if path.endswith((".jsonl", ".ndjson")) or len(lines) > 1:
                return "jsonl", "none"
            return "json", "none"
        except ValueError:
            if path.endswith(".json") or length is not None and length <= len(head):
                return ("json", "none") if _is_json(text) or path.endswith(".json") else ("text", "none")
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head, final=False)
    except UnicodeDecodeError:
        return "unknown", "none"
    if b"\x00" in head:
        return "unknown", "none"
    return ("markdown" if path.lower().endswith((".md", ".markdown")) else "text"), "none"


def _some(head: bytes, name: str) -> bytes:
    if name == "gzip":
        import zlib

        return zlib.decompressobj(31).decompress(head, HEAD)
    import zstandard

    return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(head)).read(HEAD // 8)


def _is_json(text: bytes) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def probe(spark: SparkSession, *paths: str) -> DataFrame:
    """path, bytes, sha256, format, compression of every file, empty ones included; a symbolic link of the local file system raises."""

    @F.pandas_udf("format string, compression string")
    def kind(head: pd.Series, path: pd.Series, length: pd.Series) -> pd.DataFrame:
        for p in path:
            if p.startswith(("file:", "/")) and os.path.islink("/" + p.removeprefix("file:").lstrip("/")):
                raise ValueError(f"{p} is a symbolic link")
        return pd.DataFrame([sniff(bytes(h), p, n) for h, p, n in zip(head, path, length)], columns=["format", "compression"])

    b = binary(spark, *paths).withColumn("k", kind(F.substring("content", 1, HEAD), F.col("path"), F.col("length")))
    found = b.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "k.format", "k.compression")
    none = empty_files(spark, *paths).select("path", F.lit(0).cast("bigint").alias("bytes"), F.sha2(F.lit(""), 256).alias("sha256"), F.lit("empty").alias("format"), F.lit("none").alias("compression"))
    return found.unionByName(none)


def text_files(spark: SparkSession, *paths: str, large: int = LARGE, chunk: int = CHUNK) -> DataFrame:
    """path, sha256, chunk, chunks, text: whole UTF-8 files without NUL; larger ones in chunks cut between characters. Others raise."""

    def cut(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                content = decompress(bytes(content))
                text = content.decode("utf-8")  # the whole file is checked before its first chunk
                if "\0" in text:
                    raise ValueError(f"{path} has a NUL character")
                parts = [text]
                if len(content) > large:
                    parts, at = [], 0
                    while at < len(content):
                        part = content[at : at + chunk].decode("utf-8", "ignore")
                        at += len(part.encode())
                        parts.append(part)
                import hashlib

                digest = hashlib.sha256(content).hexdigest()
                out += [(path, digest, i, len(parts), p) for i, p in enumerate(parts)]
            yield pd.DataFrame(out, columns=["path", "sha256", "chunk", "chunks", "text"])

    return binary(spark, *paths).select("path", "content").mapInPandas(cut, "path string, sha256 string, chunk int, chunks int, text string")


def bounded_text(text: Column, start: str, end: str) -> Column:
    """The text between the first match of ``start`` and the first match of ``end`` after it, trimmed, with a line feed; null if there is none."""
    inner = F.regexp_extract(text, f"(?s)(?:{start})(.*?)(?:{end})", 1)
    return F.when(text.rlike(f"(?s)(?:{start}).*?(?:{end})"), F.concat(F.regexp_replace(inner, r"^\s+|\s+$", ""), F.lit("\n")))


def mbox(spark: SparkSession, *paths: str) -> DataFrame:
    """path, message (from 1), text of every message of mailbox files (plain, gzip or zstd) of any size; the envelope line is left out.

    Content before the first envelope and an empty message raise. A message's number is that of the envelopes up to it,
    counted by block first; only the lines of one message meet.
    """
    lines = numbered_lines(spark, *paths).withColumn("opens", F.col("value").startswith("From ").cast("int"))
    inside = F.sum("opens").over(Window.partitionBy("path", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    blocks = lines.groupBy("path", "block").agg(F.sum("opens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.withColumn("inside", inside).join(blocks.select("path", "block", before.alias("before")), ["path", "block"]).withColumn("message", F.col("before") + F.col("inside"))
    body = F.transform(F.array_sort(F.collect_list(F.when(F.col("opens") == 0, F.struct("line", "value")))), lambda x: x["value"])
    said = placed.groupBy("path", "message").agg(F.array_join(body, "\n").alias("text"))
    bare = F.regexp_replace("text", r"\n+$", "")
    wrong = F.when((F.col("message") == 0) & (F.trim(bare) != ""), F.raise_error(F.concat("path", F.lit(" has content before its first envelope"))))
    wrong = F.coalesce(wrong, F.when((F.col("message") > 0) & (F.trim(F.regexp_replace("text", r"\s+", "")) == ""), F.raise_error(F.concat("path", F.lit(" has an empty message")))))
    return said.select("path", "message", F.coalesce(wrong.cast("string"), F.concat(bare, F.lit("\n"))).alias("text")).where("message > 0 or text <> '\n'")


def jsonl(spark: SparkSession, *paths: str) -> DataFrame:
    """path, line (from 1, blank lines count), record of every non-blank line of files of any size; compressed files by their extension."""
    return numbered_lines(spark, *paths).where(F.trim(F.regexp_replace("value", r"\r$", "")) != "").select("path", "line", F.regexp_replace("value", r"\r$", "").alias("record"))


def objects_of(text: str) -> list[str]:
    """The objects of a JSON document, one or an array of them, as they are written: numbers keep their spelling."""
    decoder, space = json.JSONDecoder(), " \t\r\n"
    skip = lambda i: next((j for j in range(i, len(text)) if text[j] not in space), len(text))
    at, out = skip(0), []
    if text[at : at + 1] != "[":
        value, end = decoder.raw_decode(text, at)
        spans = [(at, end, value)]
    else:
        spans, end = [], skip(at + 1)
        while text[end : end + 1] != "]":
            value, stop = decoder.raw_decode(text, end)
            spans.append((end, stop, value))
            end = skip(stop)
            if text[end : end + 1] == ",":
                end = skip(end + 1)
            elif text[end : end + 1] != "]":
                raise ValueError("an array that does not end")
        end += 1
    if skip(end) < len(text):
        raise ValueError("something follows the document")
    for a, b, value in spans:
        if not isinstance(value, dict):
            raise ValueError("something else than objects")
        out.append(text[a:b])
    return out


def json_objects(spark: SparkSession, *paths: str) -> DataFrame:
    """path, line (place of the object), record of files with one object or one array of objects, as they are written; other content raises."""

    def objects(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    out += [(path, i, x) for i, x in enumerate(objects_of(decompress(bytes(content)).decode("utf-8")), 1)]
                except ValueError as e:
                    raise ValueError(f"{path}: {e}") from e
            yield pd.DataFrame(out, columns=["path", "line", "record"])

    return binary(spark, *paths).select("path", "content").mapInPandas(objects, "path string, line long, record string")


_MARKUP = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<raw>.*?)(?:\]\]>|$)|<\?.*?(?:\?>|$)|<![^>]*>|<(?P<end>/?)(?P<name>[A-Za-z_][\w:.-]*)(?P<attributes>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)(?P<empty>/?)>", re.S)
_ATTRIBUTE = re.compile(r"""([\w:.-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


def xml_tree(content: bytes) -> ElementTree.Element:
    """The root of an XML document; one that is not well-formed is read leniently.

    Leniently, an end tag closes what was opened after its start tag and is passed over if there is none; what is open at
    the end is closed; unknown entities and single & and < stay as they are; name spaces are not resolved. No element,
    or text or a second element beside the root, raises ValueError.
    """
    try:
        return ElementTree.fromstring(content)
    except ElementTree.ParseError:
        text = content.decode("utf-8-sig")
    root, open_, at = None, [], 0

    def put(t: str, plain: bool) -> None:
        t = t if plain else html.unescape(t)
        if not open_:
            if t.strip():
                raise ValueError("text beside the root")
            return
        node = open_[-1]
        if len(node):
            node[-1].tail = (node[-1].tail or "") + t
        else:
            node.text = (node.text or "") + t

    for m in _MARKUP.finditer(text):
        put(text[at : m.start()], False)
        at = m.end()
        if m["raw"] is not None:
            put(m["raw"], True)
        elif m["name"] and m["end"]:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k].tag == m["name"]:
                    del open_[k:]
                    break
        elif m["name"]:
            node = ElementTree.Element(m["name"], {a[0]: html.unescape(a[1] or a[2] or a[3]) for a in _ATTRIBUTE.findall(m["attributes"])})
            if open_:
                open_[-1].append(node)
            elif root is None:
                root = node
            else:
                raise ValueError("a second root")
            if not m["empty"]:
                open_.append(node)
    put(text[at:], False)
    if root is None:
        raise ValueError("no element")
    return root


def _xml_path(node: ElementTree.Element, path: str, parents: tuple = ()):
    """Elements or attribute values below the root that a path selects: /a/b, //b, *, {ns}n, a trailing @attribute."""
    steps = [s for s in re.split(r"/(?![^{]*\})", path) if s]
    attribute = steps.pop()[1:] if steps and steps[-1].startswith("@") else None
    anywhere = path.startswith("//")
    found = []
    same = lambda tag, step: step == "*" or tag == step or "{" not in step and tag.rsplit("}", 1)[-1] == step

    def walk(n, trail):
        trail = (*trail, n.tag)
        if len(trail) >= len(steps) and (anywhere or len(trail) == len(steps)) and all(same(t, s) for t, s in zip(trail[len(trail) - len(steps) :], steps)):
            found.append(n)
        for child in n:
            if isinstance(child.tag, str):
                walk(child, trail)

    walk(node, parents)
    return [n.attrib[attribute] for n in found if attribute in n.attrib] if attribute else found


def xml_records(spark: SparkSession, *paths: str, fields: dict[str, str], exclude: tuple[str, ...] = ()) -> DataFrame:
    """path and an array of texts for each field (a path expression): white space collapsed, excluded subtrees left out."""
    names = sorted(fields)

    def read(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                root = xml_tree(decompress(bytes(content)))
                dropped = {id(m) for e in exclude for n in _xml_path(root, e) for m in n.iter()}

                def text(n, dropped=dropped):
                    if id(n) in dropped:
                        return ""
                    return (n.text or "") + "".join((text(c) if isinstance(c.tag, str) else "") + (c.tail or "") for c in n)

                values = []
                for k in names:
                    got = [x if isinstance(x, str) else text(x) for x in _xml_path(root, fields[k]) if isinstance(x, str) or id(x) not in dropped]
                    values.append([" ".join(v.split()) for v in got if v.strip()])
                out.append((path, *values))
            yield pd.DataFrame(out, columns=["path", *names])

    return binary(spark, *paths).select("path", "content").mapInPandas(read, "path string, " + ", ".join(f"{k} array<string>" for k in names))


def parquet_column(spark: SparkSession, column: str, *paths: str) -> DataFrame:
    """path, row (from 0), text of one column; only that column is read. Null and empty values are kept for the caller's policy."""
    df = spark.read.parquet(*paths)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"), F.col(column).alias("text"))


def parquet_records(spark: SparkSession, columns: list[str], *paths: str) -> DataFrame:
    """path, line (from 1), record: rows of Parquet files as JSON objects of the given top-level columns; no other column is read. Nulls are left out."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(*roots(paths))
    return df.select(F.col("_metadata.file_path").alias("path"), (F.col("_metadata.row_index") + 1).alias("line"), F.to_json(F.struct(*columns)).alias("record"))


def opaque(spark: SparkSession, *paths: str, chunk: int = 256 << 10) -> DataFrame:
    """path, chunk, chunks, text: any file as base64 chunks."""

    def cut(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                content = bytes(content)
                n = max(1, -(-len(content) // chunk))
                out += [(path, i, n, base64.b64encode(content[i * chunk : (i + 1) * chunk]).decode()) for i in range(n)]
            yield pd.DataFrame(out, columns=["path", "chunk", "chunks", "text"])

    return binary(spark, *paths).select("path", "content").mapInPandas(cut, "path string, chunk int, chunks int, text string")


def telemetry(spark: SparkSession, *paths: str) -> DataFrame:
    """Training telemetry by column name; columns that a file lacks are null."""
    return spark.read.option("header", True).schema(TELEMETRY).csv(list(paths), enforceSchema=False)


TELEMETRY = "observed_utc string, elapsed_seconds double, run_id string, stage string, attempt int, event string, state string, step long, planned_steps long, tokens long, planned_tokens long, loss double, heldout_loss double, heldout_perplexity double, learning_rate double, tokens_per_second double, eta_seconds double, message string"
