"""Writing content-addressed shards with footer facts, verifying them, exporting rows, recording the state of a job."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import store
from ..functions import text as T
from ..operators.drift import NAMES

#: Encoded bytes at which a shard is closed and beyond which it is an error; logical bytes of a row group; compression level.
TARGET, MOST, ROW_GROUP, LEVEL = 256 << 20, 512 << 20, 64 << 20, 6

PREFIX = "corploom."

#: How shards are written and what is checked while they are: named in each shard's attestation.
RECIPE, VALIDATED = "corploom-parquet-1", ("canonical-layout", "required-columns", "footer-sums")

_KINDS = [pa.binary(32)] + [pa.string()] * 6 + [pa.int32(), pa.string(), pa.int64(), pa.string()] + [pa.bool_()] * 4 + [pa.int64()] * 5
_REQUIRED = {"content_sha256", "text", "source", "license", *list(NAMES)[11:]}
SCHEMA = pa.schema([pa.field(n, t, nullable=n not in _REQUIRED) for n, t in zip(NAMES, _KINDS)])

WRITTEN = "path string, sha256 string, rows long, tokens long, content_bytes long, bytes long"


class _Shard:
    """One open file: row groups by logical size, sums for the footer, a name from its digest when it is closed."""

    def __init__(self, folder: str, task: str, plan: str):
        self.plan = plan
        self.folder, self.temporary = folder, f"{folder}/.open-{task}"
        files, path = store.at(self.temporary)
        self.out = files.open_output_stream(path)
        self.writer = pq.ParquetWriter(self.out, SCHEMA, compression="zstd", compression_level=LEVEL, data_page_version="2.0", data_page_size=1 << 20, use_dictionary=["source_name", "license", "license_raw", "language", "date"], write_statistics=[n for n in NAMES if n not in ("text", "source", "meta")])
        self.waiting: list[pa.Table] = []
        self.held = self.rows = self.tokens = self.content = 0
        self.counts = dict.fromkeys(list(NAMES)[11:], 0)
        self.licenses: set = set()

    def add(self, batch: pa.Table) -> None:
        size = pc.sum(pc.binary_length(batch["text"].cast(pa.binary()))).as_py() or 0
        self.waiting.append(batch)
        self.held += size
        self.content += size
        self.rows += batch.num_rows
        self.tokens += pc.sum(batch["token_count"]).as_py() or 0
        self.licenses |= set(batch["license"].to_pylist())
        for n in self.counts:
            self.counts[n] += int(pc.sum(batch[n]).as_py() or 0)
        if self.held >= ROW_GROUP:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            table = pa.concat_tables(self.waiting)
            self.writer.write_table(table, row_group_size=table.num_rows)
            self.waiting, self.held = [], 0

    def size(self) -> int:
        return self.out.tell()

    def close(self) -> tuple:
        self.flush()
        licenses = sorted(self.licenses)
        said = {"kind": "attestation", "schema": 1, "plan": self.plan, "recipe": RECIPE, "record_kind": "pretrain", "record_schema": 2, "records": self.rows, "tokens": self.tokens, "content_bytes": self.content, "licenses": licenses, "validated": list(VALIDATED), **self.counts}
        facts = {"attestation": json.dumps(said, sort_keys=True, separators=(",", ":")), "records": self.rows, "tokens": self.tokens, "content_bytes": self.content, "licenses": json.dumps(licenses), "record_kind": "pretrain", "record_schema": 2, **self.counts}
        self.writer.add_key_value_metadata({PREFIX + k: str(v) for k, v in facts.items()})
        self.writer.close()
        bytes_ = self.size()
        self.out.close()
        name = store.digest(self.temporary)
        if bytes_ > MOST:
            raise ValueError(f"a shard has {bytes_} bytes, more than {MOST}")
        to = f"{self.folder}/{name[:2]}/{name[2:4]}/{name}.parquet"
        store.parents(to)
        store.move(self.temporary, to)
        return to, name, self.rows, self.tokens, self.content, bytes_


def write_shards(rows: DataFrame, folder: str, target: int = TARGET, plan: str = "") -> DataFrame:
    """Writes rows (the current layout) below ``folder``, in a store that all executors reach; one row per file: path, digest and sums.

    The rows of a partition go to files in their order. A file's name is its digest, so a task that runs again after
    the loss of its executor writes the same names; a file that was left open is not a shard. The footer has the sums
    and an attestation: by which plan and recipe it was written, what it holds and what was checked.
    """
    folder = folder.rstrip("/")
    store.parents(f"{folder}/x")

    def write(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        task = f"{context.partitionId()}-{context.taskAttemptId()}"
        shard, out = None, []
        for batch in batches:
            table = pa.table([batch.column(i).cast(f.type) for i, f in enumerate(SCHEMA)], schema=SCHEMA)
            for start in range(0, table.num_rows, 4096):
                shard = shard or _Shard(folder, task, plan)
                shard.add(table.slice(start, 4096))
                if shard.size() >= target:
                    out.append(shard.close())
                    shard = None
        if shard:
            out.append(shard.close())
        cols = list(zip(*out)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string()] * 2 + [pa.int64()] * 4)], names=["path", "sha256", "rows", "tokens", "content_bytes", "bytes"])

    return rows.select(*NAMES).mapInArrow(write, WRITTEN)


def verify(written: DataFrame) -> DataFrame:
    """Files whose digest, size or row sums are not what was written, with what was found: an empty frame if all is well.

    Every file is read by one task in parts; of its rows only the token counts are read.
    """

    def check(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                found = (None, None, None, None)
                if store.exists(r.path):
                    try:
                        files, path = store.at(r.path)
                        t = pq.read_table(path, columns=["token_count"], filesystem=files)["token_count"]
                        found = (store.digest(r.path), store.size(r.path), len(t), pc.sum(t).as_py() or 0)
                    except pa.ArrowInvalid:  # no Parquet file any more
                        found = (store.digest(r.path), store.size(r.path), None, None)
                if found != (r.sha256, r.bytes, r.rows, r.tokens):
                    out.append((*r, *found))
            yield pd.DataFrame(out, columns=[*pdf.columns, "found", "length", "found_rows", "found_tokens"]).astype(object)

    names = [x.split(" ")[0] for x in WRITTEN.split(", ")]
    return written.select(*names).mapInPandas(check, WRITTEN + ", found string, length long, found_rows long, found_tokens long")


def export_jsonl(rows: DataFrame, folder: str) -> None:
    """Writes rows as canonical JSON lines."""
    c = {"sha256": F.lower(F.hex("content_sha256")), "text": F.col("text"), "source": F.col("source"), "source_name": F.col("source_name"), "license": F.col("license"), "license_raw": F.col("license_raw"), "lang": F.col("language"), "lang_score": F.col("language_score"), "date": F.col("date"), "tokens": F.col("token_count"), "meta": F.col("meta")}
    rows.select(T.canonical_json(c).alias("value")).write.mode("overwrite").text(folder)


def export_record(rows: DataFrame, digest: str) -> str:
    """The text of the one record with a digest; none or several raise."""
    got = rows.where(F.lower(F.hex("content_sha256")) == digest.lower()).select("text").take(2)
    if len(got) != 1:
        raise ValueError(f"{digest} names {'no' if not got else 'more than one'} record")
    return got[0]["text"]


def publish(written: DataFrame, folder: str) -> DataFrame:
    """Copies shards into another folder (or store) by digest; a file that is there with the right digest is left. path, sha256, state."""
    folder = folder.rstrip("/")

    def put(batches):
        from pyspark import TaskContext

        for pdf in batches:
            states = []
            for path, digest in zip(pdf["path"], pdf["sha256"]):
                to = f"{folder}/{digest[:2]}/{digest[2:4]}/{path.rsplit('/', 1)[1]}"
                if store.exists(to) and store.digest(to) == digest:
                    states.append((to, digest, "present"))
                    continue
                part = f"{to}.{TaskContext.get().taskAttemptId()}.part"
                store.parents(to)
                store.copy(path, part)
                if store.digest(part) != digest:
                    raise ValueError(f"{path} does not have the digest {digest}")
                store.move(part, to)
                states.append((to, digest, "published"))
            yield pd.DataFrame(states, columns=["path", "sha256", "state"])

    return written.select("path", "sha256").mapInPandas(put, "path string, sha256 string, state string")


class Journal:
    """The state of a job in a file, bound to the identity of its plan: assembling, assembled, publishing, published."""

    STATES = ("assembling", "assembled", "publishing", "published")

    def __init__(self, path: str, plan: dict):
        self.path = path
        self.identity = hashlib.sha256(json.dumps(plan, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        self.state, self.facts = None, {}
        if store.exists(path):
            known = json.loads(store.read(path))
            if known["plan"] != self.identity:
                raise ValueError("the journal belongs to another plan")
            self.state, self.facts = known["state"], known["facts"]

    def enter(self, state: str, **facts) -> None:
        """Moves on to a state (never back) and keeps facts; the file is replaced as a whole."""
        if self.state is not None and self.STATES.index(state) < self.STATES.index(self.state):
            raise ValueError(f"a job that is {self.state} cannot be {state}")
        self.state, self.facts = state, self.facts | facts
        store.write(self.path, json.dumps({"plan": self.identity, "state": state, "facts": self.facts}, sort_keys=True).encode())


def manifest(written: DataFrame, name: str, title: str, license_: str, sources: list[dict], rows: DataFrame | None = None) -> dict:
    """A manifest of written shards (one entry a file, so of bounded size) with totals.

    Where rows (of the shards, as read_shards gives them) are given, each shard and the totals have docs and tokens by
    licence and by source; a manifest with several licences then names them all.
    """
    shards = [{"url": f"{r['sha256'][:2]}/{r['sha256'][2:4]}/{r['sha256']}.parquet", "sha256": r["sha256"], "docs": r["rows"], "tokens": r["tokens"], "bytes": r["bytes"]} for r in sorted(written.toLocalIterator(), key=lambda r: r["sha256"])]
    total: dict = {k: sum(s[k] for s in shards) for k in ("docs", "tokens", "bytes")} | {"shards": len(shards)}
    out = {"kind": "manifest", "schema": 2, "name": name, "title": title, "license": license_, "sources": sources, "shards": shards, "totals": total}
    if rows is None:
        return out
    of = {s["sha256"]: s for s in shards}
    digest = F.regexp_extract("shard", r"([0-9a-f]{64})\.parquet$", 1).alias("digest")
    for column, key in (("license", "license_usage"), ("source", "source_usage")):
        sums = rows.groupBy(digest, column).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.coalesce("token_count", F.lit(0))).cast("bigint").alias("tokens"))
        if column == "source":  # sources of a shard may be many: only the totals are kept
            got = [(None, r[column], r["docs"], r["tokens"]) for r in sums.groupBy(column).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).toLocalIterator()]
        else:
            got = [tuple(r) for r in sums.toLocalIterator()]
        usage: dict = {}
        for d, value, docs, tokens in got:
            if d is not None:
                of[d].setdefault(key, {})[value] = {"docs": docs, "tokens": tokens}
            u = usage.setdefault(value, {"docs": 0, "tokens": 0})
            u["docs"], u["tokens"] = u["docs"] + docs, u["tokens"] + tokens
        total[key] = dict(sorted(usage.items()))
    licenses = list(total["license_usage"])
    return out | ({"licenses": licenses} if not license_ and len(licenses) > 1 else {"license": license_ or "".join(licenses)})


def export_document(path: str, selection: dict, files: list[dict]) -> str:
    """Writes what an export consists of: the selection's digest and, in order, every file's name, digest and bytes; returns the document's digest."""
    pinned = hashlib.sha256(json.dumps(selection, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    document = {"kind": "export", "schema": 1, "selection_sha256": pinned, "files": [{k: f[k] for k in ("name", "sha256", "bytes")} for f in files]}
    content = (json.dumps(document, indent=1, sort_keys=True) + "\n").encode()
    store.write(path, content)
    return hashlib.sha256(content).hexdigest()


def verify_export(spark, path: str, selection: dict, folder: str) -> DataFrame:
    """name, problem (missing, size, digest) of the files of an export that are not what its document says; another selection raises. Files are hashed by tasks."""
    document = json.loads(store.read(path))
    if document["selection_sha256"] != hashlib.sha256(json.dumps(selection, sort_keys=True, separators=(",", ":")).encode()).hexdigest():
        raise ValueError("the export is one of another selection")
    folder = folder.rstrip("/")

    def check(batches):
        for pdf in batches:
            out = []
            for name, digest, size in zip(pdf["name"], pdf["sha256"], pdf["bytes"]):
                at = f"{folder}/{name}"
                problem = "missing" if not store.exists(at) else "size" if store.size(at) != size else "digest" if store.digest(at) != digest else None
                if problem:
                    out.append((name, problem))
            yield pd.DataFrame(out, columns=["name", "problem"])

    rows = [(f["name"], f["sha256"], f["bytes"]) for f in document["files"]]
    return spark.createDataFrame(rows, "name string, sha256 string, bytes long").mapInPandas(check, "name string, problem string")


def append_telemetry(rows: DataFrame, folder: str) -> None:
    """Appends telemetry rows as CSV files with a header; what is there stays."""
    rows.write.mode("append").option("header", True).csv(folder)


class Overlay:
    """Changed documents of a catalogue, staged beside it and applied as a whole: if one cannot be put in place, all are put back."""

    def __init__(self, root: str, stage: str):
        self.root, self.stage, self.names = root.rstrip("/"), stage.rstrip("/"), []

    def add(self, name: str, content: bytes) -> None:
        """Stages a document under its path below the root."""
        if name.startswith("/") or ".." in name.split("/"):
            raise ValueError(f"{name!r} is not below the root")
        store.write(f"{self.stage}/{name}", content)
        self.names.append(name)

    def apply(self) -> list[str]:
        """Puts every staged document in place; returns the names that were changed. After a failure the root is as before."""
        done: list[tuple[str, bytes | None]] = []
        try:
            for name in self.names:
                to, new = f"{self.root}/{name}", store.read(f"{self.stage}/{name}")
                old = store.read(to) if store.exists(to) else None
                if old != new:
                    done.append((name, old))
                    store.write(to, new)
        except Exception:
            for name, old in reversed(done):
                if old is None:
                    store.remove(f"{self.root}/{name}")
                else:
                    store.write(f"{self.root}/{name}", old)
            raise
        return [name for name, _ in done]
