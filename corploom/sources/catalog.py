"""Catalogue documents (YAML or JSON): directories of manifests as frames of manifests, sources and shards; read strictly."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

from .. import store

#: The keys that each kind of document and entry may have.
KEYS = {
    "index": ("kind", "schema", "path", "entries"),
    "entry": ("name", "type", "title", "description"),
    "manifest": ("kind", "schema", "name", "title", "description", "content", "license", "licenses", "format", "sources", "converted_by", "record_schema", "record_kind", "assessment", "redaction", "processing", "composed_by", "shards", "totals"),
    "source": ("name", "source", "url", "sha256", "category", "license", "license_evidence", "usage", "content", "acquisition", "files", "version", "collected_from", "collected_to"),
    "shard": ("url", "sha256", "format", "license", "licenses", "license_usage", "sources", "converted_by", "docs", "tokens", "bytes", "records_root", "modalities", "assessment", "redaction"),
    "rollup": ("url", "sha256", "count", "docs", "tokens", "bytes", "modalities"),
    "part": ("kind", "schema", "shards", "children"),
}

SUFFIXES = (".yaml", ".yml", ".json")


def strict(value, kind: str, where: str) -> dict:
    """value, if it is an object with no other keys than its kind has; else ValueError."""
    if not isinstance(value, dict):
        raise ValueError(f"{where} is no {kind}")
    if other := sorted(set(value) - set(KEYS[kind])):
        raise ValueError(f"{where} has unknown keys: {', '.join(other)}")
    return value


def parse(content: bytes, path: str):
    """One document; YAML where PyYAML is there, else JSON only. A repeated key of a JSON object raises."""

    def once(pairs):
        keys = [k for k, _ in pairs]
        if len(set(keys)) < len(keys):
            raise ValueError(f"{path} has a repeated key")
        return dict(pairs)

    if path.endswith(".json"):
        return json.loads(content, object_pairs_hook=once)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs PyYAML") from e
    return yaml.safe_load(content)


def load(path: str):
    """The document at a path."""
    return parse(store.read(path), path)


def walk(root: str):
    """(logical path, manifest) of every manifest that the directories below root list, in order; unlisted files are left out."""
    root = root.rstrip("/")
    names = [f"index{x}" for x in SUFFIXES if store.exists(f"{root}/index{x}")]
    if len(names) != 1:
        raise ValueError(f"{root} must have one index document")
    index = strict(load(f"{root}/{names[0]}"), "index", f"{root}/{names[0]}")
    for entry in sorted(index["entries"], key=lambda e: e["name"]):
        strict(entry, "entry", f"{root}: {entry.get('name')}")
        below = f"{root}/{entry['name']}"
        if entry["type"] == "directory":
            for path, m in walk(below):
                yield f"{entry['name']}/{path}", m
        else:
            found = [below + x for x in SUFFIXES if store.exists(below + x)]
            if len(found) != 1:
                raise ValueError(f"{below} must be one document")
            yield entry["name"], strict(load(found[0]), "manifest", found[0])


def expand(root: str, rollup: dict, seen: set[str] | None = None) -> list[dict]:
    """The shards below a reference to a part of a manifest (url relative to root): digests and declared totals are checked; an object or part that comes twice raises."""
    seen = set() if seen is None else seen
    strict(rollup, "rollup", str(rollup.get("url")))
    content = store.read(f"{root.rstrip('/')}/{rollup['url']}")
    if hashlib.sha256(content).hexdigest() != rollup["sha256"]:
        raise ValueError(f"{rollup['url']} does not have the digest {rollup['sha256']}")
    if rollup["sha256"] in seen:
        raise ValueError(f"{rollup['url']} comes twice")
    seen.add(rollup["sha256"])
    part = strict(parse(content, rollup["url"]), "part", rollup["url"])
    shards = [strict(s, "shard", rollup["url"]) for s in part.get("shards", [])]
    for s in shards:
        if s["sha256"] in seen:
            raise ValueError(f"the object {s['sha256']} comes twice")
        seen.add(s["sha256"])
    for child in part.get("children", []):
        shards += expand(root, child, seen)
    for name, actual in (("count", len(shards)), *((m, sum(s.get(m) or 0 for s in shards)) for m in ("docs", "tokens", "bytes"))):
        if rollup.get(name, actual) != actual:
            raise ValueError(f"{rollup['url']} declares {name} {rollup[name]}, its shards have {actual}")
    return shards


def frames(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """manifests (path, title, license), sources (path, name, category, sha256), shards (path, sha256, url, license, docs, tokens, bytes).

    A manifest's shards stand in it or in parts that it refers to. Unknown keys raise.
    """
    manifests, sources, shards = [], [], []
    for path, m in walk(root):
        manifests.append((path, m.get("title"), m.get("license")))
        sources += [(path, s.get("name"), s.get("category"), s.get("sha256")) for s in (strict(s, "source", path) for s in m.get("sources", []))]
        held = m.get("shards", [])
        held = expand(root, held) if isinstance(held, dict) else [strict(s, "shard", path) for s in held]
        shards += [(path, s["sha256"], s.get("url"), s.get("license") or m.get("license"), s.get("docs"), s.get("tokens"), s.get("bytes")) for s in held]
    return (
        spark.createDataFrame(manifests, "path string, title string, license string"),
        spark.createDataFrame(sources, "path string, name string, category string, sha256 string"),
        spark.createDataFrame(shards, "path string, sha256 string, url string, license string, docs long, tokens long, bytes long"),
    )
