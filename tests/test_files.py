"""Raw files, shards, exports and streams through real files."""

import gzip
import hashlib
import json
import os
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corploom.operators import drift, selection
from corploom import store
from corploom.sinks import shards as sink
from corploom.sources import catalog, files, shards


def test_probe_and_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("héllo\n")
    (tmp_path / "b.md").write_text("# t\n")
    (tmp_path / "c.jsonl").write_text('{"text":"x"}\n{"text":"y"}\n')
    (tmp_path / "d.jsonl.gz").write_bytes(gzip.compress(b'{"text":"x"}\n\n{"text":"z"}\n'))
    (tmp_path / "e.bin").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "f.json").write_text('[{"a": 1}, {"a": 2.50}]')
    (tmp_path / "g.xml").write_text('<?xml version="1.0"?><r><p k="v">one <b>two</b></p><x><p>no</p></x></r>')
    (tmp_path / "h").write_bytes(b"")
    kinds = {r["path"].rsplit("/", 1)[1]: (r["format"], r["compression"]) for r in files.probe(spark, str(tmp_path)).collect()}
    assert kinds == {"a.txt": ("text", "none"), "b.md": ("markdown", "none"), "c.jsonl": ("jsonl", "none"), "d.jsonl.gz": ("jsonl", "gzip"), "e.bin": ("unknown", "none"), "f.json": ("json", "none"), "g.xml": ("xml", "none"), "h": ("empty", "none")}
    assert files.text_files(spark, str(tmp_path / "a.txt")).first()["text"] == "héllo\n"
    cut = files.text_files(spark, str(tmp_path / "a.txt"), large=1, chunk=2).orderBy("chunk").collect()
    assert "".join(r["text"] for r in cut) == "héllo\n" and len(cut) == cut[0]["chunks"] > 1
    assert [r["line"] for r in files.jsonl(spark, str(tmp_path / "d.jsonl.gz")).orderBy("line").collect()] == [1, 3]
    assert [r["record"] for r in files.json_objects(spark, str(tmp_path / "f.json")).orderBy("line").collect()] == ['{"a": 1}', '{"a": 2.50}']
    x = files.xml_records(spark, str(tmp_path / "g.xml"), fields={"p": "//p", "k": "//p/@k"}, exclude=("/r/x",)).first()
    assert x["p"] == ["one two"] and x["k"] == ["v"]
    listed = [(r["path"], r["sha256"], r["bytes"]) for r in files.probe(spark, str(tmp_path)).collect()]
    assert len(listed) == 8 and ("".join(f"{h}\t{n}\t{q}\n" for q, h, n in sorted(listed))) and selection.tree_digest(files.probe(spark, str(tmp_path))) == hashlib.sha256("".join(f"{h}\t{n}\t{q}\n" for q, h, n in sorted(listed)).encode()).hexdigest()
    assert files.probe(spark, str(tmp_path), str(tmp_path / "a.txt"), str(tmp_path) + "/").count() == 8
    os.symlink(tmp_path / "a.txt", tmp_path / "link")
    with pytest.raises(Exception, match="symbolic link"):
        files.probe(spark, str(tmp_path / "link")).collect()
    (tmp_path / "link").unlink()
    assert files.opaque(spark, str(tmp_path / "e.bin")).first()["text"] == "//4A"
    with pytest.raises(Exception, match="NUL|utf-8"):
        files.text_files(spark, str(tmp_path / "e.bin")).collect()


def test_mbox_and_bounds(spark, tmp_path):
    (tmp_path / "m").write_text("From a@b Mon\nSubject: 1\n\nx\n\nFrom c@d Tue\nSubject: 2\n\ny\n")
    got = files.mbox(spark, str(tmp_path / "m")).orderBy("message").collect()
    assert [r["message"] for r in got] == [1, 2] and got[1]["text"].startswith("Subject: 2")
    df = spark.createDataFrame([("pre BEGIN a \n b END END",), ("none",)], "t string")
    assert [r[0] for r in df.select(files.bounded_text(F.col("t"), "BEGIN", "END")).collect()] == ["a \n b\n", None]


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    """One file read by many tasks, one compressed, blank lines and CRLF: the numbers are those of the file."""
    lines = [f'{{"n": {i}.50, "pad": "{"x" * (i % 90)}"}}' if i % 7 else "" for i in range(4000)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "b.jsonl.gz").write_bytes(gzip.compress("\r\n".join(lines[:100]).encode()))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = files.jsonl(spark, str(tmp_path)).collect()
        assert files.numbered_lines(spark, str(tmp_path / "a.jsonl")).select("block").distinct().count() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name, n in (("a.jsonl", 4000), ("b.jsonl.gz", 100)):
        assert {r["line"]: r["record"] for r in got if r["path"].endswith(name)} == {i + 1: x for i, x in enumerate(lines[:n]) if x}


def test_mailboxes_over_blocks(spark, tmp_path):
    mails = [f"Subject: {i}\n\n" + "\n".join(f"line {j} >From" for j in range(i % 30)) for i in range(400)]
    (tmp_path / "m").write_text("".join(f"From a@b {i}\n{m}\n\n" for i, m in enumerate(mails)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = {r["message"]: r["text"] for r in files.mbox(spark, str(tmp_path / "m")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {i + 1: m.rstrip("\n") + "\n" for i, m in enumerate(mails)}
    for name, content in (("before", "x\nFrom a\nb\n"), ("empty", "From a\n\nFrom b\nc\n")):
        (tmp_path / name).write_text(content)
        with pytest.raises(Exception, match="envelope|empty message"):
            files.mbox(spark, str(tmp_path / name)).collect()


@pytest.mark.parametrize("text, want", [('{"a": 1e5}', ['{"a": 1e5}']), ('[ {"a":2.50} , {"b":[1, 2]} ]\n', ['{"a":2.50}', '{"b":[1, 2]}']), ("[]", []), ("[1]", None), ('{"a":1} {"b":2}', None), ('[{"a":1}', None), ("", None)])
def test_objects_as_they_are_written(text, want):
    if want is None:
        with pytest.raises(ValueError):
            files.objects_of(text)
    else:
        assert files.objects_of(text) == want


@pytest.mark.parametrize("text, want", [
    ("<r><a>x<b>y</a>z</r>", {"a": "xy", "r": "xyz"}), ("<r><a k=v w='1'>fish & chips &nbsp;&lt;</a></q></r>", {"a": "fish & chips \u00a0<", "k": "v"}), ("<r><a>open <![CDATA[<raw> & ]]><!-- no --> end", {"a": "open <raw> &  end"}),
    ("<?xml version='1.0'?><!DOCTYPE r><r>&unknown;<br/>t</r>", {"r": "&unknown;t"}), ("x<r/>", None), ("<r></r><s></s><", None), ("", None),
])
def test_lenient_xml(text, want):
    if want is None:
        with pytest.raises(ValueError):
            files.xml_tree(text.encode())
        return
    root = files.xml_tree(text.encode())
    for k, v in want.items():
        node = root if root.tag == k else root.find(k)
        assert (root.find("a").get(k) if node is None else "".join(node.itertext())) == v


def test_verify_finds_what_changed(spark, small, tmp_path):
    rows = spark.read.parquet(f"{small}/text_rows.parquet").select(*drift.NAMES).withColumn("token_count", F.lit(1).cast("bigint")).withColumn("license", F.lit("MIT"))
    written = sink.write_shards(rows.repartition(3), f"file://{tmp_path}/s").collect()
    df = spark.createDataFrame(written, sink.WRITTEN)
    assert sink.verify(df).count() == 0 and len(written) == 3
    store.write(written[0]["path"], b"no parquet")
    store.remove(written[1]["path"])
    bad = {r["path"]: r["found"] for r in sink.verify(df).collect()}
    assert set(bad) == {written[0]["path"], written[1]["path"]} and bad[written[1]["path"]] is None


def test_audit_by_attestation(spark, small, tmp_path):
    """Attested shards are not read unless asked; a contradictory or missing attestation makes a shard be read; a manifest counts by licence."""
    rows = spark.read.parquet(f"{small}/text_rows.parquet").select(*drift.NAMES).withColumn("token_count", F.lit(1).cast("bigint")).withColumn("license", F.when(F.col("license") == "MIT", "MIT").otherwise("CC0-1.0"))
    written = spark.createDataFrame(sink.write_shards(rows.coalesce(1), str(tmp_path / "s"), plan="p").collect(), sink.WRITTEN)
    assert [r["state"] for r in shards.attested(shards.footers(spark, str(tmp_path / "s"))).collect()] == ["recognised"]
    assert shards.audit(spark, str(tmp_path / "s")).count() == 0
    n = rows.groupBy("content_sha256").count().where("count > 1").agg(F.sum("count")).first()[0]
    assert {r["problem"]: r["records"] for r in shards.audit(spark, str(tmp_path / "s"), deep=True).collect()}.get("duplicate") == n
    path = written.first()["path"]
    t = pq.read_table(path)
    meta = {k: v for k, v in pq.ParquetFile(path).metadata.metadata.items() if not k.startswith(b"ARROW")}
    meta[b"corploom.records"] = b"1"
    pq.write_table(t.replace_schema_metadata(meta), path)
    got = {r["problem"]: r["records"] for r in shards.audit(spark, str(tmp_path / "s")).collect()}
    assert got["attestation"] == rows.count() and got["duplicate"] == n
    m = sink.manifest(written, "n", "t", "", [], shards.read_shards(spark, str(tmp_path / "s")))
    assert m["licenses"] == ["CC0-1.0", "MIT"] and sum(u["docs"] for u in m["totals"]["license_usage"].values()) == rows.count() == sum(u["docs"] for u in m["totals"]["source_usage"].values())
    assert m["shards"][0]["license_usage"] == m["totals"]["license_usage"]


def test_exports_overlays_and_telemetry(spark, tmp_path):
    for n in ("a", "b", "c"):
        (tmp_path / n).write_text(n)
    pins = [{"name": n, "sha256": store.digest(str(tmp_path / n)), "bytes": 1} for n in ("a", "b", "c")]
    doc = str(tmp_path / "EXPORT.json")
    assert sink.export_document(doc, {"x": 1}, pins) == store.digest(doc) and sink.verify_export(spark, doc, {"x": 1}, str(tmp_path)).count() == 0
    (tmp_path / "a").write_text("z")
    (tmp_path / "b").write_text("long")
    (tmp_path / "c").unlink()
    assert {tuple(r) for r in sink.verify_export(spark, doc, {"x": 1}, str(tmp_path)).collect()} == {("a", "digest"), ("b", "size"), ("c", "missing")}
    with pytest.raises(ValueError):
        sink.verify_export(spark, doc, {"x": 2}, str(tmp_path))
    root = tmp_path / "root"
    (root / "d").mkdir(parents=True)
    (root / "d" / "old").write_text("1")
    (root / "blocked" / "below").mkdir(parents=True)
    o = sink.Overlay(str(root), str(tmp_path / "stage"))
    o.add("d/old", b"2")
    o.add("new/doc", b"3")
    o.add("blocked", b"a folder is here")
    with pytest.raises(Exception):
        o.apply()
    assert (root / "d" / "old").read_text() == "1" and not (root / "new" / "doc").exists()
    o.names.remove("blocked")
    assert o.apply() == ["d/old", "new/doc"] and (root / "new" / "doc").read_text() == "3" and o.apply() == []
    with pytest.raises(ValueError):
        o.add("../x", b"")
    t = spark.createDataFrame([("2024", "r", 1.5)], "observed_utc string, run_id string, loss double")
    cols = [F.col(c) if c in t.columns else F.lit(None).cast(k).alias(c) for c, k in (x.split(" ") for x in files.TELEMETRY.split(", "))]
    for _ in range(2):
        sink.append_telemetry(t.select(*cols), str(tmp_path / "t"))
    assert [r["loss"] for r in files.telemetry(spark, str(tmp_path / "t")).collect()] == [1.5, 1.5]


def test_shards_round_trip(spark, small, tmp_path):
    rows = spark.read.parquet(f"{small}/text_rows.parquet").select(*drift.NAMES).withColumn("token_count", F.coalesce("token_count", F.lit(0))).withColumn("license", F.coalesce("license", F.lit("MIT")))
    written = sink.write_shards(rows.repartition(2), str(tmp_path / "s"))
    written = spark.createDataFrame(written.collect(), written.schema)
    assert written.agg(F.sum("rows")).first()[0] == rows.count() and sink.verify(written).count() == 0
    f = shards.footers(spark, str(tmp_path / "s")).collect()
    assert {r["layout"] for r in f} == {"current"} and sum(int(r["facts"]["corploom.records"]) for r in f) == rows.count()
    back = shards.read_shards(spark, str(tmp_path / "s"))
    assert back.select(*drift.NAMES).exceptAll(rows).count() == 0 and shards.violations(back).where("array_contains(broken, 'digest')").count() == 0
    place = back.select("shard", "row").limit(3)
    assert shards.read_at(back, place).count() == 3 and shards.listing(back).count() == rows.count()
    state = sink.publish(written, str(tmp_path / "p"))
    assert {r["state"] for r in state.collect()} == {"published"} and {r["state"] for r in state.collect()} == {"present"}
    sink.export_jsonl(back.limit(5), str(tmp_path / "j"))
    assert all(json.loads(r["value"])["kind"] == "pretrain" for r in spark.read.text(str(tmp_path / "j")).collect())
    m = sink.manifest(written, "n", "t", "MIT", [])
    assert m["totals"]["docs"] == rows.count()


def test_older_layouts(spark, small, tmp_path):
    for t in ("shard_legacy", "shard_v1", "shard_v2", "shard_v3"):
        (tmp_path / f"{t}.parquet").write_bytes(open(f"{small}/{t}.parquet", "rb").read())
    rows = shards.read_shards(spark, str(tmp_path))
    assert rows.count() == sum(spark.read.parquet(f"{small}/{t}.parquet").count() for t in ("shard_legacy", "shard_v1", "shard_v2", "shard_v3"))
    assert rows.where("main_content is null").count() == 0


def test_journal(tmp_path):
    j = sink.Journal(str(tmp_path / "j"), {"a": 1})
    j.enter("assembling", n=1)
    j.enter("published")
    assert sink.Journal(str(tmp_path / "j"), {"a": 1}).state == "published"
    with pytest.raises(ValueError):
        j.enter("assembled")
    with pytest.raises(ValueError):
        sink.Journal(str(tmp_path / "j"), {"a": 2})


def test_catalog(spark, tmp_path):
    (tmp_path / "index.json").write_text(json.dumps({"kind": "index", "entries": [{"name": "sub", "type": "directory"}]}))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "index.yaml").write_text("kind: index\nentries:\n- {name: m, type: manifest}\n")
    (tmp_path / "sub" / "m.json").write_text(json.dumps({"title": "T", "license": "MIT", "sources": [{"name": "s"}], "shards": [{"sha256": "ab", "docs": 1, "tokens": 2, "bytes": 3}]}))
    m, s, d = catalog.frames(spark, str(tmp_path))
    assert m.first()["path"] == "sub/m" and s.count() == 1 and d.first()["license"] == "MIT"
    # shards in parts, which are checked by digest and totals
    put = lambda name, part: ((tmp_path / name).write_text(json.dumps(part)), hashlib.sha256(json.dumps(part).encode()).hexdigest())[1]
    inner = put("inner.json", {"kind": "part", "schema": 1, "shards": [{"sha256": "cd", "docs": 5, "tokens": 1, "bytes": 1}]})
    outer = {"kind": "part", "schema": 1, "shards": [{"sha256": "ab", "docs": 1, "tokens": 2, "bytes": 3}], "children": [{"url": "inner.json", "sha256": inner, "count": 1, "docs": 5}]}
    whole = {"url": "outer.json", "sha256": put("outer.json", outer), "count": 2, "docs": 6, "tokens": 3, "bytes": 4}
    (tmp_path / "sub" / "m.json").write_text(json.dumps({"title": "T", "shards": whole}))
    assert {r["sha256"]: r["docs"] for r in catalog.frames(spark, str(tmp_path))[2].collect()} == {"ab": 1, "cd": 5}
    for wrong in ({"docs": 7}, {"sha256": "0" * 64}, {"size": 1}):
        with pytest.raises(ValueError):
            catalog.expand(str(tmp_path), whole | wrong)
    twice = outer | {"children": outer["children"] * 2}
    with pytest.raises(ValueError, match="twice"):
        catalog.expand(str(tmp_path), {"url": "twice.json", "sha256": put("twice.json", twice)})
    (tmp_path / "sub" / "m.json").write_text('{"title": "T", "titel": 1, "shards": []}')
    with pytest.raises(ValueError, match="titel"):
        catalog.frames(spark, str(tmp_path))
    with pytest.raises(ValueError, match="repeated"):
        catalog.parse(b'{"a": 1, "a": 2}', "x.json")


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(180)


def test_stateful_streams(spark, tmp_path):
    """Records in several batches: packing and interleaving as the batch operators do, a shuffle that loses nothing but what its buffer still holds."""
    from corploom.operators import training
    from corploom.streaming import streams

    data = [("a" if i % 3 else "b", i, (i * 7) % 23) for i in range(120)]
    for k in range(4):
        spark.createDataFrame(data[30 * k : 30 * k + 30], "corpus string, seq long, tokens long").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{k}"))
    source = lambda: spark.readStream.schema("corpus string, seq long, tokens long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    # the files come in the order of their writing
    whole = spark.createDataFrame(data, "corpus string, seq long, tokens long")
    run(streams.pack_stream(source(), 50), "packed")
    for c in "ab":
        want = {(r["window"], r["targets"]) for r in training.pack_windows(whole.where(F.col("corpus") == c), 50).collect()}
        got = {(r["window"], r["t"]) for r in spark.table("packed").where(F.col("corpus") == c).groupBy("window").agg(F.sum("targets").alias("t")).collect()}
        assert got == want
    run(streams.interleave_stream(source(), {"a": 2, "b": 3}), "turns")
    want = {(r["corpus"], r["seq"], int(r["key"])) for r in training.weighted_order(whole, {"a": 2, "b": 3}).collect()}
    assert {(r["corpus"], r["seq"], int(r["key"])) for r in spark.table("turns").collect()} == want
    seen = streams.Progress()
    spark.streams.addListener(seen)
    run(streams.shuffle_stream(source().select("corpus", F.col("seq").cast("string").alias("id")), 5, most=8), "mixed")
    for _ in range(100):  # reports come a little later than the rows
        if sum(t[2] for t in seen.triggers) >= 120:
            break
        time.sleep(0.2)
    spark.streams.removeListener(seen)
    mixed = spark.table("mixed").orderBy("corpus", "place").collect()
    for c, n in (("a", 80), ("b", 40)):
        ids = [r["id"] for r in mixed if r["corpus"] == c]
        assert len(ids) == len(set(ids)) == n - 8 and ids != sorted(ids, key=int) and [r["place"] for r in mixed if r["corpus"] == c] == list(range(n - 8))
    assert sum(t[2] for t in seen.triggers) == 120 and {t[0] for t in seen.triggers} == {"mixed"}
    assert list(streams.in_order([lambda i=i: i * i for i in range(9)], 3)) == [i * i for i in range(9)]


def test_streams(spark, small, tmp_path):
    from corploom.streaming import streams

    rows = spark.read.parquet(f"{small}/text_rows.parquet")
    (tmp_path / "in").mkdir()
    rows.write.mode("overwrite").parquet(str(tmp_path / "in"))
    source = lambda: streams.rows_stream(spark, str(tmp_path / "in"), rows.schema)
    for name, df in (("kept", streams.dedup_stream(source())), ("kept_within", streams.dedup_stream_within(source(), delay="4000 days"))):
        run(df, name)
        assert spark.table(name).count() == rows.select("content_sha256", "license").distinct().count()
    clean = streams.rows_stream(spark, str(tmp_path / "in"), rows.schema).withColumn("token_count", F.coalesce("token_count", F.lit(0))).withColumn("license", F.coalesce("license", F.lit("MIT")))
    streams.write_shards_stream(clean, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out/_written/*").agg(F.sum("rows")).first()[0] == rows.count()
    events = spark.read.parquet(f"{small}/events.parquet")
    assert streams.event_windows(events).agg(F.sum("events")).first()[0] == events.where("ts is not null").count()
    assert streams.resume(spark.range(10).withColumnRenamed("id", "place"), 7).count() == 3
