"""The pipeline from raw lines to verified shards."""

import json

import pytest
from pyspark.sql import functions as F

from corploom import store
from corploom.operators import catalog, mapping
from corploom.functions import text as T
from corploom.functions.policy import Values
from corploom.plans import ingest
from corploom.sinks import shards as shards_sink
from corploom.sources import shards


def test_pipeline(spark, tmp_path):
    phrase = "one two three four five six seven eight "
    rows = [{"t": "write to ann@x.test", "l": "MIT License"}, {"t": "write to bob@y.test", "l": "mit license"}, {"t": phrase * 12, "l": "MIT"}, {"t": "a\nfooter\nfooter\nfooter\nfooter", "l": "MIT"}, {"t": " ", "l": "MIT"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\nbroken\n")
    p = mapping.Profile(text=("t",), license=("l",))
    counts, manifest = ingest.ingest(spark, [str(tmp_path / "in")], p, str(tmp_path / "out"))
    assert {r["outcome"]: r["records"] for r in counts.collect()} == {"empty": 1, "malformed": 1, "duplicate": 1, "retained": 3}
    back = {r["text"]: r for r in shards.read_shards(spark, str(tmp_path / "out" / "shards")).collect()}
    mail = back["write to <EMAIL_ADDRESS>"]
    assert mail["redacted_email_addresses"] == 1 and not mail["email_addresses"] and mail["license"] == "MIT" and mail["source"] == f"sha256:{store.digest(str(tmp_path / 'in' / 'a.jsonl'))}#line=1"
    assert back[(phrase * 12)]["repetitive_content"] and back[rows[3]["t"]]["boilerplate_content"]
    assert manifest["totals"]["docs"] == 3
    again, same = ingest.ingest(spark, [str(tmp_path / "in")], p, str(tmp_path / "out"))
    assert same == manifest and again.count() == 4


def test_all_forms(spark, tmp_path):
    """Every form of input comes out as rows; a forbidden licence, an empty text and a broken record are outcomes."""
    put = lambda name, text: ((tmp_path / name).mkdir(exist_ok=True), (tmp_path / name / "f").write_text(text))
    put("text", "whole text")
    put("mbox", "From a\nSubject: 1\n\nx\n\nFrom b\nSubject: 2\n\ny\n")
    put("xml", "<r><t>one <b>two</b></t><t>three</t></r>")
    put("json", '[{"text": "n", "v": 2.50}, {"text": " "}]')
    spark.createDataFrame([("p one", "MIT", 1), (None, "MIT", 2), ("p two", "GPL-3.0", 3)], "text string, l string, unused int").coalesce(1).write.parquet(str(tmp_path / "parquet"))
    run = lambda form, p=mapping.Profile(), **k: ingest.ingest(spark, [str(tmp_path / form)], p, str(tmp_path / f"out-{form}"), form, **k)
    texts = lambda form: sorted(r["text"] for r in shards.read_shards(spark, str(tmp_path / f"out-{form}" / "shards")).collect())
    run("text"), run("mbox"), run("xml", mapping.Profile(text=("t[]",)), fields={"t": "//t"})
    assert texts("text") == ["whole text"] and texts("mbox") == ["Subject: 1\n\nx\n", "Subject: 2\n\ny\n"] and texts("xml") == ["one two\n\nthree"]
    run("json", mapping.Profile(text=("text", "v")))
    assert texts("json") == ["n\n\n2.50"]
    counts, _ = run("parquet", mapping.Profile(license=("l",)), allowed=Values(["MIT"]))
    assert texts("parquet") == ["p one"] and {r["outcome"]: r["records"] for r in counts.collect()} == {"empty": 1, "license-policy": 1, "duplicate": 0, "retained": 1}
    assert mapping.columns(mapping.Profile(license=("l",), meta={"a": "b.c[].d"})) == ["b", "l", "text"]


def test_a_job_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"text": "x"}\n{"text": "y"}\n')
    once = shards_sink.publish
    monkeypatch.setattr(shards_sink, "publish", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    args = (spark, [str(tmp_path / "in")], mapping.Profile(), str(tmp_path / "out"))
    with pytest.raises(OSError):
        ingest.ingest(*args)
    assert json.loads((tmp_path / "out" / "journal.json").read_text())["state"] == "publishing"
    monkeypatch.setattr(shards_sink, "publish", once)
    monkeypatch.setattr(ingest, "logical", None)  # nothing is read again
    counts, manifest = ingest.ingest(*args)
    assert manifest["totals"]["docs"] == 2 and shards.read_shards(spark, str(tmp_path / "out" / "shards")).count() == 2


def test_numbers_and_limits(spark):
    p = mapping.Profile(text=("t",), meta={"v": "v"}, longest=5)
    df = spark.createDataFrame([('{"t": 2.50, "v": 1e5}',), ('{"t": "too long"}',), ('{"t": NaN}',)], "record string")
    got = [(r["outcome"], r["text"], r["meta"]) for r in mapping.map_records(df, p).collect()]
    assert got == [("ok", "2.50", '{"v": "1e5"}'), ("mapping", None, None), ("malformed", None, None)]
    with pytest.raises(Exception, match="no text"):
        mapping.map_records(spark.createDataFrame([('{"t": ""}',)], "record string"), mapping.Profile(text=("t",), on_empty="fail")).collect()


def test_masks(spark):
    one = lambda role, c: F.struct(F.lit(role).alias("role"), F.lit(c).alias("content"), F.lit(None).cast("string").alias("context"))
    m = F.array(one("user", "hi"), one("assistant", "yé"))
    got = spark.range(1).select(T.byte_mask(m, "user-assistant-v1").alias("m"), T.byte_mask(m, "chatml-v1").alias("c"), T.render(m, "chatml-v1").alias("r"), T.byte_mask(m, "chatml-v1", causal=True).alias("a")).first()
    assert got["m"] == [False] * len("User: hi\n\nAssistant:") + [True] * 4
    assert len(got["c"]) == len(got["r"].encode()) + 1 and sum(got["c"]) == len("yé<|im_end|>\n".encode()) + 1 and all(got["a"])


def test_catalogue_helpers(spark):
    rows = spark.createDataFrame([(1, "MIT", 3), (1, "MIT", None), (1, "CC0-1.0", 1), (2, None, 1)], "shard_id int, license string, token_count long")
    usage = {r["shard_id"]: r["usage"] for r in catalog.license_usage(rows).collect()}
    assert {k: tuple(v) for k, v in usage[1].items()} == {"MIT": (2, 3), "CC0-1.0": (1, 1)} and 2 not in usage
    c = spark.createDataFrame([("a", ["EN"]), ("b", None), ("c", ["fr"])], "path string, languages array<string>")
    assert [r["path"] for r in catalog.by_language(c, ["en"]).collect()] == ["a"]
    done = spark.createDataFrame([("a.yaml",)], "path string")
    assert sorted(r["path"] for r in catalog.not_completed(c, done).collect()) == ["b", "c"]
    t = spark.createDataFrame([("r", 1, 1.0, 2.0, 1.0), ("r", 2, 2.0, 2.2, 1.0), ("s", 1, 1.0, 1.0, float("nan")), ("q", 1, 1.0, None, 1.0)], "run_id string, step long, elapsed_seconds double, heldout_loss double, loss double")
    assert {r["run_id"]: r["advice"] for r in catalog.advice(t).collect()} == {"r": "inspect", "s": "stop", "q": "continue"}
