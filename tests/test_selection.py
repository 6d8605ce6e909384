"""Selections, policies, budgets and runs: edge cases on small tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from corploom.functions import conversation, policy
from corploom.functions import text as T
from corploom.operators import selection, training


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_claims_of_boundaries(spark):
    files = spark.createDataFrame([("a/b/x",), ("a/bc/x",), ("c/x",), (None,), ("a/b/x",)], "path string")
    bounds = spark.createDataFrame([("one", "a"), ("two", "a/b"), ("three", "d")], "source string, prefix string")
    got = {r["path"]: (r["source"], r["claims"]) for r in selection.boundary_claims(files.where("path is not null"), bounds).collect()}
    assert got == {"a/b/x": (None, 2), "a/bc/x": ("one", 1), "c/x": (None, 0)}
    assert selection.boundary_claims(files.limit(0), bounds).count() == 0


def test_tree_digest_is_that_of_the_sorted_inventory(spark):
    data = [(f"p/{i}", f"{i:064x}", i * 7) for i in range(30)]
    want = hashlib.sha256("".join(f"{h}\t{n}\t{p}\n" for p, h, n in sorted(data)).encode()).hexdigest()
    assert selection.tree_digest(spark.createDataFrame(data, "path string, sha256 string, bytes long")) == want
    empty = spark.createDataFrame([], "path string, sha256 string, bytes long")
    assert selection.tree_digest(empty) == hashlib.sha256(b"").hexdigest()


def test_boundaries_that_differ(spark):
    a = spark.createDataFrame([("s", 2, 10, "t"), ("u", 1, 5, "t"), ("v", 1, None, "t"), ("w", 1, 1, "x")], "source string, files long, bytes long, tree string")
    b = spark.createDataFrame([("s", 2, 10, "t"), ("u", 1, 6, "t"), ("v", 1, None, "t"), ("w", 1, 1, "y"), ("n", 1, 1, "t")], "source string, files long, bytes long, tree string")
    assert rows(selection.verify_boundaries(a, b)) == [("n", "undeclared"), ("u", "bytes"), ("w", "tree")]


def test_objects(spark):
    pins = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("c", None), ("d", 4)], "sha256 string, bytes long")
    have = spark.createDataFrame([("a", 1), ("a", 9), ("b", 3), ("e", 1)], "sha256 string, bytes long")
    assert rows(selection.object_states(pins, have)) == [("a", 1, "available"), ("b", 2, "wrong-size"), ("c", None, "missing"), ("d", 4, "missing")]
    plan = selection.fetch_plan(spark.createDataFrame([("a", "u2", 1), ("a", "u1", 1), ("b", "x", 1), ("b", "x", 2), ("c", None, None)], "sha256 string, url string, bytes long"))
    assert rows(plan) == [("a", "u1", 1, 2, False), ("b", "x", 1, 2, True), ("c", None, None, 1, False)]


def test_trees_and_rollups(spark):
    x = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    y = spark.createDataFrame([("a",), (None,), ("b",)], "k string")
    assert rows(selection.tree_differences(x, y)) == [("left", "a"), ("right", "b")] and selection.tree_differences(x, x).count() == 0
    edges = spark.createDataFrame([("r", "m"), ("r", "n")], "parent string, child string")
    leaves = spark.createDataFrame([("m", "o1", 1, 2, 3), ("n", "o1", 1, 2, 3), ("n", "o2", 5, None, 1)], "node string, sha256 string, docs long, tokens long, bytes long")
    assert rows(selection.tree_totals_once(edges, leaves)) == [("m", 1, 1, 2, 3), ("n", 2, 6, 2, 4), ("r", 2, 6, 2, 4)]
    with pytest.raises(ValueError):
        selection.tree_totals_once(spark.createDataFrame([("m", "n"), ("n", "m")], "parent string, child string"), leaves, 5)


def test_context_of_the_first_match(spark):
    new = spark.createDataFrame([(1, "n1", "u1"), (2, "n2", None), (3, None, "u3"), (4, "n4", "u4")], "ordinal int, name string, url string")
    old = spark.createDataFrame([(1, "other", "u1", "by url"), (2, "n1", "z", "by name"), (3, "n2", None, "name only"), (4, None, "u3", "url only")], "ordinal int, name string, url string, note string")
    assert [(r["ordinal"], r["note"]) for r in selection.keep_context(new, old, ["note"]).orderBy("ordinal").collect()] == [(1, "by url"), (2, "name only"), (3, "url only"), (4, None)]


def test_gaps(spark):
    schema = "context string, category string, usage string, types string, languages string, collected_to string, basis string, crawler string, service string, generator string"
    s = spark.createDataFrame([("a", "Web_Crawl", "u", "t", "en", "2020", None, " ", None, None), ("b", None, "u", "t", "en", "2020", None, None, None, None), ("c", "synthetic", None, "", None, None, None, None, None, "g")], schema)
    assert rows(selection.disclosure_gaps(s)) == [
        ("1.3", "source.acquisition-date", "c", "required"), ("1.3", "source.content-types", "c", "required"), ("1.3", "source.languages", "c", "review"), ("1.3", "source.usage", "c", "required"),
        ("2", "source.category", "b", "required"), ("2.3", "source.web-evidence", "a", "required"),
    ]


def test_advice(spark):
    t = spark.createDataFrame(
        [("grown", "2024-01-01 00:00:00", 1.0, 1.0), ("grown", "2024-01-01 00:05:00", 1.0, 1.3), ("slow", "2024-01-01 00:00:00", 1.0, 1.0), ("slow", "2024-01-01 00:05:00", 1.0, 1.1), ("broken", "2024-01-01 00:05:00", float("nan"), None), ("quiet", "2024-01-01 00:00:00", 1.0, 1.0), ("done", "2024-01-01 00:00:00", 1.0, 1.0)],
        "run_id string, observed string, loss double, heldout_loss double",
    ).withColumn("observed", F.col("observed").cast("timestamp"))
    runs = spark.createDataFrame([("grown", "running"), ("slow", "running"), ("broken", "running"), ("quiet", "running"), ("done", "complete"), ("new", None)], "run_id string, state string")
    got = {r["run_id"]: r["advice"] for r in selection.run_advice(t, runs, F.lit("2024-01-01 00:11:00").cast("timestamp")).collect()}
    assert got == {"grown": "stop", "slow": "inspect", "broken": "stop", "quiet": "inspect", "done": "complete", "new": "wait"}


def test_conversations_of_turns(spark):
    turns = spark.createDataFrame([(1, 2, "Assistant ", "b"), (1, 1, "user", "a"), (2, 1, "user", "a"), (3, 1, "robot", "x"), (3, 2, "user", "y"), (3, 3, "assistant", "z"), (4, 1, "user", None)], "conv_id int, turn int, role string, text string")
    got = {r["conv_id"]: ([m["content"] for m in r["messages"]], r["valid"]) for r in selection.turns_to_conversations(turns).collect()}
    assert got == {1: (["a", "b"], True), 2: (["a"], False), 3: (["x", "y", "z"], False)}


def test_filter_policies(spark):
    f = policy.RecordFilter
    with pytest.raises(ValueError):
        f(main_content=None).validate()
    with pytest.raises(ValueError):
        f(licenses=policy.Values(["MIT"]), exclude_licenses=["GPL*"]).validate()
    with pytest.raises(ValueError):
        f(sources=policy.Values(["[a"])).validate()
    with pytest.raises(ValueError):
        f(date_from="2020-05", date_to="2020-04").validate()
    with pytest.raises(ValueError):
        f(date_from="May 2020").validate()
    f(date_from="2020", date_to="2020-04").validate()
    with pytest.raises(ValueError):
        policy.FilterPolicy().validate([])
    with pytest.raises(ValueError):
        policy.FilterPolicy(None, {"x": f()}).validate(["y"])
    policy.FilterPolicy(f(), {"y": f()}).validate(["y"])
    df = spark.createDataFrame([(1, "a", True, "en"), (2, "a", True, "fr"), (3, "b", True, "fr"), (4, None, True, None), (5, "b", False, "en")], "i int, source string, main_content boolean, language string")
    for c in ("license", "source_name", "date"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    p = policy.FilterPolicy(f(), {"a": f(languages=policy.Values(["en"]))})
    assert [r["i"] for r in df.where(p.predicate(F.col("source"))).orderBy("i").collect()] == [1, 3, 4]


def test_budgets(spark):
    b = spark.createDataFrame([(1000, None, None), (None, 7, None), (None, None, 3), (5, 5, None), (None, None, None), (-1, None, None)], "tokens long, steps long, epochs int")
    got = training.resolved(b.withColumn("batch_size", F.lit(4)).withColumn("sequence_length", F.lit(10)).withColumn("weighted", F.lit(False)).withColumn("balanced", F.lit(True))).collect()
    assert [(r["steps"], r["warmup_steps"], r["error"] is None) for r in got] == [(25, 2, True), (7, 1, True), (None, None, True), (None, None, False), (None, None, False), (None, None, False)]
    assert got[0]["capacity"] == 1000 and got[0]["data_order"] == "corpus-balanced-shuffle-v1"
    none = spark.createDataFrame([], "tokens long")
    assert training.epoch_steps(none, 4, 10).first()[:] == (0, 0)
    assert training.epoch_steps(spark.createDataFrame([(9,), (0,)], "tokens long"), 2, 10).first()[:] == (1, 1)
    shape = {"vocabulary": 100, "hidden": 8, "layers": 1, "heads": 1, "kv_heads": 1, "intermediate": 8, "tied": True}
    s = spark.createDataFrame([(0, 1, 8)], "planned_tokens long, batch_size int, sequence_length int")
    assert {r["seconds"] for r in training.forecast(s, shape).collect()} == {-1}
    big = spark.createDataFrame([(10, 1 << 20, 1 << 14)], "planned_tokens long, batch_size int, sequence_length int")
    assert training.forecast(big, shape).count() == 0


def test_calibration_cuts_at_a_whole_character(spark):
    rows_ = spark.createDataFrame([(1, 0, "ab"), (1, 1, ""), (1, 2, "éé"), (2, 0, "zz"), (3, 0, "never twice")], "shard long, row long, text string")
    shards = spark.createDataFrame([(1, "x"), (3, "x")], "shard long, sha256 string")
    got = training.calibration_sample(rows_, shards, 5, 1).collect()
    assert sorted((r["shard"], r["row"], r["take"], r["cut"]) for r in got) == [(1, 0, 2, False), (1, 2, 2, True)]
    assert training.calibration_sample(rows_.limit(0), shards, 5, 1).count() == 0


def test_byte_ids_of_long_texts(spark):
    text = "aé😀" * 20_000
    got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(T.byte_ids(F.col("t")).alias("i")).collect()
    assert got[0]["i"] == [b + 3 for b in text.encode()] and got[1]["i"] == [] and got[2]["i"] is None


def test_credentials_need_word_boundaries(spark):
    token = "ghp_" + "Ab1" * 8
    df = spark.createDataFrame([(f"x {token} y",), (f"x{token}",), (f"_{token}",), (f"({token})",)], "t string")
    got = [r["t"] for r in df.select(T.redact(F.col("t"), T.CREDENTIAL, "<CREDENTIAL>").alias("t")).collect()]
    assert got == ["x <CREDENTIAL> y", f"x{token}", f"_{token}", "(<CREDENTIAL>)"]


@pytest.mark.parametrize("change, ok", [
    (lambda t: t, True), (lambda t: t + "\n", False), (lambda t: t.replace('"role"', ' "role"', 1), False), (lambda t: t.replace("\\u003c", "<"), False), (lambda t: t.replace('"assistant"', '"robot"'), False),
    (lambda t: t.replace('"content":"x"', '"content":""'), False), (lambda t: t.replace('{"messages"', '{"more":1,"messages"'), False), (lambda t: t[:-1], False), (lambda t: "[]", False), (lambda t: t[:-1] + ',"tools":[{"n": 1.50}]}', True), (lambda t: t[:-1] + ',"tools":[1}', False),
])
def test_conversations_are_read_strictly(change, ok):
    text = '{"messages":[{"role":"user","content":"a \\u003c b","context":"c"},{"role":"assistant","content":"x"}]}'
    if ok:
        messages, tools = conversation.read(change(text))
        assert messages[0]["content"] == "a < b" and tools in (None, '[{"n": 1.50}]')
    else:
        with pytest.raises(ValueError):
            conversation.read(change(text))


def test_conversations_come_back(spark):
    data = [(1, [("user", "q \u2028 \"x\" \\\\ \x01\t", None), ("assistant", "<b>&", "ctx")], None), (2, [("system", "s", ""), ("user", "u", None), ("assistant", "a", None)], '[{"f": 1}]'), (3, [("user", "u", None)], None)]
    df = spark.createDataFrame(data, "i int, messages array<struct<role string, content string, context string>>, tools string")
    got = df.select("i", conversation.valid(F.col("messages")).alias("valid"), conversation.decode(conversation.encode(F.col("messages"), F.col("tools"))).alias("d")).orderBy("i").collect()
    assert [r["valid"] for r in got] == [True, True, False] and got[2]["d"]["error"] is not None
    for r, (_, messages, tools) in zip(got[:2], data):
        assert [(m["role"], m["content"], m["context"] or None) for m in r["d"]["messages"]] == [(a, b, c or None) for a, b, c in messages] and r["d"]["tools"] == tools
    none = spark.createDataFrame([(None,)], "t string").select(conversation.decode("t").alias("d")).first()
    assert none["d"]["error"] == "null"
