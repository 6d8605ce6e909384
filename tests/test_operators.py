"""Deduplication, catalogue, training views and record mapping."""

import json

import pytest
from pyspark.sql import functions as F

from corploom.operators import catalog, dedup, mapping, training


def test_keep_first_with_nulls_ties_and_clashing_columns(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 5, "z"), (None, 4, "w")], "k string, o int, _first string")
    assert sorted(r["o"] for r in dedup.keep_first(df, ["k"], ["o"]).collect()) == [1, 4]
    assert dedup.keep_first(df.limit(0), ["k"], ["o"]).count() == 0
    assert sorted(r["o"] for r in dedup.keep_first_window(df, ["k"], ["o"]).collect()) == [1, 4]


def test_tree_totals_and_circles(spark):
    e = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "c")], "parent string, child string")
    leaves = spark.createDataFrame([("c", 2), ("b", 3)], "node string, v int")
    assert {r["node"]: r["v"] for r in catalog.tree_totals(e, leaves, "v").collect()} == {"c": 2, "b": 3, "a": 2, "r": 5}
    with pytest.raises(ValueError):
        catalog.tree_totals(e.union(spark.createDataFrame([("c", "r")], "parent string, child string")), leaves, "v", 5)


def test_inventory_and_prefixes(spark):
    a = spark.createDataFrame([("x",), ("y",)], "k string")
    b = spark.createDataFrame([("y",), ("y",), ("z",)], "k string")
    assert {(r["k"], r["state"], r["references"]) for r in catalog.inventory(a, b, "k").collect()} == {("x", "unreferenced", 0), ("y", "referenced", 2), ("z", "missing", 1)}
    p = catalog.longest_prefix(spark.createDataFrame([("a/b/c",), ("ab",)], "path string"), spark.createDataFrame([("a",), ("a/b",)], "prefix string"))
    assert {r["path"]: r["prefix"] for r in p.collect()} == {"a/b/c": "a/b", "ab": None}


def test_weighted_order_prefixes(spark):
    rows = [("a", i, 20) for i in range(2)] + [("b", i, 1) for i in range(6)]
    df = spark.createDataFrame(rows, "corpus string, seq long, tokens long")
    order = [r["corpus"] for r in training.weighted_order(df, {"a": 1, "b": 1}).orderBy("key", "corpus").collect()]
    assert order[:4] == ["a", "b", "b", "b"]
    df = spark.createDataFrame([(c, i, 10) for c in "ab" for i in range(4)], "corpus string, seq long, tokens long")
    order = [r["corpus"] for r in training.weighted_order(df, {"a": 3, "b": 1}).orderBy("key", "corpus").collect()]
    assert order[:5] == ["a", "b", "a", "a", "a"]


def test_packing_against_a_plain_loop(spark):
    sizes = [3, 0, 7, 1, 12, 5]
    df = spark.createDataFrame(list(enumerate(sizes)), "seq long, tokens long")
    got = {r["window"]: r["targets"] for r in training.pack_windows(df, 4).collect()}
    total = sum(sizes) + len(sizes) - 1
    assert got == {w: min(4, total - 4 * w) for w in range(-(-total // 4))}


def test_prefix_sums_over_many_ranges(spark):
    df = spark.range(1000).select(F.lit("k").alias("k"), F.col("id").alias("seq"), (F.col("id") % 7).alias("v"))
    got = training.prefix_sums(df, ["k"], "seq", "v", width=64).orderBy("seq").collect()
    run = 0
    for r in got:
        assert r["before"] == run
        run += r["v"]


def test_stratified_holdout(spark):
    import hashlib

    records = [("ab"[i % 2], str(i), 10 + 30 * (i % 3)) for i in range(8)] + [("c", "8", 500)]
    df = spark.createDataFrame(records, "corpus string, id string, size long")
    got = training.stratified_holdout(df.where("corpus <> 'c'"), 7, 0.5, 4, 1000).collect()
    assert sorted(r["corpus"] for r in got) == ["a", "a", "b", "b"]
    # more corpora than places, and records beyond the bytes left
    for fraction, most, budget in ((0.2, 2, 1000), (0.9, 20, 150), (1.0, 20, 1000), (0.01, 20, 1000)):
        scored = sorted((c, hashlib.sha256((7).to_bytes(8, "big") + i.encode()).hexdigest(), i, n) for c, i, n in records)
        seen, order = {}, []
        for c, _, i, n in scored:
            seen[c] = seen.get(c, 0) + 1
            order.append((seen[c], c, i, n))
        want, left = set(), budget
        for _, c, i, n in sorted(order):
            if len(want) < min(-(-len(records) * int(fraction * 100) // 100), most, len(records) - 1) and n <= left:
                want, left = want | {i}, left - n
        assert {r["id"] for r in training.stratified_holdout(df, 7, fraction, most, budget).collect()} == want
    assert training.stratified_holdout(df, 7, 0, 20, 120).count() == 0 and training.stratified_holdout(df.limit(1), 7).count() == 0


def test_stage_order_takes_turns_by_weight(spark):
    records = [("abc"[i % 3], i, 1 + i * 7 % 5) for i in range(60)]
    df = spark.createDataFrame(records, "corpus string, seq long, tokens long")
    weights = {"s": {"a": 3, "b": 2}, "t": {"a": 999_999_999_989, "b": 999_999_999_961, "c": 7, "none": 5}}
    w = spark.createDataFrame([(s, c, n) for s, each in weights.items() for c, n in each.items()] + [("t", "b", 0)], "stage string, corpus string, weight long")
    got = training.stage_order(df, w).collect()
    for stage, each in weights.items():
        heads = {c: [r for r in records if r[0] == c] for c in each}
        spent, want = dict.fromkeys(each, 0), []
        while any(heads.values()):
            c = next(c for c in sorted(each) if heads[c] and all(spent[c] * each[o] <= spent[o] * each[c] for o in each if heads[o]))
            r = heads[c].pop(0)
            want.append(r[1])
            spent[c] += r[2]
        mine = sorted((r for r in got if r["stage"] == stage), key=lambda r: (r["key"], r["corpus"], r["seq"]))
        assert [r["seq"] for r in mine] == want
    assert {r["seq"] for r in training.balanced_order(df).collect()} == set(range(60))


def test_canonical_lines_have_all_columns(spark, small, tmp_path):
    import hashlib
    import json

    from corploom.plans import reference

    kept = spark.read.parquet(f"{small}/text_rows.parquet")
    rare = kept.limit(1).withColumn("row_id", F.lit(-1).cast("long")).withColumn("text", F.lit("a\x01\x0b\x0c\x08\x1f b"))
    kept.unionByName(rare).write.parquet(str(tmp_path / "text_rows.parquet"))
    want = {}
    for r in kept.unionByName(rare).collect():
        one = {"sha256": hashlib.sha256(r["text"].encode()).hexdigest(), "kind": "pretrain", "text": r["text"], "source": r["source"]}
        optional = {"source_name": "source_name", "license": "license", "license_raw": "license_raw", "lang": "language", "lang_score": "language_score", "date": "date", "tokens": "token_count"}
        one |= {k: r[v] for k, v in optional.items() if r[v]}
        line = json.dumps(one, ensure_ascii=False, separators=(",", ":"))
        want[r["row_id"]] = hashlib.sha256((line[:-1] + (f',"meta":{r["meta"]}' if r["meta"] else "") + "}").encode()).hexdigest()
    assert {r["row_id"]: r["line"] for r in reference.canonical_jsonl(spark, str(tmp_path)).collect()} == want


def test_holdout_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([(f"s:{i}", 100 if i % 2 else 10) for i in range(40)], "id string, size long")
    got = training.holdout(df, 7, 0.5, 20, 120).collect()
    assert 1 <= len(got) <= 20 and sum(r["size"] for r in got) <= 120
    assert training.holdout(df, 7, 0, 20, 120).count() == 0
    assert training.holdout(df.limit(2), 7, 0.01, 20, 1000).count() == 1


def test_budgets():
    assert training.steps_for_tokens(101, 2, 8) == 7
    assert training.decoder_parameters(10, 4, 1, 2, 1, 8, True) == 40 + 2 * 16 + 2 * 8 + 3 * 32 + 12


def test_byte_targets(spark):
    df = spark.createDataFrame([("A",), ("é",)], "text string")
    assert training.byte_targets(df).first()["targets"] == 4 and training.byte_targets(df, 2).first()["targets"] == 9


def test_shuffle_keeps_every_row_and_passes_large_ones(spark):
    df = spark.createDataFrame([("c", s, i, 10) for s in "xy" for i in range(30)], "corpus string, shard string, row long, size long")
    got = training.bounded_shuffle(df, 3, most=8).orderBy("place").collect()
    assert len({(r["shard"], r["row"]) for r in got}) == 60 and [r["row"] for r in got[:30]] != list(range(30))
    whole = [(r["shard"], r["row"]) for r in training.bounded_shuffle(df, 3, most_bytes=1).orderBy("place").collect()]
    assert [x[1] for x in whole[:30]] == list(range(30))


def test_schedule_and_forecast(spark):
    rates = [r["rate"] for r in training.cosine_schedule(spark, 100, 10).orderBy("step").collect()]
    assert rates[9] == 1.0 and rates[-1] < 0.11 and max(rates) == 1.0
    shape = {"vocabulary": 32000, "hidden": 2048, "layers": 16, "heads": 32, "kv_heads": 8, "intermediate": 8192, "tied": True}
    stages = spark.createDataFrame([(10**10, None, 2048), (10**9, 8, 512)], "planned_tokens long, batch_size int, sequence_length int")
    got = training.forecast(stages, shape).collect()
    need = 8 * 512 * (2048 * 16 * 72 + 32000 * 6)  # the second stage needs more
    assert got and [r["seconds"] for r in got] == sorted((r["seconds"] for r in got), reverse=True)
    assert all(r["required"] == -(-training.decoder_parameters(**shape) * 16 // r["gpus"]) + need + (4 << 30) for r in got)


def test_paths():
    r = {"a": {"b": [{"c": 1}, {"c": "x"}, {}]}, "n": None}
    assert mapping.values(r, "a.b[].c") == ["1", "x"] and mapping.values(r, "n") == [] and mapping.values(r, "q.z") == []
    with pytest.raises(ValueError):
        mapping.values(r, "a.b")


def test_record_mapping(spark):
    p = mapping.Profile(text=("head", "body[].t"), fallback="url", license=("lic[]",), meta={"u": "url", "tags": "tags[]"}, main={"ok": "true"})
    raws = ['{"head":"H","body":[{"t":"B"},{"t":" "}],"lic":["MIT License","cc by 4.0"],"url":"u","tags":["x","y"],"ok":true}', '{"url":"only","ok":false}', '{"ok":true}', "not json", None]
    df = spark.createDataFrame([(i, r, "zz") for i, r in enumerate(raws)], "i int, record string, text string")
    got = mapping.map_records(df, p).orderBy("i").collect()
    assert [r["outcome"] for r in got] == ["ok", "ok", "empty", "malformed", "malformed"]
    assert got[0]["text"] == "H\n\nB" and got[0]["meta"] == '{"tags": ["x", "y"], "u": "u"}' and got[0]["main_content"] and not got[1]["main_content"]
    rows = mapping.canonical(mapping.map_records(df, p).withColumn("origin", F.lit("f#line=1"))).collect()
    assert {r["license"] for r in rows} == {"CC-BY-4.0 AND MIT", ""} and rows[0]["source"] == "f#line=1"


def test_conversations():
    assert [m["role"] for m in mapping.chat(["Human", "GPT"], ["a", "b"], "s")] == ["system", "user", "assistant"]
    with pytest.raises(ValueError):
        mapping.chat(["user"], ["a"])
    tree = {"text": "q", "replies": [{"text": "late", "rank": 2}, {"text": "good", "rank": 0, "replies": [{"text": "dangling", "rank": 0}]}]}
    assert [m["content"] for m in mapping.ranked_path(tree)] == ["q", "good"]
    out = mapping.map_one(json.dumps({"p": "hi", "r": "yo"}), mapping.Profile("dialogue", ("p", "r")))
    assert out["kind"] == "conversation" and mapping.map_one('{"p":"hi","r":" "}', mapping.Profile("dialogue", ("p", "r")))["outcome"] == "empty"


def test_heavy_keys_are_looked_up_where_the_rows_are(spark):
    from corploom.operators.joins import semi_join

    rows = spark.createDataFrame([(i % 3 if i % 2 else 9, i) for i in range(200)] + [(None, 1)], "k int, v int")
    known = spark.createDataFrame([(9, 100), (0, 33), (7, 5)], "k int, n long")
    want = sorted(r["v"] for r in rows.where("k in (9, 0)").collect())
    for heavy, most in ((1000, 10), (50, 10), (50, 0), (1, 10)):
        assert sorted(r["v"] for r in semi_join(rows, known, ["k"], "n", heavy, most).collect()) == want
    assert semi_join(rows, known.limit(0), ["k"], "n").count() == 0
