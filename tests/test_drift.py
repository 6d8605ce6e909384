"""Drifting schemas: changes between files, matching, one table."""

import itertools
import json

import numpy as np
import pytest

from corploom.operators import drift

SCHEMA = "feed string, file_id long, file_no int, line_no int, record_json string"


def frame(spark, files, feed="f"):
    rows = [(feed, 10 + no, no, i, json.dumps(r) if not isinstance(r, (str, type(None))) else r) for no, records in files.items() for i, r in enumerate(records)]
    return spark.createDataFrame(rows, SCHEMA)


def found(df):
    return {(r["file_no"], r["field_name"], r["change_kind"]) for r in drift.changes(df).collect()}


def test_changes(spark):
    a = [{"id": f"x{i}", "tokens": 100 + i, "lang": ["en", "fr", "de", "es"][i % 4], "note": "n"} for i in range(20)]
    b = [{"id": f"x{i}", "n_tokens": 105 + i, "locale": ["en", "fr", "de", "es"][i % 4], "flag": True} for i in range(20)]
    c = [{"id": i, "n_tokens": None, "locale": None, "flag": True} for i in range(20)]
    d = [{"id": i, "n_tokens": "7", "locale": "en", "flag": True} for i in range(20)]
    assert found(frame(spark, {1: a, 3: b, 4: c, 5: d})) == {
        (3, "n_tokens", "renamed"), (3, "locale", "renamed"), (3, "note", "removed"), (3, "flag", "added"), (4, "id", "retyped"), (5, "n_tokens", "retyped"),
    }


def test_nulls_keep_the_type_across_a_rename(spark):
    a = [{"tokens": i, "id": "a"} for i in range(9)]
    b = [{"n_tokens": None, "id": "a"} for _ in range(9)]
    c = [{"n_tokens": str(i), "id": "a"} for i in range(9)]
    assert found(frame(spark, {1: a, 2: b, 3: c})) == {(2, "n_tokens", "renamed"), (3, "n_tokens", "retyped")}


def test_types_over_many_renames_of_nulls(spark):
    """Six renames of a field of nulls, then values of another type: it is still known that they were numbers."""
    names = ["tokens", "tokens_a", "tokens_b", "tokens_c", "tokens_d", "tokens_e", "tokens_f"]
    files = {1: [{"tokens": i, "id": "a"} for i in range(9)]} | {no + 2: [{n: None, "id": "a"}] for no, n in enumerate(names[1:])} | {9: [{"tokens_f": "seven", "id": "a"}]}
    want = {(no + 2, n, "renamed") for no, n in enumerate(names[1:])} | {(9, "tokens_f", "retyped")}
    assert found(frame(spark, files)) == want


def test_a_name_used_again_begins_anew(spark):
    a = [{"tokens": i, "id": "a"} for i in range(9)]
    b = [{"n_tokens": i, "id": "a"} for i in range(9)]
    c = [{"n_tokens": i, "id": "a", "tokens": "x y"} for i in range(9)]
    assert found(frame(spark, {1: a, 2: b, 3: c})) == {(2, "n_tokens", "renamed"), (3, "tokens", "added")}


def test_values_of_a_chain_of_renames_are_kept(spark):
    """language -> zunge -> spr: the values stay in the column, and a surplus field of the column goes to meta."""
    say = lambda i: ["en", "fr", "de", "es"][i % 4]
    a = [{"language": say(i), "text": f"t{i}"} for i in range(30)]
    b = [{"zunge": say(i), "text": f"t{i}"} for i in range(30)]
    c = [{"spr": say(i), "text": f"t{i}"} for i in range(30)] + [{"spr": "de", "lang": "nl", "text": "both", "body": None}]
    df = frame(spark, {1: a, 2: b, 3: c})
    got = drift.unify_records(df, drift.field_links(df)).collect()
    assert len(got) == 91 and sum(r["language"] is not None for r in got) == 91
    both = next(r for r in got if r["text"] == "both")
    assert {both["language"]} | set(json.loads(both["meta"]).values()) == {"de", "nl"} | ({None} & set(json.loads(both["meta"]).values()))


def test_unreadable_records_are_reported(spark):
    df = frame(spark, {1: [{"text": "a"}, "not json", None, "[1]"], 2: [{"text": "b"}]})
    got = {(r["file_no"], r["line_no"]): r for r in drift.unify_records(df, drift.field_links(df)).collect()}
    assert len(got) == 5 and got[1, 1]["meta"] == "not json" and got[1, 1]["text"] is None and got[1, 2]["meta"] is None and got[1, 0]["text"] == "a"
    assert [(r["file_no"], r["unreadable"]) for r in drift.unreadable(df).collect()] == [(1, 3)]
    assert drift.unify_records(df.limit(0), drift.field_links(df.limit(0))).count() == 0


def test_unreadable_records_and_empty_tables(spark):
    assert found(frame(spark, {1: [{"a": 1}, "not json", None, "[1]"], 2: ['{"a": 2}', ""]})) == set()
    assert drift.changes(frame(spark, {1: [{}]}).limit(0)).count() == 0


def test_kinds(spark):
    rows = [{"i": 12345678901234567890, "f": 1.5, "s": "x", "b": False, "a": [1], "o": {"k": 1}, "e": 1.0, "n": None}]
    got = {r["field"]: r["kind"] for r in drift.profiles(frame(spark, {1: rows})).collect()}
    assert got["s"] == "string" and got["f"] == "fraction" and got["b"] == "boolean" and got["a"] == "array" and got["o"] == "object" and got["i"] == "integer" and got["n"] is None


@pytest.mark.parametrize("n, m", [(1, 1), (2, 3), (4, 2), (4, 4)])
def test_assignment_against_brute_force(n, m):
    rng = np.random.default_rng(n * 10 + m)
    for _ in range(30):
        s = rng.random((n, m))
        best = max(sum(s[i, j] for i, j in zip(p, q)) for p in itertools.permutations(range(n), min(n, m)) for q in itertools.permutations(range(m), min(n, m)))
        assert abs(sum(s[i, j] for i, j in drift.assign(s)) - best) < 1e-9


@pytest.mark.parametrize("a, b, like", [("is_boilerplate", "boilerplateContent", True), ("language", "lang", True), ("tokens", "n_tokens", True), ("rights", "crawl", False), ("mainContent", "main_content", True)])
def test_names(a, b, like):
    assert (drift.name_likeness(a, b) >= 0.6) is like


def test_one_table(spark):
    df = frame(spark, {1: [{"text": "t", "tokens": "12", "locale": "en", "lang_conf": 0.75, "date": 20160701, "is_boilerplate": "yes", "odd": [1], "extra": "{\"u\": 1}"}]})
    r = drift.unify_records(df).first()
    assert (r["token_count"], r["language"], r["language_score"], r["date"], r["boilerplate_content"], r["main_content"]) == (12, "en", 750, "2016-07-01", True, True)
    assert json.loads(r["meta"])["other"]["odd"] == "[1]"


def test_layouts(spark):
    legacy = spark.createDataFrame([("AB" * 32, "pretrain", "t", "s", "", "MIT", "", "en", 0, "", 0, "")], "sha256 string, kind string, text string, source string, source_name string, license string, license_raw string, lang string, lang_score long, date string, tokens long, meta string")
    r = drift.unify_layout(legacy, "old").first()
    assert r["content_sha256"] == bytes.fromhex("ab" * 32) and r["source_name"] is None and r["token_count"] is None and r["language"] == "en" and r["main_content"] is True and r["email_addresses"] is None
