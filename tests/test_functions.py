"""Text functions, redaction and policies on worked examples."""

import pytest
from pyspark.sql import functions as F

from corploom.functions import policy, privacy
from corploom.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in zip(values, ["string"] * len(values))))
    return df.select(column.alias("x")).first()["x"]


def test_redaction_counts_and_second_pass():
    text, n = privacy.redact_text("node 172.20.4.9 beside 10.41.7.250, then 2001:db8:7::5.+31 20 4418 2093")
    assert "<IP_ADDRESS>" in text and n[1] >= 2
    assert privacy.redact_text("shelf 301-2244-18") == ("shelf 301-2244-18", [0] * 5)


def test_redaction_replaces_mail_keys_and_credentials():
    t = 'letters go to q.mole@burrow.example, secret: "tunnel-and-root-9"\n-----BEGIN PRIVATE KEY-----\nx\n-----END PRIVATE KEY-----'
    text, n = privacy.redact_text(t)
    assert n == [1, 0, 0, 0, 2] and "mole" not in text and "tunnel" not in text


def test_routing_headers_go_with_their_folded_lines():
    t = "Subject: weights\nReceived: via kiln\n\tand oven\nFrom: potter\n\nclay"
    text, n = privacy.redact_text(t)
    assert text == "Subject: weights\nFrom: potter\n\nclay" and n[3] == 1
    assert privacy.redact_text("Remark: kiln\n\nReceived: with thanks") == ("Remark: kiln\n\nReceived: with thanks", [0] * 5)


def test_placeholders_match_no_detector():
    for p in privacy.PLACEHOLDERS.values():
        assert privacy.redact_text(p) == (p, [0] * 5)


def test_json_values_are_redacted_but_not_keys():
    new, n = privacy.redact_json('{"b@x.example": ["c@y.example"], "k": 1}')
    assert n[0] == 1 and "b@x.example" in new and "\\u003cEMAIL_ADDRESS\\u003e" in new


def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(None,), ("",), ("x@y.example",)], "t string")
    rows = df.select(privacy.redacted(F.col("t")).alias("r"), T.has_email(F.col("t")).alias("e"), T.is_boilerplate(F.col("t")).alias("b")).collect()
    assert [r["r"]["text"] for r in rows] == [None, "", "<EMAIL_ADDRESS>"] and [r["e"] for r in rows] == [False, False, True] and not any(r["b"] for r in rows)


@pytest.mark.parametrize("raw, wanted", [("MIT License", "MIT"), ("cc_by nc 4.0", "CC-BY-NC-4.0"), ("CC ZERO 1.0", "CC0-1.0"), ("see https://creativecommons.org/licenses/by-sa/3.0/ there", "CC-BY-SA-3.0"), (" public domain ", "LicenseRef-Public-Domain"), ("Own terms", "Own terms")])
def test_licenses(spark, raw, wanted):
    assert one(spark, T.normalize_license(F.col("v")), v=raw) == wanted


def test_eightgrams():
    w = list("abcdefgh") * 3
    assert privacy.eightgram_share(w) == 16 / 24


@pytest.mark.parametrize("raw, wanted", [('["cc by-nc 4.0","CC-BY-NC-4.0"]', "CC-BY-NC-4.0"), ('["MIT License", "cc0 1.0"]', "CC0-1.0 AND MIT"), ("CC_ZERO 1.0", "CC0-1.0"), ("[own terms", "[own terms"), (None, None)])
def test_raw_licenses(spark, raw, wanted):
    df = spark.createDataFrame([(raw,)], "v string")
    assert df.select(T.normalize_raw_license(F.col("v"))).first()[0] == wanted


def test_every_raw_license_is_read(spark, small):
    from corploom.plans import reference

    got = reference.license_normalize(spark, small)
    rows = {r["row_id"]: r["license_raw"] for r in spark.read.parquet(f"{small}/text_rows.parquet").select("row_id", "license_raw").collect()}
    known = {"cc by 4.0": "CC-BY-4.0", "CC-BY 4.0": "CC-BY-4.0", "cc by-sa 4.0": "CC-BY-SA-4.0", "CC_ZERO 1.0": "CC0-1.0", "MIT License": "MIT", "Public Domain": "LicenseRef-Public-Domain", '["cc by-nc 4.0","CC-BY-NC-4.0"]': "CC-BY-NC-4.0"}
    mine = {int(r["id"]): r for r in got.where("part = 'text_rows'").collect()}
    assert mine.keys() == rows.keys() and any(rows.values())
    assert all(mine[k]["license_raw"] == v and mine[k]["license"] == known.get(v, mine[k]["license"]) for k, v in rows.items())
    assert got.where("(license is null) <> (license_raw is null)").count() == 0
    assert {r["part"] for r in got.select("part").distinct().collect()} == {"text_rows", "shard_v1", "shard_v2", "shard_v3", "shard_legacy"}


def test_canonical_json_escapes(spark):
    c = {k: F.col(k) for k in ("sha256", "text", "source", "source_name", "license", "license_raw", "lang", "date", "meta")} | {"lang_score": F.lit(0), "tokens": F.lit(3)}
    line = one(spark, T.canonical_json(c), sha256="ab", text='q" \\ \n\x01é', source="s", source_name=None, license="MIT", license_raw="", lang=None, date=None, meta='{"a":1}')
    assert line == '{"sha256":"ab","kind":"pretrain","text":"q\\" \\\\ \\n\\u0001é","source":"s","license":"MIT","tokens":3,"meta":{"a":1}}'


def test_byte_ids_and_truncation(spark):
    assert one(spark, T.byte_ids(F.col("t")), t="Aé") == [68, 198, 172]
    assert one(spark, T.byte_ids(F.col("t")), t="") == []
    assert one(spark, privacy.truncate_utf8(F.col("t"), F.lit(2)), t="aé") == "a"


def test_render(spark):
    m = F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content"), F.lit("ctx").alias("context")), F.struct(F.lit("assistant").alias("role"), F.lit("yo").alias("content"), F.lit(None).cast("string").alias("context")))
    assert one(spark, T.render(m, "user-assistant-v1"), t="x") == "User: hi\n\nctx\n\nAssistant:yo"
    assert one(spark, T.render(m, "chatml-v1"), t="x") == "<|im_start|>user\nhi\n\nctx<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
    assert one(spark, T.with_tools(m, F.lit("T")), t="x")[0]["content"] == "Available tools:\nT"


@pytest.mark.parametrize("pattern, value, hit", [("CC-*", "CC-BY", True), ("web/*", "web/a/b", False), ("a?c", "abc", True), ("[a-c]x", "bx", True), ("[^a]x", "ax", False), (r"a\*", "a*", True), ("a.c", "abc", False)])
def test_globs(spark, pattern, value, hit):
    assert one(spark, policy.any_match(F.col("v"), [pattern]), v=value) is hit


@pytest.mark.parametrize("date, hit", [("2010", True), ("2009-12", False), ("2010-01-31", True), ("2010-13", False), ("2010-02-30", False), ("2010-06-01T00:00:00Z", True), (None, False), ("soon", False)])
def test_dates(spark, date, hit):
    assert one(spark, policy.date_overlaps(F.col("d"), "2010", "2010-12"), d=date) is hit


def test_null_flags_never_exclude(spark):
    df = spark.createDataFrame([(1, None), (2, True), (3, False)], "i int, boilerplate_content boolean")
    df = df.withColumns({k: F.lit(None).cast("string") for k in ("license", "language", "source", "source_name", "date")}).withColumns({"main_content": F.lit(None).cast("boolean"), "repetitive_content": F.lit(None).cast("boolean")})
    assert [r["i"] for r in df.where(policy.RecordFilter(boilerplate=True).predicate()).orderBy("i").collect()] == [1, 3]
