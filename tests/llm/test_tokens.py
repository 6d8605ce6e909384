"""Encoding and counting against public libraries, mixing and packing against brute force."""

import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from corploom.llm import bpe, counting, mixing, packing, tokens

tiktoken = pytest.importorskip("tiktoken")

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def ranks():
    return bpe.parse_ranks(bpe.read_ranks())


@pytest.fixture(scope="module")
def plain(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder(ranks):
    return bpe.Encoder(ranks)


HARD = ["", " ", "\n\n", "it's 'tis'll he'LL 's", "a  b\t\tc \n", "x" * 5000, "ab" * 4000 + "1" * 3000, "é́ß中文 😀👍🏽", "  x", "<|endoftext|>", "​﻿", "'" * 9 + "s", "1½٣Ⅷ", "".join(map(chr, range(0x20, 0x400)))]


def test_ids_equal_those_of_a_public_library(plain, encoder):
    random.seed(3)
    alphabet = ["'", "s", "ll", "re", " ", "  ", "\n", "\t", "a", "Zx", "é", "1", "½", "!", "…", "😀", "\r\n", "中", "́"]
    texts = HARD + ["".join(random.choices(alphabet, k=random.randint(0, 40))) for _ in range(400)]
    ids, at = encoder.encode(texts)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == plain.encode_ordinary(t), t


def test_counts_equal_the_numbers_of_ids(ranks, plain, encoder):
    counter = counting.MergeCounter(ranks, splitter=encoder.splitter)
    assert counter.counts(HARD).tolist() == [len(plain.encode_ordinary(t)) for t in HARD]
    random.seed(4)
    for _ in range(500):
        w = bytes(random.choices(b"abesthing \n0\xc3\xa9xX", k=random.randint(1, 60)))
        assert counter.count(w) == len(encoder.merge([w])[0])


def test_longest_match_against_a_plain_scan():
    random.seed(5)
    for _ in range(200):
        vocabulary = sorted({bytes([x]) for x in b"abc"} | {bytes(random.choices(b"abc", k=random.randint(1, 5))) for _ in range(random.randint(0, 12))})
        m = counting.LongestMatch(vocabulary)
        for _ in range(20):
            w = bytes(random.choices(b"abcd", k=random.randint(0, 25)))
            i = n = 0
            while i < len(w):
                i += max([len(v) for v in vocabulary if w.startswith(v, i)], default=1)
                n += 1
            assert m.count(w) == n


def test_the_queue_gives_ranks_in_order():
    q = bpe.RankQueue(50257)
    random.seed(6)
    ranks_ = [random.randrange(50257) for _ in range(2000)]
    for i, r in enumerate(ranks_):
        q.push(r, [i])
    out = []
    while (got := q.pop()) is not None:
        out += [got[0]] * len(got[1])
    assert out == sorted(ranks_)


def test_columns_with_nulls_empties_and_clashes(spark, plain):
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "hi there", 7), (3, "hi there", 7)], "doc_id int, text string, ids int")
    got = tokens.encode(df).orderBy("doc_id").collect()
    assert [r["ids"] for r in got] == [None, [], plain.encode_ordinary("hi there"), plain.encode_ordinary("hi there")]
    assert [r["n_tokens"] for r in tokens.count_tokens(df).orderBy("doc_id").collect()] == [None, 0, 2, 2]
    assert tokens.encode(df.limit(0)).count() == 0


def test_totals_and_wrong_counts(spark):
    rows = [(1, "one two", "a", "EN-us", '{"url":"http://WWW.X.test:80/p"}', 2), (2, "one", "a", "und", "{", 6), (3, None, "b", None, None, None), (4, "one two three", "b", "eng", None, 0), (5, "", "b", "en", None, 0)]
    df = spark.createDataFrame(rows, "row_id long, text string, source string, language string, meta string, token_count long")
    got = {(r["slice"], r["name"]): (r["docs"], r["tokens"]) for r in tokens.token_totals(df).collect()}
    assert got["source", "a"] == (2, 3) and got["language", "en"] == (3, 5) and got["language", None] == (2, 1) and got["domain", "x.test"] == (1, 2) and got["all", None] == (5, 6)
    assert {r["row_id"] for r in tokens.wrong_counts(df).collect()} == {2, 3, 4}


def test_water_filling():
    assert mixing.water_fill([1, 1], [100, 100], 50) == [25, 25]
    assert mixing.water_fill([3, 1], [30, 100], 100) == [30, 70]
    assert mixing.water_fill([1, 1], [10, 20], 100) == [10, 20]
    assert mixing.water_fill([2, 1, 1], [10, 1000, 1000], 100) == [10, 45, 45]
    random.seed(7)
    for _ in range(200):
        w, c = [random.randint(1, 9) for _ in range(5)], [random.randint(0, 50) for _ in range(5)]
        got = mixing.water_fill(w, c, 60)
        assert sum(got) == min(60, sum(c)) and all(0 <= g <= x for g, x in zip(got, c))
        level = max([g / Fraction(x) for g, x, k in zip(got, w, c) if g < k], default=None)
        assert level is None or all(g == k or g / Fraction(x) == level for g, x, k in zip(got, w, c))


def test_mix_and_short_sources(spark):
    rows = [(i, "word " * (i % 7 + 1), "web/Big" if i % 3 else "gov/small") for i in range(600)] + [(1000, None, "web/Big"), (1001, "", "gov/small")]
    df = spark.createDataFrame(rows, "row_id long, text string, source string")
    weights = spark.createDataFrame([("s", "WEB/big.yaml", 1, 3), ("s", "gov/small", 3, 2), ("s", " Science/Gone.json ", 1, 5)], "stage string, corpus string, weight long, max_repeats int")
    stages = spark.createDataFrame([("s", 5000, 1)], "name string, planned_tokens long, seed long")
    m = mixing.mix(df, weights, stages, per_bucket=9).collect()
    by = Counter()
    for r in m:
        by[r["source"]] += r["copies"] * r["n_tokens"]
        assert r["copies"] <= (3 if r["source"] == "web/Big" else 2)
    small = sum(r["n_tokens"] for r in mixing.source_tokens(df).where("source = 'gov/small'").collect())
    assert by["gov/small"] == 2 * small and abs(by["web/Big"] - (5000 - 2 * small)) <= 8
    assert {(r["stage"], r["source"]) for r in mixing.short_sources(df, weights, stages).collect()} == {("s", "gov/small"), ("s", "science/gone")}
    assert mixing.mix(df.limit(0), weights, stages).count() == 0


def test_names_of_short_sources(spark):
    """Two spellings of one source are one; a source without rows is named without blanks, capitals and suffix; no rows at all is no failure."""
    df = spark.createDataFrame([(1, "some words", "web/Big")], "row_id long, text string, source string")
    weights = spark.createDataFrame([("s", " WEB/BIG.yaml", 1, 1), ("s", "web/big", 1, 1), ("s", " X.yaml", 1, 9), ("s", "Y.JSON", 1, 9), ("s", "z", 0, 1)], "stage string, corpus string, weight long, max_repeats int")
    stages = spark.createDataFrame([("s", 1000, 1)], "name string, planned_tokens long, seed long")
    found = lambda rows: sorted(r["source"] for r in mixing.short_sources(rows, weights, stages).collect())
    assert found(df) == ["web/Big", "x", "y"]
    assert found(df.limit(0)) == ["web/big", "x", "y"]


def test_patterns_hold_every_item_once():
    rng = np.random.default_rng(8)
    for capacity in (1, 7, 64, 300):
        sizes = Counter(rng.integers(1, capacity + 1, 500).tolist())
        ends, patterns = packing.make_patterns(dict(sizes), capacity)
        used = Counter()
        for times, combo in patterns:
            assert times > 0 and sum(ends[k] for k in combo) <= capacity
            for k in combo:
                used[k] += times
        by_class = Counter()
        for n, c in sizes.items():
            by_class[int(np.searchsorted(ends, n))] += c
        assert used == by_class
        containers, total = sum(t for t, _ in patterns), sum(n * c for n, c in sizes.items())
        assert containers <= 1.12 * max(total / capacity, 1) + 2 + (capacity == 7) * 40


def test_nnls_against_projected_gradient():
    rng = np.random.default_rng(9)
    for n in (5, 40):
        found = [tuple(rng.integers(0, 12, rng.integers(1, 4)).tolist()) for _ in range(n)]
        a, b = np.zeros((12, n)), rng.random(12) * 10
        for j, combo in enumerate(found):
            np.add.at(a[:, j], list(combo), 1)
        x = packing.nnls(found, b)
        y = np.zeros(n)
        for _ in range(60_000):
            y = np.maximum(0, y - a.T @ (a @ y - b) / 400)
        assert (x >= 0).all() and np.linalg.norm(a @ x - b) <= np.linalg.norm(a @ y - b) + 1e-3


def test_pack_splits_only_what_does_not_fit(spark):
    rows = [(i, (i * 37) % 50) for i in range(300)] + [(900, 205), (901, 100), (902, None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), 100).collect()
    fill, pieces = Counter(), Counter()
    for r in got:
        fill[r["container"]] += r["length"]
        pieces[r["doc_id"]] += r["length"]
    assert max(fill.values()) <= 100 and dict(pieces) == {i: n for i, n in rows if n}
    assert Counter(r["doc_id"] for r in got)[900] == 3 and max(Counter(r["doc_id"] for r in got if r["doc_id"] != 900).values()) == 1
    assert set(fill) == set(range(len(fill)))
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long"), 100).count() == 0


def test_samples_are_bounded_and_repeatable(spark):
    from corploom.llm.sampling import sample

    df = spark.range(20_000).withColumnRenamed("id", "row_id")
    a, b = ({r["row_id"] for r in sample(df, 500, "row_id").collect()} for _ in range(2))
    assert a == b and 350 < len(a) < 650 and sample(df, 30_000, "row_id").count() == 20_000


def test_vocabulary_is_a_parameter(tmp_path):
    (tmp_path / "v").write_bytes(b"YQ== 0\nYg== 1\nYWI= 2\n")
    assert bpe.parse_ranks(bpe.read_ranks(str(tmp_path / "v"))) == {b"a": 0, b"b": 1, b"ab": 2}


def test_longest_matches_against_a_plain_search(spark, tmp_path):
    import base64

    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"abc", b"bcd", b"cdcd", b" the", b"the", b"xxxx", b"xx"]
    (tmp_path / "v").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    random.seed(3)
    texts = ["".join(random.choices("abcdx the", k=n)) for n in (0, 1, 5, 40, 900, 30_000)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id int, text string")
    got = {r["row_id"]: r["n_tokens"] for r in tokens_of(df, str(tmp_path / "v")).collect()}

    def plain(word: bytes) -> int:
        n = 0
        while word:
            word = word[max(k for k in range(1, 5) if word[:k] in set(tokens)) :]
            n += 1
        return n

    splitter = bpe.Splitter()
    for i, t in enumerate(texts):
        words = splitter.split([t])[0] if t else []
        assert got[i] == (None if t is None else sum(map(plain, words)))


def tokens_of(df, path):
    return tokens.count_tokens(df, path=path, longest=True)
