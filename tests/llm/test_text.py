"""Lines, languages, page bodies, personal items and subjects on small fixtures."""

import random
import re
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from corploom.llm import boosting, language, lines, mainbody, personal, subjects

ROWS = "row_id long, source string, source_name string, content_sha256 string, text string, language string"


def rows(spark, items):
    import hashlib

    return spark.createDataFrame([(i, s, n, hashlib.sha256(t.encode()).hexdigest() if t is not None else None, t, x) for i, (s, n, t, x) in enumerate(items)], ROWS)


def brute_lines(items, support):
    docs, held = defaultdict(set), []
    for i, (source, _, text, _) in enumerate(items):
        for no, line in enumerate((text or "").split("\n")) if text is not None and source is not None else ():
            k = "".join(c for c in line if c.isalpha()).lower()
            if k:
                docs[source, k].add(text)
                held.append((i, no, source, k))
    return {(i, no) for i, no, s, k in held if len(docs[s, k]) >= support}


def test_repeated_lines_against_brute_force(spark):
    random.seed(1)
    pool = ["Share this!", "share THIS 3", "— © 2010", "Only here", "", "…", "Fußzeile", "x"]
    items = [(random.choice(["a", "b", None]), None, random.choice([None, ""] + ["\n".join(random.choices(pool, k=4)) + f"\nown {'abcdefghij'[i % 10] * (i % 7)}\r" for _ in range(8)]), None) for i in range(120)]
    df = rows(spark, items)
    for support in (2, 6):
        assert {(r["row_id"], r["line_no"]) for r in lines.repeated_lines(df, support).collect()} == brute_lines(items, support)
        # the same by levels, some of the way and all of it
        for local in (0, 40):
            got = lines.spans(lines.sequences(df), support, local=local).collect()
            assert {(r["row_id"], no) for r in got for no in r["lines"]} == brute_lines(items, support)
    clean = lines.clean(df, 6).orderBy("row_id").collect()
    gone = brute_lines(items, 6)
    for r, (_, _, t, _) in zip(clean, items):
        assert r["text"] == (None if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if (r["row_id"], no) not in gone))
        assert r["boilerplate_content"] == any(i == r["row_id"] for i, _ in gone)
    assert lines.repeated_lines(df.limit(0)).count() == 0


def test_sequences_against_brute_force(spark):
    random.seed(2)
    items = [("s", None, "\n".join(random.choices("abcd", k=6)) + f"\nz{'q' * i}", None) for i in range(40)]
    got, levels = defaultdict(int), defaultdict(int)
    for r in lines.prefix_span(lines.sequences(rows(spark, items)), 5).where("length <= 3").collect():
        got[r["length"]] += 1
    for r in lines.prefix_span(lines.sequences(rows(spark, items)), 5, local=0).where("length <= 3").collect():
        levels[r["length"]] += 1
    assert got == levels
    counts = defaultdict(set)
    for t in {t for _, _, t, _ in items}:
        seq = t.split("\n")[:6]
        for n in (1, 2, 3):
            for i in range(len(seq) - n + 1):
                counts[tuple(seq[i : i + n])].add(t)
    want = defaultdict(int)
    for p, d in counts.items():
        if len(d) >= 5:
            want[len(p)] += 1
    assert got == want


def test_sequences_of_any_length(spark):
    block = [f"menu {'abcdefghijk'[i] * 3}" for i in range(11)]
    items = [("s", None, "\n".join([f"own {'q' * i}", *block, f"end {'z' * i}"]), None) for i in range(1, 8)]
    got = defaultdict(int)
    for r in lines.prefix_span(lines.sequences(rows(spark, items)), 6).collect():
        assert r["docs"] == 7
        got[r["length"]] += 1
    assert got == {n: 12 - n for n in range(1, 12)}
    # the whole block is deleted as one sequence in every document
    whole = lines.spans(lines.sequences(rows(spark, items)), 6).collect()
    assert {(r["row_id"], r["first"], r["length"]) for r in whole} == {(i, 1, 11) for i in range(7)}
    assert all(r["lines"] == list(range(1, 12)) for r in whole)


def test_spans_are_the_longest_sequences(spark):
    """x y z stands in six texts, y z alone in two more: there the shorter sequence is deleted; a row delivered again is cleaned but does not count."""
    texts = [f"xx\nyy\n{i}\nzz\nown {'q' * i}" for i in range(6)] + [f"own {'r' * i}\nyy\nzz" for i in (1, 2)] + ["aa"] * 9
    docs = lines.sequences(rows(spark, [("s", None, t, None) for t in texts] + [(None, None, "xx", None), ("s", None, None, None)]))
    found, hot = lines.spans(docs, 6).collect(), lines.spans(docs, 6, heavy=7, local=0).collect()
    assert {(r["row_id"], tuple(r["lines"])) for r in hot} == {(r["row_id"], tuple(r["lines"])) for r in found} == {(i, (0, 1, 3)) for i in range(6)} | {(i, (1, 2)) for i in (6, 7)}


SENTENCES = {
    "en": "The old mill near the river was moved before anyone had asked what it would cost the town. There are many reasons to look at the bridge again.",
    "fr": "Le vieux moulin près de la rivière a été déplacé avant que quelqu'un ne demande ce que cela coûterait. Il y a beaucoup de raisons de revoir le pont.",
    "de": "Die alte Mühle am Fluss wurde versetzt, bevor jemand gefragt hatte, was das die Stadt kosten würde. Es gibt viele Gründe, die Brücke noch einmal zu prüfen.",
    "es": "El viejo molino cerca del río fue trasladado antes de que alguien preguntara cuánto costaría. Hay muchas razones para volver a mirar el puente.",
    "pt": "O velho moinho perto do rio foi mudado antes de alguém perguntar quanto custaria à cidade. Há muitas razões para voltar a olhar para a ponte.",
    "nl": "De oude molen bij de rivier werd verplaatst voordat iemand had gevraagd wat het de stad zou kosten. Er zijn veel redenen om de brug nog eens te bekijken.",
}


def test_languages(spark):
    random.seed(3)
    extra = {k: [" ".join(random.sample(v.split(), len(v.split()))).lower() for _ in range(12)] for k, v in SENTENCES.items()}
    items = [("s", None, "\n".join([v, *extra[k][:6]]), [k, k.upper(), f"{k}-XX"][i % 3]) for i in range(8) for k, v in SENTENCES.items()]
    n = len(items)
    items += [("s", None, SENTENCES["en"] + "\n" + extra["en"][7] + "\n" + SENTENCES["de"], "eng"), ("s", None, extra["fr"][8] + "\n" + SENTENCES["fr"], "und"), ("s", None, extra["nl"][9] + "\n" + SENTENCES["nl"], "it"), ("s", None, None, None), ("s", None, "", None), ("s", None, "12 34", None), ("s", None, SENTENCES["pt"], None)]
    df = rows(spark, items)
    got = {(r["row_id"], r["line_no"], r["language"]) for r in language.wrong_labels(df).collect()}
    assert got == {(n, 2, "de"), (n + 1, -1, "fr"), (n + 2, -1, "nl"), (n + 6, -1, "pt")}
    every = language.identify(df, language.train(df)).collect()
    assert {r["row_id"] for r in every if r["line_no"] == -1} == set(range(len(items))) and all(0 <= r["confidence"] <= 1000 for r in every)
    assert language.wrong_labels(df.limit(0)).count() == 0


@pytest.mark.parametrize("text, code", [("eng", "en"), (" EN-gb ", "en"), ("Deutsch", "de"), ("por", "pt"), ("", None), (None, None), ("xx", "xx")])
def test_labels(text, code):
    assert language.label(text) == code


def test_page_bodies(spark):
    random.seed(4)
    items, truth = [], set()
    for i in range(120):
        host = i % 3
        body = [f"Title {chr(97 + i % 26) * 3} {chr(97 + i // 26) * 4} of the day", "By Ann Author", "Last updated: 2020-01-02", f"Sentence about {'qwertzuiop'[i % 10] * (i // 10 + 2)} that nobody wrote twice."]
        top, bottom = ["Home | News | Shop", f"You are here: Home > News > {body[0]}"], [f"Read more about {chr(97 + i % 26)} things", "Related stories", f"Other {chr(97 + i % 26)} {chr(98 + i // 26)} headline (12)", f"© 2020 Site {host}. All rights reserved.", "", f"We of Site {host} use cookies here."]
        text = top + body + bottom
        truth |= {(i, no) for no, x in enumerate(text) if x and not len(top) <= no < len(top) + len(body)}
        items.append((f"web/h{host}", f"Site {host}", "\n".join(text), None))
    items += [("mail/x", None, items[0][2], None), ("web/h0", None, None, None), ("web/h0", None, "", None), (None, None, "x", None)]
    df = rows(spark, items)
    assert {(r["row_id"], r["line_no"]) for r in mainbody.furniture_lines(df).collect()} == truth
    joined = mainbody.furniture(df, broadcast=0).selectExpr("row_id", "explode(lines) AS line_no").collect()
    assert {(r["row_id"], r["line_no"]) for r in joined} == truth  # the learnt nodes joined instead of broadcast
    clean = {r["row_id"]: r for r in mainbody.clean(df).collect()}
    assert len(clean) == len(items) and clean[0]["text"].startswith("Title") and clean[120]["text"] == items[0][2] and not clean[121]["main_content"] and clean[121]["text"] is None
    assert mainbody.furniture_lines(df.limit(0)).count() == 0


def test_headings_and_bylines_are_learnt(spark):
    """In no known language: a line that is followed by other pages' titles heads a list, one that stands below titles is of the head."""
    random.seed(9)
    word = lambda: "".join(random.choices("bdfgklmn", k=6))
    items, truth = [], set()
    for i in range(90):
        text = [f"{word()} {word()} {word()}", f"qq {'rst'[i % 3]} xyz", *(f"{word()} {word()} {word()}." for _ in range(3)), "vv ww", f"{word()} {word()} {word()}", f"{word()} {word()}", f"{word()} {word()}, {word()}."]
        truth |= {(i, 5), (i, 6), (i, 7)}
        items.append((f"web/h{i % 4}", None, "\n".join(text), None))
    assert {(r["row_id"], r["line_no"]) for r in mainbody.furniture_lines(rows(spark, items)).collect()} == truth


def test_long_lines_of_pages(spark):
    random.seed(6)
    word = lambda: "".join(random.choices("abcdefghij", k=7))
    notice, links = " ".join(word() for _ in range(200)) + ".", [f"{word()} {word()}" for _ in range(100)]
    items = []
    for i in range(40):
        menu = random.sample(links, 100)  # in another order on every page: only the parts recur
        own = " ".join(word() for _ in range(200)) + "."
        items.append(("web/h", None, "\n".join([" | ".join(menu), f"Title {word()}", own, notice]), None))
    assert len(notice) >= 1000 and all(len(t.split("\n")[0]) >= 1000 for _, _, t, _ in items)
    df = rows(spark, items)
    assert {(r["row_id"], r["line_no"]) for r in mainbody.furniture_lines(df).collect()} == {(i, no) for i in range(40) for no in (0, 3)}
    assert all(len(r["text"].split("\n")) == 2 for r in mainbody.clean(df).collect())


def test_boosted_trees():
    rng = np.random.default_rng(5)
    x = rng.random((3000, 6))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    m = boosting.fit(x[:2000], y[:2000])
    p = boosting.predict(m, x[2000:])
    assert ((p >= m.cut) == (y[2000:] > 0)).mean() > 0.97 and boosting.predict(m, x[:0]).shape == (0,)


@pytest.fixture(scope="module")
def held_out():
    f = Path("/root/testdata/sf0.01/text_rows.parquet")
    if not f.exists():
        pytest.skip("the test tables are not here")
    import pandas as pd

    return pd.read_parquet(f).text.tolist()


def test_personal_items_where_nothing_announces_them(held_out):
    model = personal.train(held_out[:900])
    texts = ["On the last page somebody had written 666-61-8417 and, below it, Flat 39, 99 Harbour Street, X.", "Docket 7913-45/96 replaced an older file.", "reach me on +44 7700 900252, or k.miller [at] web [dot] test", "Message-ID: <bp7hrp5x3vms8cqmvm@post.mirvic.test>", "<PHONE_NUMBER> <EMAIL_ADDRESS>", ""]
    got = [[(k, t[a:b]) for k, a, b, _ in r] for t, r in zip(texts, personal.find(model, texts))]
    assert got[0] == [("id_number", "666-61-8417"), ("address", "Flat 39, 99 Harbour Street")]
    assert got[1] == [] and got[3] == [] and got[4] == [] and got[5] == []
    assert got[2] == [("phone", "+44 7700 900252"), ("email", "k.miller [at] web [dot] test")]
    heads = [(t, m.start(1), m.group(1)) for t in held_out[900:] for m in re.finditer(r"(?m)^From: ([^<\n]+?) <", t)]
    found = personal.find(model, [t for t, _, _ in heads])
    assert sum(any(k == "name" and a == at for k, a, _, _ in r) for r, (_, at, _) in zip(found, heads)) >= 0.9 * len(heads)


def test_names_after_nothing_but_blanks(held_out):
    blanks = ["\n", "\r\n ", "\u2028", "x." + "\n" * 30, "\n\t \n", ""]
    model = personal.train(held_out[:900] + [f"{b}Quilric Pellinowara" for b in blanks])
    found = personal.find(model, [f"{b}By Quilric Pellinowara\nFrom: Quilric Pellinowara <ada@x.test>" for b in blanks] + [f"{b}Quilric Pellinowara <ada@x.test> wrote:" for b in blanks])
    assert [[x[:2] for x in r if x[0] == "name"][-1:] for r in found] == [[("name", len(b) + 29)] for b in blanks] + [[("name", len(b))] for b in blanks]


def test_redaction_keeps_the_rest(spark, held_out):
    model = personal.train(held_out[:400])
    df = spark.createDataFrame([(1, "mail ann@x.test now"), (2, None), (3, ""), (4, "nothing")], "row_id long, text string")
    got = {r["row_id"]: r for r in personal.redact(df, model).collect()}
    assert got[1]["text"] == "mail <EMAIL_ADDRESS> now" and got[1]["email_addresses"] and got[2]["text"] is None and got[3]["text"] == "" and got[4]["text"] == "nothing"
    assert personal.items(df.limit(0), model).count() == 0


def test_subjects(spark):
    random.seed(6)
    words = {"law": ["verdict", "affidavit", "appeal"], "music": ["encore", "clarinet", "choir"]}
    say = lambda s: f"The group described the {random.choice(words[s])} and the {random.choice(words[s])} in detail. Few people remember it."
    docs = [(i, "\n".join(say(["law", "music"][i % 2]) for _ in range(4)), "src", "c") for i in range(60)]
    docs += [(100, say("law") + "\n" + say("music"), "src", "c"), (101, None, "src", "c"), (102, "  ", "src", "c"), (103, "12345", "src", "c"), (104, "\n".join([say("law")] * 7 + [say("music")]), "src", "c")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, corpus string")
    labels = spark.createDataFrame([(i, ["Law", "muzic"][i % 2]) for i in range(0, 50)] + [(1, "nonsense"), (2, None)], "doc_id long, subject string")
    s = spark.createDataFrame([("law", "Law", "courts and rulings"), ("music", "Music", "choirs and concerts")], "subject string, title string, description string")
    got = defaultdict(set)
    for r in subjects.assign(d, labels, s).collect():
        got[r["doc_id"]].add(r["subject"])
    assert all(got[i] == {["law", "music"][i % 2]} for i in range(60))
    assert got[100] == {"law", "music"} and got[104] == {"law"} and len(got[103]) == 1 and 101 not in got and 102 not in got
    assert subjects.makeup(d, subjects.assign(d, labels, s)).count() == 2


@pytest.mark.parametrize("label, subject", [("LAW", "law"), (" Musik", "music"), ("zzz", None), (None, None), ("music.", "music")])
def test_subject_spellings(label, subject):
    assert subjects.subject_name(label, ["law", "music"], ["Law", "Music"]) == subject


def test_latent_model_weighs_functions_by_their_accuracy():
    """A function that names areas at random must not outvote one that is right; the model is told neither which is which nor the truth."""
    rng = np.random.default_rng(12)
    areas, n = 3, 40_000
    truth = rng.integers(0, areas + 1, n)
    votes = []
    for right in (0.9, 0.85, 0.7, 0.0, 0.6, 0.5):
        wrong = rng.integers(1, areas + 1, n)
        vote = np.where(rng.random(n) < right, truth, wrong)
        votes.append(np.where((truth == 0) & (rng.random(n) < 0.9), 0, vote))
    pattern = np.zeros(n, np.int64)
    for v in votes:
        pattern = pattern * (areas + 1) + v
    keys, back, counts = np.unique(pattern, return_inverse=True, return_counts=True)
    q, tables = subjects.learn(keys, counts, areas)
    got = q.argmax(axis=1)[back]
    assert (got == truth).mean() > max((v == truth).mean() for v in votes) and (got == truth).mean() > 0.93
    assert np.diag(tables[0])[1:].min() > 0.85 and np.diag(tables[3])[1:].max() < 0.45
    assert subjects.learn(keys[:0], counts[:0], areas)[0].shape == (0, areas + 1)


def test_subjects_of_odd_tables(spark):
    """No documents, no labels, null and blank texts, repeated ids and a clashing extra column: defined results, no failure."""
    s = spark.createDataFrame([("law", "Law", "courts and rulings"), ("music", "Music", "choirs and concerts")], "subject string, title string, description string")
    schema = "doc_id long, text string, source string, corpus string, subject string, said int"
    d = spark.createDataFrame([(1, None, None, None, "x", 1), (2, " \n ", "s", "c", "x", 1), (3, "courts. " * 3000, None, "c", None, None), (3, "choirs", "s", "c", None, None)], schema)
    none = spark.createDataFrame([], "doc_id long, subject string")
    assert {(r["doc_id"], r["subject"]) for r in subjects.assign(d, none, s).collect()} == {(3, "law"), (3, "music")} or subjects.assign(d, none, s).count() == 2
    assert subjects.assign(d.limit(0), none, s).count() == 0


def test_names_in_small_letters_and_telephones_after_addresses(held_out):
    model = personal.train(held_out[:1500])
    given = max((g for g in model.letters.small_givens if g.isalpha()), key=lambda g: model.letters.givens[g])
    family = max((f for f in model.letters.families if f.isalpha() and f not in model.letters.small), key=lambda f: model.letters.families[f])
    texts = [f"From: {given} {family} <x@y.test>", f"written by {given} k. {family}, later", f"see {given}.{family}@y.test", f"{given} and others", f"From: {given.upper()} {family.upper()} <x@y.test>"]
    got = [[(k, t[a:b]) for k, a, b, _ in r if k == "name"] for t, r in zip(texts, personal.find(model, texts))]
    assert got[0] == [("name", f"{given} {family}")] and got[1] == [("name", f"{given} k. {family}")] and got[2] == got[3] == [] and got[4] == [("name", f"{given} {family}".upper())]
    calls = ["write to a.b@c.test or 030/23125953.", "12 Harbour Lane, 00999 4100 5408", "call 07700 900 362 now", "Docket 495.3710 replaced 7913-45/96"]
    got = [[(k, t[a:b]) for k, a, b, _ in r] for t, r in zip(calls, personal.find(model, calls))]
    assert ("phone", "030/23125953") in got[0] and got[1] == [("address", "12 Harbour Lane"), ("phone", "00999 4100 5408")] and got[2] == [("phone", "07700 900 362")] and got[3] == []


def test_address_trees_know_decoys(held_out):
    """A street without a number, a year before a street that is a place, and a house named after a street are no addresses."""
    model = personal.train(held_out[:1500])
    assert model.trees["address"] is not None
    texts = ["Ann lives at 12 Harbour Lane, 00945 Port.", "Originals go to Flat 3, 77b Mill Road.", "As early as in 1934 Harbour Lane was closed.", "They met in Harbour Lane before noon.", "Calle Mayor 135, 2.º B", "wohnhaft Hafenstraße 97."]
    got = [[(k, t[a:b]) for k, a, b, _ in r if k == "address"] for t, r in zip(texts, personal.find(model, texts))]
    assert got == [[("address", "12 Harbour Lane, 00945 Port")], [("address", "Flat 3, 77b Mill Road")], [], [], [("address", "Calle Mayor 135, 2.º B")], [("address", "Hafenstraße 97")]]


def test_a_language_that_is_none_of_them(spark):
    models = language.fit([t for t in SENTENCES.values()] * 30, list(SENTENCES) * 30)
    others = ["Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava veljeyden hengessä.", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować."]
    df = rows(spark, [("s", None, t, "en") for t in [*SENTENCES.values(), *others]])
    got = {r["row_id"]: r for r in language.identify(df, models).where("line_no = -1").collect()}
    assert [got[i]["language"] for i in range(8)] == [*SENTENCES, None, None] and got[7]["confidence"] == 0
    assert {r["row_id"] for r in language.identify(df, models, every=False).collect()} == {1, 2, 3, 4, 5}


def test_queries_agree_with_their_sql(spark, small):
    import duckdb

    from corploom.llm import queries

    c = duckdb.connect()
    c.execute(f"create view text_rows as select * from '{small}/text_rows.parquet'")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, small).toPandas(), c.execute(sql).df()
        key = lambda d: sorted(map(repr, d[sorted(d.columns)].astype(object).itertuples(index=False, name=None)))
        assert sorted(got.columns) == sorted(want.columns) and key(got) == key(want)


def test_personal_model_is_of_all_rows(spark):
    """Counts, trees and thresholds come from every row, whether the sums are taken on the driver or in tasks; a long text counts too."""
    names = [("Ada", "Velt"), ("Bram", "Ostor"), ("Cleo", "Marwick"), ("Dunja", "Pell")]
    texts = []
    for i in range(9000):
        first, last = names[i % 4]
        texts.append(f"From: {first} {last} <{first.lower()}@x.test>\ncall 07700 900{i % 900 + 100:03d}, passport {i % 9}66-61-8417" if i % 2 == 0 else f"They met in Grand Harbour near docket 7913-45/{i % 90 + 10}, at {i % 80 + 1} Mill Road")
    texts.append("From: Zeno Quill <z@x.test>\n" + "word " * 20_000)
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string").repartition(3)
    read = personal.blocks(df)
    models = [personal.learn(read), personal.learn(read, together=0), personal.train(texts)]
    assert models[0].letters.givens["ada"] == models[0].letters.givens["cleo"] == 2250 and models[0].letters.families["quill"] == 1
    for m in models[1:]:
        assert m.letters == models[0].letters
        assert all(np.array_equal(a, b) for k in personal.KINDS for a, b in zip(m.trees[k] or (), models[0].trees[k] or ()))
    assert models[0].trees["name"] is not None and {r["kind"] for r in personal.found(df).where("row_id < 2").collect()} >= {"email", "phone", "name"}
    assert personal.found(df.limit(0)).count() == 0 and personal.found(spark.createDataFrame([(1, None), (None, "x")], "row_id long, text string")).count() == 0


def test_thresholds_of_rows_that_are_told_apart_without_error():
    x = np.repeat(np.arange(2.0), 100_000)[:, None]
    m = boosting.fit(x, x[:, 0])
    assert np.isfinite([m.slope, m.shift]).all() and ((boosting.predict(m, x) >= m.cut) == (x[:, 0] > 0)).all()
    assert boosting.fit(x, np.ones(len(x))) is None


def test_rows_in_the_same_bins_are_added_up(monkeypatch, held_out):
    seen, made = [], personal._model
    monkeypatch.setattr(personal, "_model", lambda letters, edges, total, *keep: seen.append(total(lambda kind, rows: np.array([len(rows.binned), len(np.unique(rows.binned, axis=0))]))) or made(letters, edges, total, *keep))
    personal.train(held_out[:300])
    assert seen[0]["name"][0] > 100 and all(a == b for a, b in seen[0].values())


def test_margins_are_kept_between_trees(monkeypatch):
    """Rows that lie elsewhere are never taken through more than some of the last trees, and the trees are those of rows that lie here."""
    x = np.random.default_rng(2).integers(0, 20, (4000, 3)).astype(float)
    w = np.stack([np.ones(4000), (x[:, 0] * x[:, 1] > 70) * 1.0, np.ones(4000), (x[:, 0] * x[:, 1] > 70) * 1.0], axis=1)
    edges = [boosting.edges_of(x[:, j], np.ones(4000)) for j in range(3)]
    kept = (boosting.bins_of(x, edges), w)
    here, most, margins = boosting.Rows(*kept), [], boosting._margins
    monkeypatch.setattr(boosting, "_margins", lambda rows, g, trees: most.append(trees - rows.trees) or margins(rows, g, trees))

    def keep(f):
        nonlocal kept
        rows = boosting.Rows(*kept)
        kept = (*kept[:2], f("", rows).copy(), rows.trees)

    fresh = lambda: boosting.Rows(*kept[:2], *((kept[2].copy(), kept[3]) if len(kept) > 2 else ()))
    far = boosting.grow({"": edges}, lambda f: boosting.summed([{"": fresh()}], f), keep=keep)[""]
    assert max(most) <= boosting.KEEP
    assert all(np.array_equal(a, b) for a, b in zip(far, boosting.grow({"": edges}, lambda f: boosting.summed([{"": here}], f))[""]))
