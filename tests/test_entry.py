"""Every query against its SQL on the smallest tables; queries without SQL run and keep their schema."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from corploom.plans import drift, files, reference, selection

QUERIES, SQL = reference.QUERIES | selection.QUERIES | files.QUERIES, reference.SQL | selection.SQL | files.SQL


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    rows = lambda d: sorted(map(repr, d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).itertuples(index=False, name=None)))
    assert rows(a) == rows(b)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, duck, small, name):
    same(QUERIES[name](spark, small).toPandas(), duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark, small):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(drift.queries()) <= set(entry.queries())


def test_no_query_is_registered_twice():
    assert len(entry.queries()) == len(reference.QUERIES) + len(selection.QUERIES) + len(files.QUERIES) + len(drift.queries()) + len(entry._text().queries() if entry._text() else {})


def test_a_broken_subpackage_is_loud(monkeypatch):
    """Only a subpackage that is not there is passed over; one that cannot be imported is an error."""
    monkeypatch.setattr(entry.importlib.util, "find_spec", lambda name: None)
    assert set(entry.queries()) == set(QUERIES) | set(drift.queries())
    monkeypatch.undo()

    def broken(name):
        raise ImportError(name)

    monkeypatch.setattr(entry.importlib.util, "find_spec", lambda name: object())
    monkeypatch.setattr(entry.importlib, "import_module", broken)
    with pytest.raises(ImportError):
        entry.queries()


def test_core_does_not_need_the_subpackage():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "corploom"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert "llm" not in f.read_text(), f
