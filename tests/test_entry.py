"""The driver's contract, and every query that SQL expresses against another engine."""

import ast
import glob
import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from mensura.operators import ml
from mensura.plans import oracles, problems, reference


def test_entry(spark, small):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(oracles.ORACLES) <= {*problems.QUERIES, *reference.QUERIES}


def test_core_is_free_of_llm():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for path in glob.glob(f"{root}/mensura/**/*.py", recursive=True):
        if "/llm/" not in path:
            for node in ast.walk(ast.parse(open(path).read())):
                names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
                assert not any(n.startswith("mensura.llm") for n in names), path


def plain(df: pd.DataFrame) -> list:
    value = lambda v: "null" if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)) else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, small, duck, name):
    got, want = {**problems.QUERIES, **reference.QUERIES}[name](spark, small).toPandas(), duck.execute(oracles.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(want)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted({*problems.QUERIES, *reference.QUERIES} - set(oracles.ORACLES)))
def test_query_without_sql_runs(spark, small, name, monkeypatch):
    # trees of full size take minutes here; the plans are the same with few
    small_forest, small_boosted = ml.forest, ml.boosted
    monkeypatch.setattr(ml, "forest", lambda *a, **kw: small_forest(*a, trees=3, depth=3))
    monkeypatch.setattr(ml, "boosted", lambda *a, **kw: small_boosted(*a, rounds=2))
    assert {**problems.QUERIES, **reference.QUERIES}[name](spark, small).count() > 0
