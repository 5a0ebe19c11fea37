"""Every query with SQL gives DuckDB's rows; the others run."""

import math

import duckdb
import pytest

import __spark_entry__
from tests.conftest import SMALL

QUERIES = {k: q for k, q in __spark_entry__.queries().items() if not k.startswith("op") and k != "pipeline"}
SQL = __spark_entry__.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return connection


@pytest.mark.parametrize("name", [k for k in QUERIES if k in SQL])
def test_same_rows_as_sql(spark, duck, name):
    ours = QUERIES[name](spark, SMALL)
    columns = sorted(ours.columns)
    theirs = duck.sql(SQL[name])
    assert columns == sorted(theirs.columns)
    a = sorted(tuple(map(plain, r)) for r in ours.select(*columns).collect())
    b = sorted(tuple(map(plain, r)) for r in theirs.project(", ".join(columns)).fetchall())
    assert a == b


@pytest.mark.parametrize("name", [k for k in QUERIES if k not in SQL])
def test_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_nothing_but_the_entry_knows_of_the_subpackage():
    from pathlib import Path

    root = Path(__spark_entry__.__file__).resolve().parent
    for path in (root / "docgrid").rglob("*.py"):
        if "llm" not in path.parts:
            assert "docgrid.llm" not in path.read_text()
