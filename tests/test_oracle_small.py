"""Registered queries against their DuckDB twins on the smallest driver tables, plus the entry smoke."""

from __future__ import annotations

import importlib

import duckdb
import pytest

from conftest import SMALL_SF

E = importlib.import_module("__spark_entry__")
from scripts.check_oracle import TABLES, canon  # noqa: E402

#: fits of the source's full size (the driver runs them too): left to it and to scripts/check_oracle.py
LONG = {"gbt_price_model", "forest_price_model", "train_price_model", "error_report", "score_requests", "score_requests_stream",
        "select_k_search", "model_segment_table"}
OPTIONAL = ("op", "pipeline")  # the corpus queries have tests of their own
NAMES = sorted(n for n in E.oracle_sql() if n not in LONG and not n.startswith(OPTIONAL))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL_SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(LONG))
def test_long_twin_runs_as_a_view(duck, name):
    duck.execute(f"CREATE OR REPLACE VIEW twin AS {E.oracle_sql()[name]}")
    assert duck.execute("SELECT count(*) FROM twin").fetchall()[0][0] > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SMALL_SF).toPandas()
    duck.execute(f"CREATE OR REPLACE VIEW twin AS {E.oracle_sql()[name]}")  # as a view, the way the driver asks for it
    ddf = duck.execute("SELECT * FROM twin").df()
    assert canon(sdf) == canon(ddf)


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "price_year_avg" in df.columns


def test_registry_needs_no_jvm():
    """The driver may call oracle_sql() before any Spark session exists."""
    import subprocess
    import sys

    code = "import __spark_entry__ as E; assert len(E.oracle_sql()) > 50 and len(E.queries()) > 80"
    root = __import__("os").path.dirname(__import__("os").path.dirname(__import__("os").path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
