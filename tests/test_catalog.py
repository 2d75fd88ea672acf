"""Every query with SQL gives DuckDB's rows."""

import os

import duckdb
import pytest

import __spark_entry__
from sluice import catalog
from tests.conftest import TABLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(TABLES):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{TABLES}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, TABLES)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*cols).collect())
    if name not in catalog.SQL:
        assert got
        return
    assert sorted(duck.sql(catalog.SQL[name]).columns) == cols
    listed = ", ".join(f'"{c}"' for c in cols)
    assert got == sorted(map(repr, duck.sql(f"SELECT {listed} FROM ({catalog.SQL[name]})").fetchall()))


def test_float_division_rounds_as_its_sql_does(spark, tmp_path):
    values = [24.5662825, 9.2976335, 250.00000000001017, 249.9999999492797, 250.0, -7.5, -1e-7, -0.0, 0.0, 185.22, 1e300, float("inf"), float("-inf"), float("nan"), None]
    rows = [(i, i % 2, v) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("expr_float_div", "expr_ternary"):
        df = catalog.QUERIES[name](spark, str(tmp_path))
        listed = ", ".join(df.columns)
        assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(map(repr, con.sql(f"SELECT {listed} FROM ({catalog.SQL[name]})").fetchall()))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.SQL) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_image_features_takes_all_events(spark, duck):
    got = catalog.image_features(spark, TABLES).select("event_id").collect()
    assert sorted(r["event_id"] for r in got) == [i for (i,) in duck.sql("SELECT event_id FROM events ORDER BY event_id").fetchall()]


def test_the_engine_does_without_modules_that_only_the_training_data_queries_need(monkeypatch):
    import builtins

    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name == "public_tokenizers" or name.startswith("sluice.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name="public_tokenizers")
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", without)
    with pytest.warns(UserWarning, match="public_tokenizers"):
        assert set(__spark_entry__.queries()) == set(catalog.QUERIES)
