"""Every registered query of the core against its DuckDB SQL on the smallest tables."""

import math
import os

import pytest

import quillfind.plans  # noqa: F401  registers the queries
from quillfind.plans.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "events documents embeddings conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DIR):
        pytest.skip("no tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def shown(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    return f"{v:.6f}" if isinstance(v, float) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(shown(r[k]) for k in order) for r in data)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    got = duck.execute(ORACLES[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in got.description], got.fetchall())


def test_plans_push_filters_and_prune(spark):
    plan = QUERIES["notes_by_path"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in plan


def test_knn_limits_before_the_exchange(spark):
    plan = QUERIES["vec_knn_multi"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "BroadcastNestedLoopJoin" in plan
