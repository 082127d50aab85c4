"""Every registered plan against its check query on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from cloakframe.plans import CHECKS as PLAN_CHECKS
from cloakframe.plans import load_all

SF = "/root/testdata/sf0.001"
TABLES = "customer orders events documents pages conversations"
PLANS = load_all()
CHECKS = dict(PLAN_CHECKS)


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    return connection


def normal(value):
    if isinstance(value, float):
        return float(f"{value:.12g}")
    return value.isoformat() if hasattr(value, "isoformat") else value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(PLANS))
def test_plan(spark, con, name):
    df = PLANS[name](spark, SF)
    rows = table(df.columns, df.collect())
    if name not in CHECKS:
        assert rows
        return
    cursor = con.execute(CHECKS[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows == table(columns, cursor.fetchall())


def test_streamed_and_batch_conversations_agree(spark):
    batch = sorted(map(tuple, PLANS["chat_redact_fold"](spark, SF).collect()))
    assert sorted(tuple(r)[:5] for r in PLANS["stream_redact_chat"](spark, SF).collect()) == batch


def test_entry(spark):
    assert entry.entry(spark).count() > 0
