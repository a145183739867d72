"""Every registered query of the library against DuckDB on the smallest scale factor."""

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

from sedimenta.plans import load_all
from sedimenta.plans.registry import ORACLES, QUERIES, RULE_ORACLES, RULES

load_all()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    return (None if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


def rows(columns, values):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(repr([plain(r[i]) for i in at]) for r in values)


def test_every_query_has_a_twin():
    # sequential choices and a number format, tested against brute force and Python in other files
    assert set(QUERIES) - set(ORACLES) == {"q_reference_selection"}
    assert set(RULES) - set(RULE_ORACLES) == {"q_rule_quota", "q_rule_numbers"} and not set(RULES) & set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES | RULE_ORACLES))
def test_query_is_its_sql(spark, duck, name):
    df = (QUERIES | RULES)[name](spark, SF)
    twin = duck.execute((ORACLES | RULE_ORACLES)[name])
    columns = [c[0] for c in twin.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, twin.fetchall())


def test_scopes_may_have_no_name_and_lines_no_flag_or_supplier(spark, tmp_path):
    c = duckdb.connect()
    cut = {"customer": "c_mktsegment = nullif(c_mktsegment, 'BUILDING')", "lineitem": "l_returnflag = if(l_orderkey % 7 = 0, NULL, l_returnflag), l_suppkey = nullif(l_suppkey, 3)"}
    for name in ("nation", "region", "orders", "customer", "lineitem"):
        c.execute(f"CREATE TABLE {name} AS SELECT * FROM '{SF}/{name}.parquet'")
        if name in cut:
            c.execute(f"UPDATE {name} SET {cut[name]}")
        c.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    df, twin = QUERIES["q_scope_rollup"](spark, str(tmp_path)), c.execute(ORACLES["q_scope_rollup"])
    got = df.collect()
    assert rows(df.columns, got) == rows([x[0] for x in twin.description], twin.fetchall())
    assert any(r.scope_id is None for r in got) and "collect_set" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())
