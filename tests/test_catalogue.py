import math
import os

import duckdb
import pytest

import __spark_entry__
from terrane import catalogue
from terrane.session import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="the supplied tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_against_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns, rows = sorted(df.columns), df.collect()
    if name not in catalogue.ORACLES:
        assert rows
        return
    found = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expected = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == expected


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 6
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_components_of_all_lines(spark, duck):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in duck.execute("SELECT l_partkey * 2, l_suppkey * 2 + 1 FROM lineitem").fetchall():
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    found = catalogue.QUERIES["graph_components"](spark, SF).collect()
    assert {r.node_id: r.connected_component_id for r in found} == {x: root(x) for x in list(parent)} and len(found) == len(parent)


def test_whole_tables_are_joined(spark, duck):
    orders, customers = (duck.execute(f"SELECT count(*) FROM {t}").fetchone()[0] for t in ("orders", "customer"))
    found = {k: catalogue.QUERIES[f"join_{k}"](spark, SF) for k in ("left", "right", "full")}
    assert found["left"].count() == orders and found["right"].select("c_name").distinct().count() == customers
    full = found["full"]
    assert (full.select("o_orderkey").distinct().na.drop().count(), full.select("c_name").distinct().na.drop().count()) == (orders, customers)
    assert full.filter("c_name IS NULL").count() and full.filter("o_orderkey IS NULL").count()
    assert catalogue.QUERIES["union_all"](spark, SF).count() == 2 * orders


def test_sketches_are_not_kept_for_each_distinct_value(spark):
    df = catalogue.QUERIES["agg_approx_distinct_near"](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "approx_count_distinct" in plan and "Expand" not in plan


def test_diffed_lines_are_gathered_once(spark, monkeypatch):
    plans, compare = [], catalogue.compare_dataframes

    def seen(left, right, keys):
        plans.extend(df._jdf.queryExecution().optimizedPlan().toString() for df in (left, right))
        return compare(left, right, keys)

    monkeypatch.setattr(catalogue, "compare_dataframes", seen)
    assert catalogue.QUERIES["diff_granular_lines"](spark, SF).count() == 2
    assert len(plans) == 2 and not any("Aggregate" in p or "Join" in p for p in plans)
