"""The registered queries against SQL, where there is some."""

import os

import duckdb
import pytest

from terrane.llm import catalogue
from terrane.session import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="the supplied tables are not here")


@pytest.mark.parametrize("name", catalogue.ORACLES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    found = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(str([r[c] for c in names]) for r in df.collect()) == sorted(str(list(r)) for r in found.fetchall())


def test_one_query_for_each_operator():
    assert [sum(q.startswith(f"op{n}_") for q in catalogue.QUERIES) for n in range(1, 11)] == [1] * 10
