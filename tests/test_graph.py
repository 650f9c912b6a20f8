import random

import pytest

from terrane.operators import skew
from terrane.operators.graph import connected_components
from terrane.operators.skew import attach, hot_limit

EDGES = [(1, 8), (8, 9), (5, 8), (7, 8), (3, 7), (2, 3), (4, 6)]


def found(df):
    return {r[0]: r[1] for r in df.collect()}


def test_two_components(spark):
    out = connected_components(spark.createDataFrame(EDGES * 2, "a bigint, b bigint"))
    assert out.columns == ["node_id", "connected_component_id"]
    assert found(out) == dict.fromkeys([1, 2, 3, 5, 7, 8, 9], 1) | {4: 4, 6: 4}


def test_nulls_loops_strings_names(spark):
    df = spark.createDataFrame([("20", "20"), (None, "21"), ("22", None), (None, None), ("a", "b")], "x string, y string")
    out = connected_components(df, "n", "c")
    assert out.columns == ["n", "c"] and found(out) == {"20": "20", "21": "21", "22": "22", "a": "a", "b": "a"}


def test_wrong_types_and_empty(spark):
    with pytest.raises(AssertionError):
        connected_components(spark.createDataFrame([(1, "a")], "a int, b string"))
    with pytest.raises(AssertionError):
        connected_components(spark.createDataFrame([(1,)], "a int"))
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


@pytest.mark.parametrize("local", [0, 200_000])
def test_random_graph_with_a_hub_and_a_long_path(spark, local):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(150)] + [(1000, 1001 + i) for i in range(600)] + [(5000 + i, 5001 + i) for i in range(60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert found(connected_components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(7), local_edges=local)) == {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("most", [50, 10_000])
def test_attach_hot_and_cold_keys(spark, monkeypatch, most):
    monkeypatch.setattr(skew, "MOST_BYTES", most)  # 43 bytes a row: the hot key alone fits the smaller
    left = spark.createDataFrame([(1, i) for i in range(500)] + [(2, i) for i in range(5)] + [(None, 0), (9, 0)], "k int, v int")
    right = spark.createDataFrame([(1, "one", 500), (2, "two", 5)], "k int, name string, n int")
    out = attach(left, right, "k", "n").groupBy("k", "name").count().collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, [(1, "one", 500), (2, "two", 5), (None, None, 1), (9, None, 1)]))
    assert hot_limit(10) == 200 and hot_limit(10**9) == 500_000
