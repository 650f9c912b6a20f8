import pytest
from pyspark.sql import functions as F

from tests.test_nested import rows
from terrane.errors import AnalysisException, UnsupportedOperationException
from terrane.operators import frame
from terrane.operators import transformations as tr
from terrane.operators.grouped import group_by, value_name

PIVOTED = [
    (2018, "Orange", None, 4000, None), (2018, "Beans", None, 1500, 2000), (2018, "Banana", 2000, 400, None), (2018, "Carrots", 2000, 1200, None),
    (2019, "Orange", 5000, None, 5000), (2019, "Beans", None, 1500, 2000), (2019, "Banana", None, 1400, 400), (2019, "Carrots", None, 200, None),
]
COURSES = [("dotNET", 2012, 10000), ("Java", 2012, 20000), ("dotNET", 2012, 5000), ("dotNET", 2013, 48000), ("Java", 2013, 30000)]


def _pivoted(spark):
    return spark.createDataFrame(PIVOTED, "year bigint, product string, Canada bigint, China bigint, Mexico bigint")


def test_pivot_and_unpivot_are_inverse(spark):
    melted = tr.unpivot(_pivoted(spark), ["year", "product"], "country", "amount")
    assert melted.count() == 24 and tr.unpivot(_pivoted(spark), ["year", "product"], "country", "amount", exclude_nulls=True).count() == 14
    for countries in (["Canada", "China", "Mexico"], None):
        back = tr.pivot(melted, "country", F.sum("amount"), countries)
        assert back.columns == ["year", "product", "Canada", "China", "Mexico"]
        assert sorted(map(str, rows(back))) == sorted(map(str, PIVOTED))


def test_pivot_several_aggregates(spark):
    melted = tr.unpivot(_pivoted(spark), ["year", "product"], "country", "amount").drop("product")
    out = tr.pivot(melted, "country", ["sum(amount) AS total_amount", "count(year) AS nb_years"], ["Canada", "China", "Mexico"])
    assert out.first().asDict() == {"total_amount_Canada": 9000, "nb_years_Canada": 8, "total_amount_China": 10200, "nb_years_China": 8, "total_amount_Mexico": 9400, "nb_years_Mexico": 8}
    with pytest.raises(AnalysisException):
        tr.pivot(melted, "country", [F.sum("amount"), F.count("year")], ["China"])


def test_unpivot_needs_one_type_and_takes_no_ids(spark):
    with pytest.raises(AnalysisException):
        tr.unpivot(_pivoted(spark), ["year"])
    assert tr.unpivot(_pivoted(spark).select("Canada", "China"), [], "k", "v").count() == 16


def test_grouped(spark):
    df = spark.createDataFrame([(2, "Alice", 80), (3, "Alice", 100), (5, "Bob", 120), (10, "Bob", 140)], "age bigint, name string, height bigint")
    for d, prefix in ((df, ""), (df.select(F.struct("*").alias("child")), "child.")):
        assert sorted(rows(group_by(d, f"{prefix}name").avg(f"{prefix}age"))) == [("Alice", 2.5), ("Bob", 7.5)]
        assert group_by(d, f"{prefix}name").sum(f"{prefix}age").columns == ["name", "sum_age"]
        assert rows(group_by(d).avg(f"{prefix}age", f"{prefix}height")) == [(5.0, 110.0)]
    assert group_by(df, "name").max().columns == ["name", "max_age", "max_height"]
    assert sorted(rows(group_by(df, "name").count())) == [("Alice", 2), ("Bob", 2)]
    assert group_by(df).mean("age").columns == ["mean_age"] and rows(group_by(df).min("height")) == [(80,)]
    with pytest.raises(AnalysisException):
        group_by(df).sum("name")


def test_grouped_pivot(spark):
    df = spark.createDataFrame(COURSES, "course string, year bigint, earnings bigint")
    g = group_by(df, "year").pivot("course", ["dotNET", "Java"])
    assert sorted(rows(g.sum("earnings"))) == [(2012, 15000, 20000), (2013, 48000, 30000)]
    out = group_by(df, "year").pivot("course").agg(F.min("earnings").alias("min_earnings"), F.max("earnings").alias("max_earnings"))
    assert out.columns == ["year", "min_earnings_Java", "min_earnings_dotNET", "max_earnings_Java", "max_earnings_dotNET"]
    with pytest.raises(UnsupportedOperationException):
        g.pivot("year")
    struct = df.select(F.struct("*").alias("sales"))
    assert rows(group_by(struct).pivot("sales.course", ["dotNET", "Java"]).sum("sales.earnings")) == [(63000, 50000)]
    import datetime
    import decimal

    assert [value_name(v) for v in (None, True, datetime.date(2024, 1, 1), decimal.Decimal("1.5"), "a", 3)] == ["NULL", "true", "2024_01_01", "1_point_5", "a", "3"]
    with pytest.raises(AnalysisException):
        value_name(1.5)


def test_flatten_and_sort(spark):
    df = spark.createDataFrame([(1, (1, (1, 1)))], "id int, s struct<a:int,b:struct<c:int,d:int>>")
    assert tr.flatten(df).columns == ["id", "s_a", "s_b_c", "s_b_d"] and tr.flatten(df, "__").columns[1] == "s__a"
    arr = spark.createDataFrame([([([([4, 1],), ([3, 2],)],), ([([2, 2],), ([2, 1],)],)],)], "l1 array<struct<a:array<struct<b:array<int>>>>>")
    assert rows(tr.sort_all_arrays(arr)) == [([([([1, 2],), ([2, 2],)],), ([([1, 4],), ([2, 3],)],)],)]
    with pytest.warns(DeprecationWarning):
        tr.normalize_arrays(arr)
    assert tr.sort_columns(spark.createDataFrame([(1, 2)], "b int, a int")).columns == ["a", "b"]
    with pytest.raises(ValueError, match="empty"):
        tr.union_dataframes([])


def test_harmonize(spark):
    left = spark.createDataFrame([(1, (1, [(2, 3)], [4, 5]))], "id bigint, s struct<a:bigint,b:array<struct<c:bigint,d:bigint>>,f:array<bigint>>")
    right = spark.createDataFrame([(1, (2, [(3.0, "4", 5)], [5.0, 6.0]))], "id bigint, s struct<a:bigint,b:array<struct<c:double,d:string,e:bigint>>,f:array<double>>")
    a, b = tr.harmonize_dataframes(left, right)
    assert a.dtypes == b.dtypes == [("id", "bigint"), ("s", "struct<a:bigint,b:array<struct<c:double,d:string>>,f:array<double>>")]
    assert rows(a) == [(1, (1, [(2.0, "3")], [4.0, 5.0]))] and rows(b) == [(1, (2, [(3.0, "4")], [5.0, 6.0]))]
    a, b = tr.harmonize_dataframes(left, right, keep_missing_columns=True)
    assert "e:bigint" in b.dtypes[1][1] and "e:bigint" not in a.dtypes[1][1]
    found = tr.get_common_columns(left.schema, right.schema)
    assert found["id"] is None and found["s.b!.c"].simpleString() == "double"


def test_frame_helpers(spark):
    df1 = spark.createDataFrame([(2, "Alice"), (5, "Bob")], "age bigint, name string")
    df2 = spark.createDataFrame([(80, "Tom"), (85, "Bob")], "height bigint, name string")
    assert rows(frame.join(df1, df2, "name").select("name", "height")) == [("Bob", 85)]
    assert rows(frame.join(df1, df2, "name", "semi")) == [("Bob", 5)] and rows(frame.join(df1, df2, "name", "leftanti")) == [("Alice", 2)]
    assert frame.join(df1, df2, how="cross").count() == 4
    with pytest.raises(AssertionError):
        frame.join(df1, df2, "name", "sideways")
    with pytest.raises(AnalysisException):
        frame.with_column(df1, "age", F.lit(1))
    a, b = spark.createDataFrame([(1, 2, 3)], "col0 int, col1 int, col2 int"), spark.createDataFrame([(4, 5, 6)], "col1 int, col2 int, col3 int")
    assert rows(frame.union_by_name(a, b, allow_missing=True)) == [(1, 2, 3, None), (None, 4, 5, 6)]
    with pytest.raises(ValueError, match="columns differ"):
        frame.union_by_name(a, b)
    text = frame.show_string(spark.createDataFrame([(1, (2, [(3,)])), (2, None)], "id int, s struct<a:int,b:array<struct<c:int>>>"), 1, simplify_structs=True)
    assert text == "+----+------------+\n| id |          s |\n+----+------------+\n|  1 | {2, [{3}]} |\n+----+------------+\nonly showing top 1 row"
    assert frame.human_bytes(1536) == "1.50 KiB" and frame.human_bytes(8) == "8 B"
    assert rows(df1.select(frame.item(df1, 0))) == [(2,), (5,)] and rows(frame.item(df1, ["name"])) == [("Alice",), ("Bob",)]
    assert "Scan ExistingRDD" in frame.compile(df1)
    seen, stats = frame.observed(df1, "n")
    seen.collect()
    assert stats.get["rows"] == 2
