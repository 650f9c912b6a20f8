import json

import pytest
from pyspark.sql import functions as F

from terrane.cli import diff as cli
from terrane.diff import DiffFormatOptions, compare_dataframes
from terrane.diff.keys import candidates, growth_estimate, infer_key
from terrane.diff.result import DiffStats
from terrane.diff.schema_diff import diff_schemas
from terrane.errors import CombinatorialExplosionError, DataframeComparatorException


def make(spark, ddl, *rows):
    return spark.createDataFrame(list(rows), ddl)


def stats(result, level=""):
    s = result.diff_stats_shards[level]
    return (s.total, s.no_change, s.changed, s.in_left, s.in_right, s.only_in_left, s.only_in_right)


AB = "col1 bigint, col2 string"
ID = "id bigint, name string"
ARR = "id bigint, a array<bigint>"
CASES = {
    "identical": (AB, [(1, "a"), (2, "b"), (3, None)], AB, [(1, "a"), (2, "b"), (3, None)], None, (3, 3, 0, 3, 3, 0, 0), True, True),
    "order": (ID, [(1, "a"), (2, "b"), (3, "c")], ID, [(3, "c"), (1, "a"), (2, "b")], None, (3, 3, 0, 3, 3, 0, 0), True, True),
    "empty": (ID, [], ID, [], ["id"], (0, 0, 0, 0, 0, 0, 0), True, True),
    "other keys": (ID, [(1, "a"), (2, "b"), (3, "c")], ID, [(1, "a"), (2, "b"), (4, "c")], ["id"], (4, 2, 0, 3, 3, 1, 1), True, False),
    "struct": ("id bigint, a struct<a:int,b:int,c:int>", [(1, (1, 2, 3)), (2, (1, 2, 3)), (3, (1, 2, 3))], "id bigint, a struct<a:int,b:int,c:int>", [(1, (1, 2, 3)), (2, (1, 2, 4)), (3, (1, 2, 3))], ["id"], (3, 2, 1, 3, 3, 0, 0), True, False),
    "struct schema": ("id bigint, s1 struct<a:int,b:int>", [(1, (1, 2)), (2, (1, 2)), (3, (1, 2))], "id bigint, s1 struct<a:int,c:int>", [(1, (1, 2)), (2, (2, 2)), (3, (1, 2))], ["id"], (3, 2, 1, 3, 3, 0, 0), False, False),
    "array order": (ARR, [(1, [1, 2, 3]), (2, [1]), (3, [2])], ARR, [(1, [3, 2, 1]), (2, [1]), (3, [2])], None, (3, 3, 0, 3, 3, 0, 0), True, True),
    "null array": (ARR, [(1, [])], ARR, [(1, None)], None, (1, 1, 0, 1, 1, 0, 0), True, True),
    "missing arrays": (ARR, [(1, [1]), (2, []), (3, None)], ARR, [(1, [2])], ["id"], (3, 0, 1, 3, 1, 2, 0), True, False),
    "reordered": ("id bigint, a array<struct<a:int,b:int>>", [(1, [(1, 2)]), (2, [(1, 2)]), (3, [(1, 2), (3, 4)])], "id bigint, a array<struct<b:int,a:int>>", [(1, [(2, 1)]), (2, [(2, 1)]), (3, [(4, 3), (2, 1)])], None, (3, 3, 0, 3, 3, 0, 0), False, True),
    "int and double": ("id bigint, name string", [(1, "a"), (2, "b"), (3, "c")], "id double, name string", [(1.0, "a"), (2.0, "b"), (3.0, "d")], None, (3, 2, 1, 3, 3, 0, 0), False, False),
    "collision": ("id bigint, s struct<a:int>, s_a int", [(1, (2,), 3), (2, (2,), 3), (3, (2,), 3)], "id bigint, s struct<a:int>, s_a int", [(1, (2,), 3), (2, (2,), 3), (3, (2,), 3)], ["id"], (3, 3, 0, 3, 3, 0, 0), True, True),
    "null keys": ("id1 bigint, id2 bigint, name string", [(1, 1, "a"), (2, None, "b"), (None, 3, "c"), (None, None, "d"), (5, 5, "e")], "id1 bigint, id2 bigint, name string", [(1, 1, "a"), (2, None, "b"), (None, 3, "x"), (None, None, "d"), (5, 5, "e")], ["id1", "id2"], (5, 4, 1, 5, 5, 0, 0), True, False),
    "column removed": ("id bigint, col1 string, x int", [(1, "a", 1), (2, "b", 1), (3, "c", 1)], "id bigint, col1 string", [(1, "a"), (2, "b"), (3, "c")], None, (3, 3, 0, 3, 3, 0, 0), False, True),
    "column added": ("id bigint, col1 string", [(1, "a"), (2, "b"), (3, "c")], "id bigint, x int, col1 string", [(1, 1, "a"), (2, 1, "b"), (3, 1, "c")], None, (3, 3, 0, 3, 3, 0, 0), False, True),
    "boolean key": ("k boolean, v int", [(True, 1), (False, 2)], "k boolean, v int", [(True, 1), (False, 3)], ["k"], (2, 1, 1, 2, 2, 0, 0), True, False),
}


@pytest.mark.parametrize("name", CASES)
def test_stats(spark, name):
    ddl1, rows1, ddl2, rows2, keys, expected, same_schema, same_data = CASES[name]
    result = compare_dataframes(make(spark, ddl1, *rows1), make(spark, ddl2, *rows2), keys)
    assert stats(result) == expected
    assert (result.same_schema, result.same_data) == (same_schema, same_data)
    assert result.is_ok == (same_schema and same_data)
    result.display()
    result.close()


def test_distinguish_null_arrays(spark):
    result = compare_dataframes(make(spark, ARR, (1, [])), make(spark, ARR, (1, None)), ["id"], distinguish_null_arrays=True)
    assert stats(result) == (1, 0, 1, 1, 1, 0, 0)


def _arrays(spark):
    left = make(spark, "id bigint, my_array array<struct<a:int,b:int,c:int>>", *[(i, [(1, 2, 3)]) for i in (1, 2, 3)])
    right = make(spark, "id bigint, my_array array<struct<a:int,b:int,c:int,d:int>>", (1, [(1, 2, 3, 4)]), (2, [(2, 2, 3, 4)]), (4, [(1, 2, 3, 4)]))
    return left, right


def test_array_as_a_value(spark, capsys):
    result = compare_dataframes(*_arrays(spark))
    assert "Chosen column: id" in capsys.readouterr().out
    assert stats(result) == (4, 0, 2, 3, 3, 1, 1)
    result.display(show_examples=True)
    text = capsys.readouterr().out
    assert "-my_array ARRAY<STRUCT<a:INTEGER,b:INTEGER,c:INTEGER>>" in text and "diff NOT ok" in text
    assert "1 (25.0%) rows are only in 'right'" in text and "Examples by column" in text


def test_array_opened(spark, capsys):
    result = compare_dataframes(*_arrays(spark), join_cols=["id", "my_array!.a"])
    assert "Joining both tables on the provided columns: ['id', 'my_array!.a']" in capsys.readouterr().out
    assert stats(result) == (4, 2, 0, 3, 3, 1, 1) and stats(result, "my_array!") == (5, 1, 0, 3, 3, 2, 2)
    assert result.schema_diff_result.column_names_diff == {"id": " ", "my_array!.a": " ", "my_array!.b": " ", "my_array!.c": " ", "my_array!.d": "+"}
    result.display()
    text = capsys.readouterr().out
    root, inner = text.split("Granularity : my_array!")
    assert "my_array!.a" not in root.split("Granularity : root")[1] and "2 rows are in 'right' alone" in inner


def test_per_column(spark):
    left = make(spark, "id int, c1 string, c2 int, c3 int", (1, "a", 1, 1), (2, "b", 2, 1), (3, "b", 2, 2), (4, "b", 2, 2), (5, "c", 3, 3))
    right = make(spark, "id int, c1 string, c2 int, c4 int", (1, "a", 1, 1), (2, "b", 3, 1), (3, "b", 4, 2), (4, "b", 4, 2), (6, "f", 3, 3))
    result = compare_dataframes(left, right, ["id"])
    assert stats(result) == (6, 1, 3, 5, 5, 1, 1)
    top = {tuple(r) for r in result.top_per_col_state_df.filter("column_name = 'c2'").collect()}
    assert top == {
        ("c2", "changed", "2", "4", 2, 1), ("c2", "changed", "2", "3", 1, 2), ("c2", "no_change", "1", "1", 1, 1), ("c2", "only_in_left", "3", None, 1, 1), ("c2", "only_in_right", None, "3", 1, 1),
    }
    rows = {r.column_name: r for r in result.get_diff_per_col_df(10).collect()}
    assert [rows[c].column_number for c in ("id", "c1", "c2")] == [0, 1, 2]
    assert tuple(rows["id"].counts) == (6, 0, 4, 1, 1) and tuple(rows["c2"].counts) == (6, 3, 1, 1, 1) and tuple(rows["c3"].counts) == (5, 0, 0, 5, 0) and tuple(rows["c4"].counts) == (5, 0, 0, 0, 5)
    assert [tuple(x) for x in rows["c2"].diff.changed] == [("2", "3", 1), ("2", "4", 2)]
    assert [tuple(x) for x in rows["c1"].diff.no_change] == [("a", 1), ("b", 3)] and rows["c3"].diff.changed == []
    assert len({r.column_name: r for r in result.get_diff_per_col_df(1).collect()}["c2"].diff.changed) == 1


def test_three_granularities(spark):
    ddl = "id bigint, s array<struct<id:int,a:string,ss:array<struct<id:int,a:string>>>>"
    left = make(spark, ddl, (1, [(1, "x", [(1, "p"), (2, "q")]), (2, "y", [(1, "p")])]), (2, [(1, "x", [(1, "p")])]))
    right = make(spark, ddl, (1, [(2, "y", [(1, "CHANGED")]), (1, "x", [(2, "q"), (1, "p")])]), (2, [(1, "x", [(1, "p"), (9, "new")])]))
    result = compare_dataframes(left, right, ["id", "s!.id", "s!.ss!.id"])
    assert stats(result) == (2, 2, 0, 2, 2, 0, 0) and stats(result, "s!") == (3, 3, 0, 3, 3, 0, 0)
    assert stats(result, "s!.ss!") == (5, 3, 1, 4, 5, 0, 1)


def test_wide_struct(spark):
    def deep(kind, depth=3):
        return kind if depth == 0 else "struct<" + ",".join(f"f{i}:{deep(kind, depth - 1)}" for i in range(3)) + ">"

    def value(v, depth=3):
        return v if depth == 0 else tuple(value(v, depth - 1) for _ in range(3))

    left, right = make(spark, f"id int, s {deep('int')}", *[(i, value(i)) for i in range(3)]), make(spark, f"id int, s {deep('double')}", *[(i, value(float(i))) for i in range(3)])
    result = compare_dataframes(left, right, ["id"])
    assert stats(result) == (3, 3, 0, 3, 3, 0, 0) and not result.same_schema


def test_schema_diff(spark):
    left, right = make(spark, "id int, c1 string, c2 string, c4 array<struct<a:int,b:string>>").schema, make(spark, "id int, c1 int, c3 string, c4 array<struct<a:int,d:string>>").schema
    flat = diff_schemas(left, right, ["id"])
    assert flat.column_names_diff == {"id": " ", "c1": " ", "c2": "-", "c3": "+", "c4": " "}
    assert flat.diff_str.splitlines()[2:] == [" id INTEGER", "-c1 STRING", "-c2 STRING", "-c4 ARRAY<STRUCT<a:INTEGER,b:STRING>>", "+c1 INTEGER", "+c3 STRING", "+c4 ARRAY<STRUCT<a:INTEGER,d:STRING>>"] or "@@" in flat.diff_str
    opened = diff_schemas(left, right, ["id", "c4!.a"])
    assert opened.column_names_diff == {"id": " ", "c1": " ", "c2": "-", "c3": "+", "c4!.a": " ", "c4!.b": "-", "c4!.d": "+"}
    same = diff_schemas(left, left, ["id"])
    assert same.same_schema and same.text() == "Schema: ok (4)"


def test_keys(spark):
    names = make(spark, "id int, name string", *[(i, n) for i, n in enumerate("abbccc")])
    assert growth_estimate(names, ["id"]) == 1.0 and growth_estimate(names, ["name"]) == 2.33 and growth_estimate(names.limit(0), ["id"]) == 1.0
    nulls = names.withColumn("name", F.expr("nullif(name, 'c')"))
    assert growth_estimate(nulls, ["name"]) == 2.33
    many = make(spark, "near bigint, only bigint", *[(max(i, 1), i) for i in range(21)])
    assert candidates(many, many) == ["near", "only"] and infer_key(many, many) == ("only", 1.0)
    with pytest.raises(CombinatorialExplosionError):
        compare_dataframes(names, names, ["name"])
    with pytest.raises(DataframeComparatorException):
        compare_dataframes(names.select("name"), names.select("name"))
    with pytest.raises(DataframeComparatorException):
        compare_dataframes(names, names, ["nothing"])


def test_warns_of_repeated_keys(spark, capsys):
    df = make(spark, "id int, v int", (1, 1), (1, 2), (2, 1), (3, 1), (4, 1), (5, 1))
    compare_dataframes(df, df, ["id"])
    assert "WARNING: join_cols" in capsys.readouterr().out


def test_html_and_command_line(spark, tmp_path, capsys):
    left, right = _arrays(spark)
    left.write.parquet(str(tmp_path / "l"))
    right.write.parquet(str(tmp_path / "r"))
    out = tmp_path / "report.html"
    cli.main(["--tables", str(tmp_path / "l"), str(tmp_path / "r"), "--join-cols", "id", "--output", str(out), "--nb-top-values", "3"])
    page = out.read_text()
    data = json.loads(page.split('id="diff">')[1].split("</script>")[0])
    assert data["stats"]["root"]["changed"] == 2 and data["columns"][1]["column_name"] == "my_array"
    with pytest.raises(SystemExit) as e:
        cli.main([])
    assert e.value.code == 0 and "--join-cols" in capsys.readouterr().out


def test_percentages_of_nothing():
    empty = DiffStats(0, 0, 0, 0, 0, 0, 0)
    assert empty.percent_changed == 0.0 and empty.same_data
    assert "Row count changed" in DiffStats(3, 1, 0, 3, 1, 2, 0).text("a", "b")
    assert DiffFormatOptions().nb_diffed_rows == 10


def test_counts_alone_cache_nothing(spark):
    left, right = make(spark, "id int, c string", (1, "a"), (2, "b")), make(spark, "id int, c string", (1, "a"), (2, "x"))
    result = compare_dataframes(left, right, ["id"])
    assert result.diff_stats_shards[""].changed == 1 and not result.diff_df_shards[""].is_cached
    summary = result.summary()
    assert summary["stats"]["root"]["changed"] == 1 and result.diff_df_shards[""].is_cached
    result.close()
    assert not result.diff_df_shards[""].is_cached
