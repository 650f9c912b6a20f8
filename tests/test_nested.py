import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from terrane.errors import AnalysisException
from terrane.operators import nested, printable
from terrane.operators import transformations as tr


def plain(v):
    if isinstance(v, Row):
        return tuple(plain(x) for x in v)
    return [plain(x) for x in v] if isinstance(v, list) else v


def rows(df):
    return [plain(r) for r in df.collect()]


def frame(spark, ddl, *data):
    return spark.createDataFrame(list(data), ddl)


D = "double"
CASES = [
    ("a int", (1,), {"a": lambda r: r["a"]}, (1,)),
    ("a int", (1,), {"a": "a"}, (1,)),
    ("s struct<a:int>", ((2,),), {"s.a": F.expr("cast(s.a as double)") if False else (lambda r: r["s"]["a"].cast(D))}, ((2.0,),)),
    ("e array<int>", ([2, 3],), {"e!": lambda e: e.cast(D)}, ([2.0, 3.0],)),
    ("e array<int>", ([2, 3],), {"e!": None}, ([2, 3],)),
    ("e array<int>", ([2, 3],), {"e!": lambda: F.lit(1)}, ([1, 1],)),
    ("id int, e array<int>", (1, [2, 3]), {"id": None, "e!": "id"}, (1, [1, 1])),
    ("s array<struct<a:int>>", ([(2,)],), {"s!.a": lambda s: s["a"].cast(D)}, ([(2.0,)],)),
    ("s1 struct<s2:struct<a:int>>", (((2,),),), {"s1.s2.a": lambda r: r["s1"]["s2"]["a"].cast(D)}, (((2.0,),),)),
    ("s1 struct<e:array<int>>", (([2, 3],),), {"s1.e!": lambda e: e.cast(D)}, (([2.0, 3.0],),)),
    ("s1 struct<s2:array<struct<a:int>>>", (([(2,)],),), {"s1.s2!.a": lambda s: s["a"].cast(D)}, (([(2.0,)],),)),
    ("s1 array<struct<a:int,s2:struct<b:int>>>", ([(1, (2,))],), {"s1!.a": None, "s1!.s2.b": lambda s1: s1["a"].cast(D)}, ([(1, (1.0,))],)),
    ("s1 array<struct<e:array<int>>>", ([([2, 3],)],), {"s1!.e!": lambda e: e.cast(D)}, ([([2.0, 3.0],)],)),
    ("s1 array<struct<s2:array<struct<a:int>>>>", ([([(2,)],)],), {"s1!.s2!.a": lambda s: s["a"].cast(D)}, ([([(2.0,)],)],)),
    ("s1 array<struct<a:int,s2:array<struct<b:int>>>>", ([(1, [(2,)])],), {"s1!.a": None, "s1!.s2!.b": lambda s1, s2: (s1["a"] + s2["b"]).cast(D)}, ([(1, [(3.0,)])],)),
    ("s1 array<struct<s2:array<struct<a:int,s3:struct<b:int>>>>>", ([([(1, (2,))],)],), {"s1!.s2!.a": None, "s1!.s2!.s3.b": lambda s2: s2["a"].cast(D)}, ([([(1, (1.0,))],)],)),
    ("e array<array<int>>", ([[1], [2, 3]],), {"e!!": lambda e: e + 1}, ([[2], [3, 4]],)),
]


@pytest.mark.parametrize(("ddl", "row", "change", "expected"), CASES)
def test_select(spark, ddl, row, change, expected):
    assert rows(nested.select(frame(spark, ddl, row), change)) == [expected]


def test_outer_elements_and_root(spark):
    df = frame(spark, "id int, s1 array<struct<average:int,values:array<int>>>", (1, [(2, [1, 2, 3]), (3, [1, 2, 3, 4, 5])]))
    change = {"s1!.average": None, "s1!.values!": lambda s1, v: v - s1["average"]}
    assert rows(nested.select(df, change)) == [([(2, [-1, 0, 1]), (3, [-2, -1, 0, 1, 2])],)]
    change["s1!.values!"] = lambda root, s1, v: v - s1["average"] + root["id"]
    assert rows(nested.select(df, change)) == [([(2, [0, 1, 2]), (3, [-1, 0, 1, 2, 3])],)]


def test_with_fields_keeps_all_and_appends(spark):
    df = frame(spark, "id int, s1 array<struct<a:int,b:array<struct<c:int>>>>, s2 struct<f:int>", (1, [(2, [(3,)])], (7,)), (2, None, None))
    out = nested.with_fields(df, {"s5.g": F.col("s2.f").cast(D), "s1!.b!.d": lambda b: b["c"] * 2, "s2.f": lambda r: r["s2"]["f"] + 1})
    assert out.columns == ["id", "s1", "s2", "s5"]
    assert rows(out) == [(1, [(2, [(3, 6)])], (8,), (7.0,)), (2, None, None, (None,))]


def test_only_touched_columns_are_read(spark, tmp_path):
    frame(spark, "id int, a struct<x:int,y:int>, b struct<z:int>", (1, (2, 3), (4,))).write.parquet(str(tmp_path / "t"))
    plan = nested.select(spark.read.parquet(str(tmp_path / "t")), {"a.x": None})._jdf.queryExecution().toString()
    assert "ReadSchema: struct<a:struct<x:int>>" in plan


def test_former_names_warn(spark):
    df = frame(spark, "id int, s struct<a:int>", (1, (2,)))
    with pytest.warns(DeprecationWarning):
        assert rows(nested.select_nested_columns(df, {"s.a": None})) == [((2,),)]
    with pytest.warns(DeprecationWarning):
        assert rows(nested.with_nested_columns(df, {"s.b": F.lit(3)})) == [(1, (2, 3))]


def test_errors(spark):
    df = frame(spark, "id int, s array<struct<a:int>>", (1, [(1,)]))
    with pytest.raises(AnalysisException, match="Invalid field name 'a!b'"):
        nested.select(df, {"a!b": None})
    with pytest.raises(AnalysisException, match=r"Repeated field 'x!' does not exist: Did you mean"):
        nested.select(df, {"x!.a": None})
    with pytest.raises(AnalysisException, match="Field 's!.b' does not exist"):
        nested.select(df, {"s!.b": None})


def test_unnest(spark):
    df = frame(spark, "id int, s1 struct<id:int>, s2 array<struct<id:int,s3:array<struct<id:int>>>>", (1, (2,), [(3, [(5,), (6,)])]))
    out = nested.unnest_all_fields(df, ["id"])
    assert list(out) == ["", "s2!", "s2!.s3!"]
    assert out[""].columns == ["id", "s1__STRUCT__id"] and rows(out[""]) == [(1, 2)]
    assert out["s2!"].columns == ["id", "s2__ARRAY____STRUCT__id"] and rows(out["s2!"]) == [(1, 3)]
    assert rows(out["s2!.s3!"]) == [(1, 5), (1, 6)]
    kept = nested.unnest_fields(df, ["s2!.s3!.id"], ["id", "s2!.id"])["s2!.s3!"]
    assert rows(kept) == [(1, 3, 5), (1, 3, 6)]
    arr = frame(spark, "id int, arr array<struct<a:array<int>>>", (1, [([1, 2],), ([3, 4],)]))
    assert rows(nested.unnest_field(arr, "arr!.a!", ["id"])) == [(1, 1), (1, 2), (1, 3), (1, 4)]
    assert nested.unnest_field(arr, "arr!.a!").columns == ["arr__ARRAY____STRUCT__a__ARRAY__"]


def test_transform_all_fields_with_odd_names(spark):
    odd = "_:<ù%µ> &é-+'è_çà=#|"
    df = spark.createDataFrame([("John", [(1,), (2,)])], f"`name{odd}` string, `s1{odd}` array<struct<`b{odd}`:int>>")
    out = tr.transform_all_fields(df, lambda c, kind: c.cast("string") if kind.simpleString() == "int" else None)
    assert rows(out) == [("John", [("1",), ("2",)])]
    assert out.columns == df.columns


def test_printable():
    double = printable.PrintableFunction(lambda x: x * 2, lambda x: f"{x} * 2")
    plus = printable.PrintableFunction(lambda x: x + 1, lambda x: f"({x} + 1)")
    both = printable.compose(double, plus)
    assert both(3) == 8 and repr(both) == "lambda x: (x + 1) * 2"
    assert repr(printable.recursive_struct_get(["a", "b"])) == "lambda x: x['a']['b']"
    cast = printable.PrintableFunction(lambda e: e.cast("double"), lambda x: f'{x}.cast("FLOAT64")')
    assert nested.show_resolved({"e!": cast}) == "lambda x: [f.transform(x['e'], lambda x: x.cast(\"FLOAT64\")).alias('e')]"
    assert printable.box(lambda a, b: (a, b))([1, 2, 3]) == (2, 3) and printable.arity(both) == 1
