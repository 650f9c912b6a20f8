import pytest
from pyspark.sql import types as T

from terrane.plans import paths as P
from terrane.plans import schema as S
from terrane.plans.types import common_type, common_type_name, name_of, type_of_name

DEEP = "id bigint, s1 array<struct<a:bigint,b:array<struct<c:bigint,d:bigint>>,e:array<bigint>>>, s2 struct<f:bigint>"


def _schema(spark, ddl):
    return spark.createDataFrame([], ddl).schema


@pytest.mark.parametrize(
    ("left", "right", "wide"),
    [("INT64", "DECIMAL", "NUMERIC"), ("DECIMAL", "FLOAT64", "FLOAT"), ("DATE", "TIMESTAMP", "TIMESTAMP"), ("BOOL", "INT64", "STRING"), ("no", "INT64", None), ("BYTES", "STRING", "STRING")],
)
def test_common_type_names(left, right, wide):
    assert common_type_name(left, right) == wide


def test_common_type_of_equal_or_nested_types_is_none():
    assert common_type(T.LongType(), T.LongType()) is None
    assert common_type(T.ArrayType(T.LongType()), T.LongType()) is None
    assert common_type(T.IntegerType(), T.LongType()) == T.LongType()
    assert type_of_name("FLOAT64") == T.DoubleType()
    assert type_of_name("map<int,int>") == "map<int,int>"
    assert name_of(T.StructType([T.StructField("a", T.ArrayType(T.StringType()))])) == "STRUCT<a:ARRAY<STRING>>"


def test_steps_and_granularity():
    assert P.steps("s1!.b!!.c") == ["s1", "!", "b", "!", "!", "c"]
    with pytest.raises(ValueError, match=r"Invalid field name 'a!b': '!' not followed by a '.'"):
        P.steps("a!b")
    assert P.granularity("s1!.b!.c") == "s1!.b!"
    assert P.granularity("id") == ""
    assert P.array_prefixes("s1!.b!.c") == ["s1!", "s1!.b!"]
    assert P.same_granularity("a!.b", "a!.c") and not P.same_granularity("a!.b", "a")
    assert P.is_sub_field("a.b", "a") and P.is_sub_field("a!.b", "a!") and not P.is_sub_field("ab", "a") and not P.is_sub_field("a", "a")
    assert P.is_sub_field_or_equal("a", "a") and P.is_parent_field("a", "a!.b") and P.is_parent_field_of_any("a", ["x", "a.b"])
    assert P.is_sub_field_of_any("a.b", ["x", "a"]) and P.is_sub_field_or_equal_to_any("a", ["a"]) and P.same_granularity_as_any("b", ["a"])
    assert P.unmangle(P.mangle("s1!.b.c!")) == "s1!.b.c!"
    assert P.mangle("s2!.id") == "s2__ARRAY____STRUCT__id"
    assert P.before_last("a.b.c", ".") == "a.b" and P.after_last("a.b.c", ".") == "c" and P.after_last("a", ".") == "a" and P.before_last("a", ".") == ""


def test_flatten_schema(spark):
    schema = _schema(spark, DEEP)
    names = lambda **k: [f.name for f in S.flatten_schema(schema, **k)]
    assert names() == ["id", "s1!.a", "s1!.b!.c", "s1!.b!.d", "s1!.e!", "s2.f"]
    assert names(explode=False) == ["id", "s1", "s2.f"]
    assert names(keep_non_leaf_fields=True) == ["id", "s1", "s1!", "s1!.a", "s1!.b", "s1!.b!", "s1!.b!.c", "s1!.b!.d", "s1!.e", "s1!.e!", "s2", "s2.f"]
    arrays = _schema(spark, "e array<array<int>>, m map<string,int>")
    assert [f.name for f in S.flatten_schema(arrays)] == ["e!!", "m"]


def test_schema_strings(spark):
    df = spark.createDataFrame([], DEEP)
    assert S.schema_string(df).splitlines()[:3] == ["root", " |-- id: INTEGER (nullable = true)", " |-- s1!.a: INTEGER (nullable = true)"]
    assert S.simple_string(df.schema).endswith("s2:STRUCT<f:INTEGER>")
    assert " |-- s1: RECORD (REPEATED)" in S.tree_string(df.schema) and " |    |-- f: INTEGER (NULLABLE)" in S.tree_string(df.schema)
