"""Queries on the supplied tables, at least one for each operator, and their SQL."""

from __future__ import annotations

import contextlib
import io
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane import functions as f
from terrane.diff.compare import build_diff, compare_dataframes
from terrane.diff.keys import growth_estimate
from terrane.diff.result import DiffFormatOptions, DiffResult
from terrane.diff.schema_diff import diff_schemas
from terrane.errors import AnalysisException, CombinatorialExplosionError
from terrane.operators import analyze as profile
from terrane.operators import frame, nested
from terrane.operators import transformations as tr
from terrane.operators.graph import connected_components
from terrane.operators.grouped import group_by
from terrane.plans import paths
from terrane.plans.schema import flatten_schema, simple_string, tree_string
from terrane.plans.types import name_of
from terrane.session import cut, drop_path, load, new_path
from terrane.sources import Session, Writer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that gives the same rows."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


# Projection, filters, expressions.


@query("SELECT o_orderkey, o_totalprice * 2 AS double_price, upper(o_orderstatus) AS status FROM orders")
def select_expr(spark, d):
    return load(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") * 2).alias("double_price"), f.upper("o_orderstatus").alias("status"))


@query("SELECT * REPLACE (lower(o_orderpriority) AS o_orderpriority), o_custkey + 1 AS next_cust FROM orders")
def with_column_replace(spark, d):
    df = frame.with_column(load(spark, d, "orders"), "o_orderpriority", f.lower("o_orderpriority"), replace=True)
    return frame.with_column(df, "next_cust", F.col("o_custkey") + 1)


@query("SELECT * EXCLUDE (o_totalprice, o_orderdate) FROM orders")
def drop_cols(spark, d):
    return load(spark, d, "orders").drop("o_totalprice", "o_orderdate", "no_such_column")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark, d):
    return load(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def select_by_item(spark, d):
    df = load(spark, d, "orders")
    return frame.item(frame.item(df, frame.item(df, 2) == "F"), ["o_orderkey", "o_custkey"])


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_quantity > 30 AND l_discount < 0.05) OR NOT (l_returnflag <> 'R')")
def filter_compound(spark, d):
    c = F.col
    return load(spark, d, "lineitem").filter(((c("l_quantity") > 30) & (c("l_discount") < 0.05)) | ~(c("l_returnflag") != "R")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def filter_isin(spark, d):
    return load(spark, d, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_name")


@query("SELECT o_orderkey, nullif(o_orderstatus, 'O') IS NOT DISTINCT FROM nullif(o_orderstatus, 'F') AS same FROM orders")
def filter_null_safe_eq(spark, d):
    a, b = (F.expr(f"nullif(o_orderstatus, '{x}')") for x in "OF")
    return load(spark, d, "orders").select("o_orderkey", a.eqNullSafe(b).alias("same"))


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS DOUBLE) + 1 AS plus_one, 10 - l_quantity AS ten_minus, l_quantity * 2 AS twice, l_orderkey / 4 AS quarter, -l_quantity AS negative FROM lineitem"
)
def arith_ops(spark, d):
    q = F.col("l_quantity")
    return load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (q + 1).alias("plus_one"), (10 - q).alias("ten_minus"), (q * 2).alias("twice"), (F.col("l_orderkey") / 4).alias("quarter"), (-q).alias("negative")
    )


@query("SELECT o_orderkey, (o_orderkey - 500) % 7 AS m FROM orders")
def mod_op(spark, d):
    return load(spark, d, "orders").select("o_orderkey", ((F.col("o_orderkey") - 500) % 7).alias("m"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' END AS level FROM orders")
def case_when(spark, d):
    p = F.col("o_totalprice")
    return load(spark, d, "orders").select("o_orderkey", f.when(p > 200000, "high").when(p > 100000, "middle").alias("level"))


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, CAST(CAST(o_orderkey AS VARCHAR) AS BIGINT) AS i, CAST(o_orderkey AS DOUBLE) AS x, CAST(o_orderdate AS DATE) AS day FROM orders")
def cast_ops(spark, d):
    k = F.col("o_orderkey")
    return load(spark, d, "orders").select("o_orderkey", f.cast(k, "STRING").alias("s"), f.cast(f.cast(k, "STRING"), "INT64").alias("i"), f.cast(k, "FLOAT64").alias("x"), f.cast("o_orderdate", "DATE").alias("day"))


@query("SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O'), nullif(o_orderpriority, '1-URGENT'), 'none') AS c FROM orders")
def coalesce_op(spark, d):
    return load(spark, d, "orders").select("o_orderkey", f.coalesce(F.expr("nullif(o_orderstatus, 'O')"), F.expr("nullif(o_orderpriority, '1-URGENT')"), f.lit("none")).alias("c"))


@query("SELECT o_orderkey, nullif(o_orderstatus, 'O') IS NULL AS missing, nullif(o_orderstatus, 'O') IS NOT NULL AS present FROM orders")
def isnull_op(spark, d):
    x = F.expr("nullif(o_orderstatus, 'O')")
    return load(spark, d, "orders").select("o_orderkey", f.isnull(x).alias("missing"), x.isNotNull().alias("present"))


@query(
    "SELECT n_nationkey, (n_nationkey > 5) AND nullif(n_regionkey, 1) = 2 AS both_, (n_nationkey > 5) OR nullif(n_regionkey, 1) = 2 AS either_, NOT (nullif(n_regionkey, 1) = 2) AS not_ FROM nation"
)
def three_valued_logic(spark, d):
    a, b = F.col("n_nationkey") > 5, F.expr("nullif(n_regionkey, 1)") == 2
    return load(spark, d, "nation").select("n_nationkey", (a & b).alias("both_"), (a | b).alias("either_"), (~b).alias("not_"))


@query("SELECT 1::BIGINT AS i, 'it''s' AS s, 1.5::DOUBLE AS x, true AS b, DATE '2024-01-31' AS d, TIMESTAMP '2024-01-31 10:20:30' AS t, 3::BIGINT AS a1, 'v' AS s1, CAST(NULL AS VARCHAR) AS n")
def literals(spark, d):
    import datetime

    cols = [f.lit(1).alias("i"), f.lit("it's").alias("s"), f.lit(1.5).alias("x"), f.lit(True).alias("b"), f.lit(datetime.date(2024, 1, 31)).alias("d")]
    cols += [f.lit(datetime.datetime(2024, 1, 31, 10, 20, 30)).alias("t"), f.lit([2, 3])[1].alias("a1"), f.lit({"k": "v"})["k"].alias("s1"), f.lit(None).cast("string").alias("n")]
    return spark.range(1).select(*cols)


@query("SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first, label FROM embeddings")
def item_access(spark, d):
    return load(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("first"), F.struct("label")["label"].alias("label"))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def sql_and_views(spark, d):
    session = Session(spark)
    session.create_or_replace_temp_view(load(spark, d, "nation"), "terrane_nation")
    session.create_or_replace_temp_view(session.sql("SELECT * FROM terrane_nation"), "terrane_nation")
    return session.sql("SELECT n_name, r_name FROM terrane_nation JOIN {region} ON n_regionkey = r_regionkey", region=load(spark, d, "region"))


@query("SELECT r_regionkey + 10 AS k, r_name FROM region WHERE r_regionkey < 3")
def temp_table(spark, d):
    session = Session(spark)
    kept = session.create_or_replace_temp_table(load(spark, d, "region").filter("r_regionkey < 3"), "terrane_region")
    return kept.transform(lambda x: x.select((F.col("r_regionkey") + 10).alias("k"), "r_name"))


# Joins.


# Every order and customer takes part; some keys of both sides are null, so that they match nothing.
_OC = "(SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey END AS c_custkey FROM orders) o {kind} JOIN (SELECT CASE WHEN c_nationkey % 4 <> 0 THEN c_custkey END AS c_custkey, c_name FROM customer) c USING (c_custkey)"


def _join_query(how: str, kind: str, columns: str = "c_custkey, o_orderkey, c_name"):
    def run(spark, d):
        left = load(spark, d, "orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey END AS c_custkey"))
        right = load(spark, d, "customer").select(F.expr("CASE WHEN c_nationkey % 4 <> 0 THEN c_custkey END AS c_custkey"), "c_name")
        return frame.join(left, right, "c_custkey", how).select(*columns.split(", "))

    run.__name__ = f"join_{kind.lower()}"
    query(f"SELECT {columns} FROM {_OC.format(kind=kind)}")(run)


for _how, _kind in (("inner", "INNER"), ("left_outer", "LEFT"), ("right", "RIGHT"), ("outer", "FULL")):
    _join_query(_how, _kind)
_join_query("semi", "SEMI", "c_custkey, o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders o ANTI JOIN lineitem l ON o.o_orderkey = l.l_orderkey")
def join_anti(spark, d):
    return frame.join(load(spark, d, "orders"), load(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(spark, d):
    return frame.join(load(spark, d, "nation"), load(spark, d, "region"), how="cross").select("n_name", "r_name")


@query("SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta(spark, d):
    a, b = load(spark, d, "nation").alias("a"), load(spark, d, "nation").alias("b")
    on = [F.col("a.n_regionkey") == F.col("b.n_regionkey"), F.col("a.n_nationkey") < F.col("b.n_nationkey")]
    return frame.join(a, b, on).select(F.col("a.n_name").alias("a_name"), F.col("b.n_name").alias("b_name"))


@query(
    "SELECT a.n_name AS a_name, b.r_name AS b_name FROM (SELECT n_name, nullif(n_regionkey, 1) AS k FROM nation) a FULL JOIN (SELECT r_name, nullif(r_regionkey, 1) AS k FROM region) b ON a.k IS NOT DISTINCT FROM b.k"
)
def join_null_safe(spark, d):
    a = load(spark, d, "nation").select("n_name", F.expr("nullif(n_regionkey, 1) AS ka"))
    b = load(spark, d, "region").select("r_name", F.expr("nullif(r_regionkey, 1) AS kb"))
    return frame.join(a, b, F.col("ka").eqNullSafe(F.col("kb")), "full").select(F.col("n_name").alias("a_name"), F.col("r_name").alias("b_name"))


@query(
    "SELECT l_orderkey, l_suppkey, n FROM (SELECT l_orderkey, l_suppkey, l_partkey FROM lineitem) JOIN (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) USING (l_orderkey, l_suppkey)"
)
def join_multi_key(spark, d):
    line = load(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    return frame.join(line, line.groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n")), ["l_orderkey", "l_suppkey"]).select("l_orderkey", "l_suppkey", "n")


# Aggregation.

_MONEY = "CAST(sum(CAST({0} AS DECIMAL(18,2))) AS DOUBLE)"


def _money(c: str):
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


@query(f"SELECT count(*) AS n, {_MONEY.format('o_totalprice')} AS total, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders")
def agg_global(spark, d):
    return load(spark, d, "orders").agg(f.count(f.lit(1)).alias("n"), _money("o_totalprice").alias("total"), f.min("o_orderkey").alias("first"), f.max("o_orderkey").alias("last"))


@query(
    "SELECT l_returnflag, l_linestatus, count(*) AS n, count(nullif(l_linenumber, 1)) AS n_later, "
    + _MONEY.format("l_quantity")
    + " AS quantity, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, avg(l_linenumber) AS line FROM lineitem GROUP BY ALL"
)
def agg_group(spark, d):
    grouped = group_by(load(spark, d, "lineitem"), "l_returnflag", "l_linestatus")
    return grouped.agg(
        f.count("*").alias("n"), f.count(F.expr("nullif(l_linenumber, 1)")).alias("n_later"), _money("l_quantity").alias("quantity"), f.min("l_extendedprice").alias("lo"), f.max("l_extendedprice").alias("hi"), f.avg("l_linenumber").alias("line")
    )


@query("SELECT n_regionkey, max(n_nationkey) AS max_n_nationkey, max(n_regionkey) AS max_n_regionkey FROM nation GROUP BY n_regionkey")
def agg_numeric_default(spark, d):
    return group_by(load(spark, d, "nation"), "n_regionkey").max()


@query("SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1")
def agg_count(spark, d):
    return group_by(load(spark, d, "orders"), "o_orderpriority").count()


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def agg_count_distinct(spark, d):
    return group_by(load(spark, d, "orders"), "o_orderpriority").agg(f.count_distinct("o_custkey").alias("customers"))


@query("SELECT c_nationkey, min(c_custkey) AS min_c_custkey, CAST(sum(c_custkey) AS BIGINT) AS sum_c_custkey FROM customer GROUP BY 1")
def agg_struct_path(spark, d):
    df = load(spark, d, "customer").select(F.struct("c_nationkey", "c_custkey").alias("s"))
    low, total = group_by(df, "s.c_nationkey").min("s.c_custkey"), group_by(df, "s.c_nationkey").sum("s.c_custkey")
    return low.join(total, "c_nationkey")


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS names FROM nation GROUP BY 1")
def agg_array_agg_sorted(spark, d):
    return load(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(f.array_agg("n_name", order_by=F.desc("n_name")), ",").alias("names"))


@query("SELECT o_custkey, array_to_string(list_slice(list_sort(list_distinct(list(o_orderpriority))), 1, 2), ',') AS first_two FROM orders GROUP BY 1")
def agg_array_agg_distinct_limit(spark, d):
    return load(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(f.array_agg("o_orderpriority", order_by="o_orderpriority", distinct=True, limit=2), ",").alias("first_two"))


@query()
def agg_approx_distinct(spark, d):
    return load(spark, d, "orders").groupBy("o_orderpriority").agg(f.approx_count_distinct("o_custkey").alias("customers"))


@query("SELECT count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS done, CAST(sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) AS BIGINT) AS large FROM orders")
def agg_conditional(spark, d):
    return load(spark, d, "orders").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.sum(F.when(F.col("o_totalprice") > 100000, 1).otherwise(0)).alias("large"))


# Pivot.

_TYPES = ("click", "error", "purchase")


@query("SELECT user_id % 10 AS bucket, " + ", ".join(f"CASE WHEN count(CASE WHEN event_type = '{t}' THEN 1 END) > 0 THEN CAST(sum(CASE WHEN event_type = '{t}' THEN event_id END) AS BIGINT) END AS {t}" for t in _TYPES) + " FROM events GROUP BY 1")
def pivot_values(spark, d):
    df = load(spark, d, "events").withColumn("bucket", F.col("user_id") % 10)
    return group_by(df, "bucket").pivot("event_type", list(_TYPES)).sum("event_id")


@query("SELECT l_returnflag, " + ", ".join(f"nullif(count(CASE WHEN l_linestatus = '{s}' THEN 1 END), 0) AS {s}" for s in "FO") + " FROM lineitem GROUP BY 1")
def pivot_inferred(spark, d):
    return group_by(load(spark, d, "lineitem"), "l_returnflag").pivot("l_linestatus").agg(f.count(f.lit(1)))


@query("SELECT l_returnflag, " + ", ".join(f"{a}(CASE WHEN l_linestatus = '{s}' THEN l_linenumber END) AS {a}_line_{s}" for a in ("min", "max") for s in "FO") + " FROM lineitem GROUP BY 1")
def pivot_multi_agg(spark, d):
    return group_by(load(spark, d, "lineitem"), "l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(f.min("l_linenumber").alias("min_line"), f.max("l_linenumber").alias("max_line"))


@query(
    "SELECT day, " + ", ".join(f"{a}(CASE WHEN event_type = '{t}' THEN event_id END) AS {n}_{t}" for t in _TYPES for a, n in (("min", "first"), ("max", "last"))) + " FROM (SELECT CAST(ts AS DATE) AS day, event_type, event_id FROM events) GROUP BY 1"
)
def pivot_implicit_group(spark, d):
    df = load(spark, d, "events").select(F.col("ts").cast("date").alias("day"), "event_type", "event_id")
    return tr.pivot(df, "event_type", [f.min("event_id").alias("first"), f.max("event_id").alias("last")], list(_TYPES))


def _melted(spark, d, exclude_nulls):
    wide = load(spark, d, "nation").select("n_nationkey", F.expr("nullif(n_regionkey, 2) AS a"), (F.col("n_regionkey") + 1).alias("b"))
    return tr.unpivot(wide, ["n_nationkey"], "key", "value", exclude_nulls=exclude_nulls)


_MELT = "SELECT n_nationkey, 'a' AS key, nullif(n_regionkey, 2) AS value FROM nation UNION ALL SELECT n_nationkey, 'b', n_regionkey + 1 FROM nation"


@query(_MELT)
def unpivot_keep_nulls(spark, d):
    return _melted(spark, d, False)


@query(f"SELECT * FROM ({_MELT}) WHERE value IS NOT NULL")
def unpivot_exclude_nulls(spark, d):
    return _melted(spark, d, True)


# Sort, limit, sets.


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def sort_limit_topk(spark, d):
    return load(spark, d, "orders").orderBy(f.desc("o_totalprice"), f.asc("o_orderkey")).limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders QUALIFY place <= 3")
def topk_per_group(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return load(spark, d, "orders").withColumn("place", F.row_number().over(w)).filter("place <= 3").select("o_custkey", "o_orderkey", "place")


@query("SELECT o_orderkey FROM orders UNION ALL SELECT o_custkey FROM orders")
def union_all(spark, d):
    o = load(spark, d, "orders")
    return o.select("o_orderkey").union(o.select("o_custkey"))


@query("SELECT o_orderkey, o_custkey, NULL::VARCHAR AS o_orderstatus FROM orders UNION ALL SELECT o_orderkey, NULL, o_orderstatus FROM orders")
def union_by_name_missing(spark, d):
    o = load(spark, d, "orders")
    return frame.union_by_name(o.select("o_orderkey", "o_custkey"), o.select("o_orderstatus", "o_orderkey"), allow_missing=True)


@query("SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT c_name FROM customer")
def union_many(spark, d):
    return tr.union_dataframes([load(spark, d, t).select(F.col(f"{t[0]}_name").alias("name")) for t in ("region", "nation", "customer")])


# Functions.


@query(
    "SELECT p_partkey, concat(p_name, '/', p_brand) AS c, length(p_name) AS n, lower(p_type) AS lo, upper(p_type) AS up, substring(p_name, 2, 3) AS sub, substring(p_name, 3) AS rest, replace(p_type, 'A', '_') AS rep, "
    "regexp_replace(p_type, '([A-Z])([A-Z]+)', '\\2\\1', 'g') AS rx FROM part"
)
def fn_string(spark, d):
    return load(spark, d, "part").select(
        "p_partkey", f.concat("p_name", f.lit("/"), "p_brand").alias("c"), f.length("p_name").cast("bigint").alias("n"), f.lower("p_type").alias("lo"), f.upper("p_type").alias("up"), f.substring("p_name", 2, 3).alias("sub"),
        f.substring("p_name", 3).alias("rest"), f.replace("p_type", "A", "_").alias("rep"), f.regexp_replace("p_type", "([A-Z])([A-Z]+)", r"\2\1").alias("rx"),
    )


@query("SELECT c_custkey, base64(encode(c_name)) AS b, c_name AS back FROM customer")
def fn_base64(spark, d):
    b = f.to_base64(F.col("c_name").cast("binary"))
    return load(spark, d, "customer").select("c_custkey", b.alias("b"), f.from_base64(b).cast("string").alias("back"))


@query("SELECT c_custkey, c_name AS back FROM customer")
def fn_base32(spark, d):
    return load(spark, d, "customer").select("c_custkey", f.from_base32(f.to_base32(F.col("c_name").cast("binary"))).cast("string").alias("back"))


@query()
def fn_hash(spark, d):
    return load(spark, d, "customer").select("c_custkey", f.hash("c_custkey", "c_name").alias("h"))


# Generators and arrays.


@query("SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM part")
def explode_one(spark, d):
    return load(spark, d, "part").select("p_partkey", f.explode(F.split("p_type", " ")).alias("word"))


@query("SELECT p_partkey, a.w AS word, b.w AS letter FROM part, (SELECT unnest(string_split(p_type, ' ')) AS w) a, (SELECT unnest(['x', 'y']) AS w) b")
def explode_two_product(spark, d):
    return load(spark, d, "part").select("p_partkey", f.explode(F.split("p_type", " ")).alias("word"), f.explode(f.lit(["x", "y"])).alias("letter"))


def _line_numbers(spark, d):
    lines = load(spark, d, "lineitem").groupBy("l_orderkey").agg(f.array_agg("l_linenumber", order_by="l_linenumber").alias("numbers"))
    return load(spark, d, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "numbers")


@query("SELECT o_orderkey, l_linenumber AS number FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def explode_outer_empty(spark, d):
    return _line_numbers(spark, d).select("o_orderkey", f.explode_outer("numbers").alias("number"))


_POS = "SELECT o_orderkey, l_linenumber AS number, CASE WHEN l_linenumber IS NOT NULL THEN row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber) - 1 END AS number_pos FROM orders {0} JOIN lineitem ON o_orderkey = l_orderkey"


@query(_POS.format("INNER"))
def posexplode_pos(spark, d):
    return _line_numbers(spark, d).select("o_orderkey", *f.posexplode("numbers", "number"))


@query(_POS.format("LEFT"))
def posexplode_outer_empty(spark, d):
    return _line_numbers(spark, d).select("o_orderkey", *f.posexplode_outer("numbers", "number"))


@query("SELECT l_orderkey AS o_orderkey, string_agg(CAST(l_linenumber * 10 AS VARCHAR), ',' ORDER BY l_linenumber) AS tens FROM lineitem GROUP BY 1")
def array_transform(spark, d):
    return _line_numbers(spark, d).filter("numbers IS NOT NULL").select("o_orderkey", F.array_join(f.transform("numbers", lambda x: (x * 10).cast("string")), ",").alias("tens"))


@query("SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS parts FROM lineitem GROUP BY 1")
def array_sort_plain(spark, d):
    parts = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("p"))
    return parts.select("l_orderkey", F.array_join(f.sort_array("p").cast("array<string>"), ",").alias("parts"))


@query("SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber DESC, l_partkey) AS parts FROM lineitem GROUP BY 1")
def array_sort_keys(spark, d):
    lines = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey")).alias("s"))
    order = f.sort_array("s", lambda x: [x["l_linenumber"].desc(), x["l_partkey"].asc()])
    return lines.select("l_orderkey", F.array_join(f.transform(order, lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


# Nested fields.


def orders_nested(spark, d) -> DataFrame:
    """Orders with their customer as a struct and their lines as an array of structs; null where there are none."""
    line = load(spark, d, "lineitem")
    lines = line.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("number"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"), F.array("l_returnflag", "l_linestatus").alias("flags"))).alias("lines"))
    customer = load(spark, d, "customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).alias("customer"))
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return o.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_orderstatus", "customer", "lines")


_LINES = "FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey"


@query("SELECT * FROM (VALUES (0, 'o_orderkey'), (1, 'o_orderstatus'), (2, 'customer.name'), (3, 'customer.nation'), (4, 'lines!.number'), (5, 'lines!.part'), (6, 'lines!.quantity'), (7, 'lines!.flags!')) t(i, field)")
def nested_fields(spark, d):
    return spark.createDataFrame(list(enumerate(nested.fields(orders_nested(spark, d)))), "i int, field string")


@query(
    "SELECT * FROM (VALUES ('o_orderkey', 'INTEGER'), ('o_orderstatus', 'STRING'), ('customer.name', 'STRING'), ('customer.nation', 'INTEGER'), ('lines!.number', 'INTEGER'), ('lines!.part', 'INTEGER'), ('lines!.quantity', 'FLOAT'), ('lines!.flags!', 'STRING')) t(field, kind)"
)
def nested_schema_string(spark, d):
    return spark.createDataFrame([(x.name, name_of(x.dataType)) for x in flatten_schema(orders_nested(spark, d).schema)], "field string, kind string")


@query("SELECT o_orderkey, upper(c_name) AS name, c_nationkey + 1 AS nation FROM orders JOIN customer ON o_custkey = c_custkey")
def nested_select_struct(spark, d):
    out = nested.select(orders_nested(spark, d), {"o_orderkey": None, "customer.name": F.upper("customer.name"), "customer.nation": lambda r: r["customer"]["nation"] + 1})
    return out.select("o_orderkey", "customer.name", "customer.nation")


@query(f"SELECT o_orderkey, l_linenumber AS number, l_quantity * 2 AS twice, o_orderstatus AS status {_LINES}")
def nested_select_array(spark, d):
    out = nested.select(orders_nested(spark, d), {"o_orderkey": None, "lines!.number": None, "lines!.twice": lambda x: x["quantity"] * 2, "lines!.status": "o_orderstatus"})
    return out.select("o_orderkey", F.inline("lines"))


@query(f"SELECT o_orderkey, l_linenumber AS number, concat(l_returnflag, '-', l_linenumber, '-', o_orderkey) AS first, concat(l_linestatus, '-', l_linenumber, '-', o_orderkey) AS second {_LINES}")
def nested_select_multilevel(spark, d):
    change = {"o_orderkey": None, "lines!.number": None, "lines!.flags!": lambda root, line, flag: F.concat_ws("-", flag, line["number"].cast("string"), root["o_orderkey"].cast("string"))}
    out = nested.select(orders_nested(spark, d), change).select("o_orderkey", F.inline("lines"))
    return out.select("o_orderkey", "number", F.col("flags")[0].alias("first"), F.col("flags")[1].alias("second"))


@query(f"SELECT o_orderkey, o_orderstatus, c_name AS name, c_nationkey AS nation, 7 AS seven, l_linenumber * 100 AS number, l_partkey AS part, l_quantity AS quantity, l_linenumber + l_partkey AS both_ {_LINES}")
def nested_with_fields(spark, d):
    out = nested.with_fields(orders_nested(spark, d), {"customer.seven": F.lit(7), "lines!.number": lambda x: x["number"] * 100, "lines!.both_": lambda x: x["number"] + x["part"]})
    return out.select("o_orderkey", "o_orderstatus", "customer.*", F.inline("lines")).drop("flags")


@query(f"SELECT o_orderkey, lower(o_orderstatus) AS o_orderstatus, lower(c_name) AS name, l_linenumber AS number, lower(l_returnflag) AS flag {_LINES}")
def nested_transform_all(spark, d):
    out = tr.transform_all_fields(orders_nested(spark, d), lambda c, kind: F.lower(c) if kind.simpleString() == "string" else None)
    return out.select("o_orderkey", "o_orderstatus", F.col("customer.name").alias("name"), F.explode("lines").alias("x")).select("o_orderkey", "o_orderstatus", "name", "x.number", F.col("x.flags")[0].alias("flag"))


@query("SELECT o_orderkey, c_name, CASE WHEN n IS NULL THEN -1 ELSE n END AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def build_identity(spark, d):
    df = orders_nested(spark, d)
    out = df.select(*nested.build_from_schema(df.schema, lambda c, kind: c, rename=lambda n: n + "_"))
    return out.select(F.col("o_orderkey_").alias("o_orderkey"), F.col("customer_.name_").alias("c_name"), F.coalesce(F.size("lines_").cast("bigint"), F.lit(-1)).alias("n"))


@query(f"SELECT o_orderkey, l_partkey AS lines__ARRAY____STRUCT__part {_LINES}")
def unnest_field(spark, d):
    return nested.unnest_field(orders_nested(spark, d), "lines!.part", ["o_orderkey"])


@query("SELECT o_orderkey, o_orderstatus, c_name AS customer__STRUCT__name, c_nationkey AS customer__STRUCT__nation FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def unnest_all_root(spark, d):
    return nested.unnest_all_fields(orders_nested(spark, d), ["o_orderkey"])[""]


@query(f"SELECT o_orderkey, l_linenumber AS lines__ARRAY____STRUCT__number, l_partkey AS lines__ARRAY____STRUCT__part, l_quantity AS lines__ARRAY____STRUCT__quantity {_LINES}")
def unnest_all_lines(spark, d):
    return nested.unnest_all_fields(orders_nested(spark, d), ["o_orderkey"])["lines!"]


@query(f"SELECT o_orderkey, unnest([l_returnflag, l_linestatus]) AS lines__ARRAY____STRUCT__flags__ARRAY__ {_LINES}")
def unnest_all_flags(spark, d):
    return nested.unnest_all_fields(orders_nested(spark, d), ["o_orderkey"])["lines!.flags!"]


# Transformations.


@query("SELECT o_orderkey, o_orderstatus, c_name AS customer_name, c_nationkey AS customer_nation FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def flatten_structs(spark, d):
    return tr.flatten(orders_nested(spark, d)).drop("lines")


@query("SELECT c_acctbal, c_custkey, c_mktsegment, c_name, c_nationkey FROM customer")
def sort_columns(spark, d):
    return tr.sort_columns(load(spark, d, "customer"))


@query("SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS lines FROM lineitem GROUP BY 1")
def sort_all_arrays(spark, d):
    df = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey")).alias("x"))
    text = F.transform("x", lambda s: F.concat_ws(":", s["l_linenumber"].cast("string"), s["l_partkey"].cast("string")))
    return tr.sort_all_arrays(df).select("l_orderkey", F.array_join(text, ",").alias("lines"))


def _harmonized(spark, d):
    left = load(spark, d, "nation").select("n_nationkey", F.struct(F.col("n_regionkey").alias("k"), "n_name").alias("s"), F.lit(1).alias("extra"))
    right = load(spark, d, "nation").select(F.col("n_nationkey").cast("double").alias("n_nationkey"), F.struct(F.col("n_regionkey").cast("string").alias("k"), "n_name").alias("s"), F.array("n_name").alias("names"))
    return tr.harmonize_dataframes(left, right)


@query("SELECT CAST(n_nationkey AS DOUBLE) AS n_nationkey, CAST(n_regionkey AS VARCHAR) AS k, n_name FROM nation")
def harmonize_left(spark, d):
    return _harmonized(spark, d)[0].select("n_nationkey", "s.*")


@query("SELECT CAST(n_nationkey AS DOUBLE) AS n_nationkey, CAST(n_regionkey AS VARCHAR) AS k, n_name FROM nation")
def harmonize_right(spark, d):
    return _harmonized(spark, d)[1].select("n_nationkey", "s.*")


# Profiles.


def _analyze_sql(table: str, columns: list[tuple[int, str, str, str]], group: str = "") -> str:
    head = f"{group} AS g, " if group else ""
    tail = f" GROUP BY {group}" if group else ""
    return " UNION ALL ".join(
        f"SELECT {head}{n} AS column_number, '{name}' AS column_name, '{kind}' AS column_type, count(*) AS count, count(DISTINCT {c}) AS count_distinct, count(*) - count({c}) AS count_null, "
        f"CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max FROM {table}{tail}"
        for n, name, kind, c in columns
    )


_ORDERS = [(0, "o_orderkey", "INTEGER"), (1, "o_custkey", "INTEGER"), (2, "o_orderstatus", "STRING"), (3, "o_totalprice", "FLOAT"), (4, "o_orderdate", "DATETIME"), (5, "o_orderpriority", "STRING")]


@query(_analyze_sql("orders", [(n, c, k, c) for n, c, k in _ORDERS]))
def analyze_orders(spark, d):
    return profile.analyze(load(spark, d, "orders"), verbose=False).drop("approx_top_100")


@query(_analyze_sql("orders", [(n, c, k, c) for n, c, k in _ORDERS if n not in (2,)], "o_orderstatus"))
def analyze_grouped(spark, d):
    out = profile.analyze(load(spark, d, "orders"), group_by="o_orderstatus", verbose=False)
    return out.select(F.col("group.o_orderstatus").alias("g"), *[c for c in out.columns if c not in ("group", "approx_top_100")])


_NESTED_ROOT = "(SELECT o_orderkey, o_orderstatus, c_name, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"


@query(
    _analyze_sql(_NESTED_ROOT, [(0, "o_orderkey", "INTEGER", "o_orderkey"), (1, "o_orderstatus", "STRING", "o_orderstatus"), (2, "customer.name", "STRING", "c_name"), (3, "customer.nation", "INTEGER", "c_nationkey")])
    + " UNION ALL "
    + _analyze_sql(f"(SELECT * {_LINES})", [(4, "lines!.number", "INTEGER", "l_linenumber"), (5, "lines!.part", "INTEGER", "l_partkey"), (6, "lines!.quantity", "FLOAT", "l_quantity")])
    + " UNION ALL "
    + _analyze_sql(f"(SELECT unnest([l_returnflag, l_linestatus]) AS x {_LINES})", [(7, "lines!.flags!", "STRING", "x")])
)
def analyze_nested(spark, d):
    return profile.analyze(orders_nested(spark, d), verbose=False).drop("approx_top_100")


@query(
    " UNION ALL ".join(
        f"SELECT * FROM (SELECT {n} AS column_number, CAST({c} AS VARCHAR) AS value, count(*) AS count FROM orders GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 100)" for n, c, _ in _ORDERS
    )
)
def analyze_top_values(spark, d):
    return profile.analyze(load(spark, d, "orders"), verbose=False).select("column_number", F.inline("approx_top_100"))


@query(
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS count, count(DISTINCT {c}) AS count_distinct, CAST(max({c}) AS VARCHAR) AS max, CAST(sum(length(CAST({c} AS VARCHAR))) AS BIGINT) AS chars FROM nation" for c in ("n_nationkey", "n_name", "n_regionkey"))
)
def analyze_custom_aggs(spark, d):
    def chars(col, field, number):
        return F.sum(F.length(F.col(col).cast("string"))).alias("chars")

    return profile.analyze(load(spark, d, "nation"), _aggs=[profile.column_name, profile.count, profile.count_distinct, profile.max, chars], verbose=False)


# Diff.


def _changed_orders(spark, d):
    right = load(spark, d, "orders").filter("o_orderkey % 97 <> 0")
    return load(spark, d, "orders"), right.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 10 == 0, "CHANGED").otherwise(F.col("o_orderpriority")))


_CHANGED = "(SELECT * REPLACE (CASE WHEN o_orderkey % 10 = 0 THEN 'CHANGED' ELSE o_orderpriority END AS o_orderpriority) FROM orders WHERE o_orderkey % 97 <> 0)"
_DIFFED = f"orders l FULL JOIN {_CHANGED} r ON l.o_orderkey = r.o_orderkey"


def _stats_frame(spark, result: DiffResult):
    rows = [(k, s.total, s.no_change, s.changed, s.in_left, s.in_right, s.only_in_left, s.only_in_right) for k, s in result.diff_stats_shards.items()]
    result.close()
    return spark.createDataFrame(rows, "level string, total bigint, no_change bigint, changed bigint, in_left bigint, in_right bigint, only_in_left bigint, only_in_right bigint")


@query("SELECT '' AS level, count(*) AS total, count(*) AS no_change, 0::BIGINT AS changed, count(*) AS in_left, count(*) AS in_right, 0::BIGINT AS only_in_left, 0::BIGINT AS only_in_right FROM orders")
def diff_stats_same(spark, d):
    return _stats_frame(spark, compare_dataframes(load(spark, d, "orders"), load(spark, d, "orders").repartition(3)))


@query(
    "SELECT '' AS level, count(*) AS total, count(CASE WHEN l.o_orderpriority = r.o_orderpriority THEN 1 END) AS no_change, count(CASE WHEN l.o_orderpriority <> r.o_orderpriority THEN 1 END) AS changed, count(l.o_orderkey) AS in_left, count(r.o_orderkey) AS in_right, "
    f"count(CASE WHEN r.o_orderkey IS NULL THEN 1 END) AS only_in_left, count(CASE WHEN l.o_orderkey IS NULL THEN 1 END) AS only_in_right FROM {_DIFFED}"
)
def diff_stats_changed(spark, d):
    left, right = _changed_orders(spark, d)
    return _stats_frame(spark, compare_dataframes(left, right, ["o_orderkey"]))


@query(
    f"SELECT l.o_orderkey AS left_key, r.o_orderkey AS right_key, l.o_orderpriority IS NOT DISTINCT FROM r.o_orderpriority AND l.o_orderkey IS NOT NULL AND r.o_orderkey IS NOT NULL AS is_equal FROM {_DIFFED}"
)
def diff_rows(spark, d):
    left, right = _changed_orders(spark, d)
    return build_diff(left, right, ["o_orderkey"]).select(F.col("o_orderkey.left_value").alias("left_key"), F.col("o_orderkey.right_value").alias("right_key"), F.col("__IS_EQUAL__").alias("is_equal"))


@query(
    "SELECT state, left_value, right_value, count(*) AS nb FROM (SELECT CASE WHEN r.o_orderkey IS NULL THEN 'only_in_left' WHEN l.o_orderpriority = r.o_orderpriority THEN 'no_change' ELSE 'changed' END AS state, "
    f"l.o_orderpriority AS left_value, r.o_orderpriority AS right_value FROM {_DIFFED}) GROUP BY ALL"
)
def diff_top_per_col(spark, d):
    left, right = _changed_orders(spark, d)
    return compare_dataframes(left, right, ["o_orderkey"]).top_per_col_state_df.filter("column_name = 'o_orderpriority'").select("state", "left_value", "right_value", "nb")


@query(
    " UNION ALL ".join(
        f"SELECT {n} AS column_number, '{c}' AS column_name, count(*) AS total, count(CASE WHEN l.{c} <> r.{c} THEN 1 END) AS changed, count(CASE WHEN l.{c} = r.{c} THEN 1 END) AS no_change, count(CASE WHEN r.o_orderkey IS NULL THEN 1 END) AS only_in_left, count(CASE WHEN l.o_orderkey IS NULL THEN 1 END) AS only_in_right FROM {_DIFFED}"
        for n, c, _ in _ORDERS
    )
)
def diff_per_col_counts(spark, d):
    left, right = _changed_orders(spark, d)
    return compare_dataframes(left, right, ["o_orderkey"]).get_diff_per_col_df(5).select("column_number", "column_name", "counts.*")


@query(
    "SELECT a.k1 AS left_k, b.k1 AS right_k, a.n IS NOT DISTINCT FROM b.n AND a.present AND b.present AS is_equal FROM (SELECT nullif(n_regionkey, 1) AS k1, n_nationkey AS k2, n_name AS n, true AS present FROM nation) a "
    "FULL JOIN (SELECT nullif(n_regionkey, 1) AS k1, n_nationkey AS k2, CASE WHEN n_nationkey % 5 = 0 THEN 'x' ELSE n_name END AS n, true AS present FROM nation) b ON a.k1 IS NOT DISTINCT FROM b.k1 AND a.k2 = b.k2"
)
def diff_null_keys(spark, d):
    left = load(spark, d, "nation").select(F.expr("nullif(n_regionkey, 1) AS k1"), F.col("n_nationkey").alias("k2"), F.col("n_name").alias("n"))
    right = left.withColumn("n", F.when(F.col("k2") % 5 == 0, "x").otherwise(F.col("n")))
    return build_diff(left, right, ["k1", "k2"]).select(F.col("k1.left_value").alias("left_k"), F.col("k1.right_value").alias("right_k"), F.col("__IS_EQUAL__").alias("is_equal"))


@query("SELECT 'l_orderkey' AS k, round(CAST(sum(n * n) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 2) AS growth FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) UNION ALL SELECT 'o_orderkey', 1.0::DOUBLE")
def diff_growth(spark, d):
    rows = [("l_orderkey", growth_estimate(load(spark, d, "lineitem"), ["l_orderkey"])), ("o_orderkey", growth_estimate(load(spark, d, "orders"), ["o_orderkey"]))]
    return spark.createDataFrame(rows, "k string, growth double")


def _lines_by_order(spark, d):
    """Orders with their lines and with what becomes of these, from one shuffle: by order, which also keeps a line's rows together."""
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity").repartition("l_orderkey")
    line = rows.groupBy("l_orderkey", "l_partkey", "l_suppkey").agg(F.max("l_quantity").alias("q"))
    key = F.concat_ws("-", "l_partkey", "l_suppkey").alias("id")
    changed = F.struct(key, F.when(F.col("l_partkey") % 7 == 0, F.col("q") + 1).otherwise(F.col("q")).alias("q"))
    return line.groupBy("l_orderkey").agg(F.collect_list(F.struct(key, "q")).alias("lines"), F.collect_list(F.when(F.col("l_partkey") % 11 != 0, changed)).alias("changed"))


def _two_line_tables(orders):
    return orders.select("l_orderkey", "lines"), orders.select("l_orderkey", F.col("changed").alias("lines")).filter(F.size("lines") > 0)


_LINE_KEYS = "(SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem GROUP BY ALL)"


@query(
    f"SELECT 'lines!' AS level, count(*) AS total, count(CASE WHEN l_partkey % 11 <> 0 AND l_partkey % 7 <> 0 THEN 1 END) AS no_change, count(CASE WHEN l_partkey % 11 <> 0 AND l_partkey % 7 = 0 THEN 1 END) AS changed, count(*) AS in_left, count(CASE WHEN l_partkey % 11 <> 0 THEN 1 END) AS in_right, count(CASE WHEN l_partkey % 11 = 0 THEN 1 END) AS only_in_left, 0::BIGINT AS only_in_right FROM {_LINE_KEYS} "
    f"UNION ALL SELECT '', count(*), count(CASE WHEN n > 0 THEN 1 END), 0, count(*), count(CASE WHEN n > 0 THEN 1 END), count(CASE WHEN n = 0 THEN 1 END), 0 FROM (SELECT l_orderkey, count(CASE WHEN l_partkey % 11 <> 0 THEN 1 END) AS n FROM {_LINE_KEYS} GROUP BY 1)"
)
def diff_granular_lines(spark, d):
    orders = cut(_lines_by_order(spark, d), "lines")
    try:
        return _stats_frame(spark, compare_dataframes(*_two_line_tables(orders), ["l_orderkey", "lines!.id"]))
    finally:
        drop_path(spark, orders)


# Graph and sinks.


@query()
def graph_components(spark, d):
    line = load(spark, d, "lineitem")
    return connected_components(line.select((F.col("l_partkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b")))


@query("SELECT * FROM nation WHERE n_regionkey < 3 UNION ALL SELECT * FROM nation WHERE n_regionkey = 3")
def write_overwrite_append_roundtrip(spark, d):
    path = new_path(spark, "written")
    nation = load(spark, d, "nation")
    Writer(nation).mode("overwrite").save(path)
    Writer(nation.filter("n_regionkey < 3")).mode("overwrite").save(path)
    Writer(nation.filter("n_regionkey = 3")).mode("append").save(path)
    Writer(nation).mode("ignore").save(path)
    return Session(spark).table(path)


# Actions, texts and names: what is not a table is told as one.


def _lines(spark, text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text.rstrip("\n").split("\n"))), "line bigint, said string")


def _said(*lines: str) -> str:
    """SQL of numbered lines."""
    rows = ", ".join(f"({i}, '{x.replace(chr(39), chr(39) * 2)}')" for i, x in enumerate(lines))
    return f"SELECT CAST(line AS BIGINT) AS line, said FROM (VALUES {rows}) t(line, said)"


def _refused(error: type[Exception], run: Callable) -> bool:
    try:
        run()
    except error:
        return True
    return False


@query("SELECT 'collect' AS action, count(*) AS n FROM nation UNION ALL SELECT 'count', count(*) FROM nation UNION ALL SELECT 'iterator', sum(n_nationkey)::BIGINT FROM nation UNION ALL SELECT 'take', 3 UNION ALL SELECT 'pandas', count(*) FROM nation")
def actions(spark, d):
    df = load(spark, d, "nation")
    rows = [("collect", len(df.collect())), ("count", df.count()), ("iterator", sum(r.n_nationkey for r in df.toLocalIterator())), ("take", len(df.take(3))), ("pandas", len(df.toPandas()))]
    return spark.createDataFrame(rows, "action string, n bigint")


@query(_said("+-------------+---------+", "| r_regionkey |  r_name |", "+-------------+---------+", "|           0 |  AFRICA |", "|           1 | AMERICA |", "+-------------+---------+", "only showing top 2 rows"))
def show_text(spark, d):
    return _lines(spark, frame.show_string(load(spark, d, "region").orderBy("r_regionkey"), 2))


@query(_said("root", " |-- r_regionkey: INTEGER (NULLABLE)", " |-- r_name: STRING (NULLABLE)", "r_regionkey:INTEGER,r_name:STRING"))
def schema_texts(spark, d):
    schema = load(spark, d, "region").schema
    return _lines(spark, tree_string(schema).rstrip("\n") + "\n" + simple_string(schema))


@query("SELECT * FROM (VALUES ('alias', 'x'), ('none', NULL), ('bool', 'true'), ('generator', 'true'), ('transform', '25'), ('quoted', 'a.b')) t(name, said)")
def column_rules(spark, d):
    nation = load(spark, d, "nation")
    dotted = nation.select(F.col("n_name").alias("a.b"))
    rows = [
        ("alias", f.get_alias(F.col("n_name").alias("x"))),
        ("none", f.get_alias(F.col("n_name"))),
        ("bool", str(_refused(Exception, lambda: bool(F.col("n_name") == "x"))).lower()),
        ("generator", str(_refused(Exception, lambda: nation.select(F.explode(F.array("n_name")) + F.lit(1)).collect())).lower()),
        ("transform", str(nation.transform(lambda x: x.select("n_name")).count())),
        ("quoted", dotted.select(nested.quoted("a.b")).columns[0]),
    ]
    return spark.createDataFrame(rows, "name string, said string")


@query("SELECT * FROM (VALUES (1::BIGINT, 'a'), (2, NULL)) t(id, name)")
def inline_rows(spark, d):
    return Session(spark).rows([(1, "a"), (2, None)], "id bigint, name string")


@query("SELECT a.n_name AS a_name, b.r_name AS b_name FROM nation a JOIN region b ON a.n_regionkey < b.r_regionkey AND length(a.n_name) > length(b.r_name)")
def join_theta_only(spark, d):
    a, b = load(spark, d, "nation"), load(spark, d, "region")
    on = [F.col("n_regionkey") < F.col("r_regionkey"), F.length("n_name") > F.length("r_name")]
    return frame.join(a, b, on).select(F.col("n_name").alias("a_name"), F.col("r_name").alias("b_name"))


# Aggregates and pivots that need names, or are held against exact ones.


@query("SELECT l_returnflag, count(CASE WHEN l_discount = 0.05 THEN 1 END) AS n_five, count(CASE WHEN l_discount = 0.1 THEN 1 END) AS n_ten FROM lineitem GROUP BY 1")
def pivot_aliased_values(spark, d):
    grouped = group_by(load(spark, d, "lineitem"), "l_returnflag").pivot("l_discount", [F.lit(0.05).alias("five"), F.lit(0.1).alias("ten")])
    out = grouped.agg(F.count("l_orderkey").alias("n"))
    return out.select("l_returnflag", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_five", "n_ten")])


@query("SELECT o_custkey, list(p ORDER BY latest DESC, p) AS priorities FROM (SELECT o_custkey, o_orderpriority AS p, max(o_orderdate) AS latest FROM orders GROUP BY 1, 2) GROUP BY 1")
def agg_array_agg_distinct_by_other(spark, d):
    latest = f.array_agg("o_orderpriority", order_by=[F.col("o_orderdate").desc(), F.col("o_orderpriority").asc()], distinct=True)
    return load(spark, d, "orders").groupBy("o_custkey").agg(latest.alias("priorities"))


@query("SELECT 'lineitem' AS name, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity FROM lineitem)) AS hashes UNION ALL SELECT 'orders', count(DISTINCT o_orderpriority) FROM orders")
def fn_hash_tells_rows_apart(spark, d):
    line = load(spark, d, "lineitem").select(F.lit("lineitem").alias("name"), f.hash("l_orderkey", "l_linenumber", "l_quantity").alias("h"))
    both = line.unionByName(load(spark, d, "orders").select(F.lit("orders").alias("name"), f.hash("o_orderpriority").alias("h")))
    return both.groupBy("name").agg(F.count_distinct("h").alias("hashes"))


@query("SELECT * FROM (VALUES ('', ''), ('f', 'MY======'), ('fo', 'MZXQ===='), ('foo', 'MZXW6==='), ('foob', 'MZXW6YQ='), ('fooba', 'MZXW6YTB'), ('foobar', 'MZXW6YTBOI======'), (NULL, NULL)) t(plain, coded)")
def fn_base32_known(spark, d):
    words = spark.createDataFrame([(x,) for x in ("", "f", "fo", "foo", "foob", "fooba", "foobar", None)], "plain string")
    return words.select("plain", f.to_base32(F.col("plain").cast("binary")).alias("coded"))


@query("SELECT 'l_orderkey' AS name, true AS near UNION ALL SELECT 'l_partkey', true UNION ALL SELECT 'l_returnflag', true")
def agg_approx_distinct_near(spark, d):
    line, names = load(spark, d, "lineitem"), ("l_orderkey", "l_partkey", "l_returnflag")
    # Beside distinct aggregates Spark would keep every sketch once for each distinct value; so each exact count is a frame of its own.
    sides = line.agg(*[F.approx_count_distinct(n, 0.02).alias(f"a_{n}") for n in names])
    for n in names:
        sides = sides.crossJoin(line.select(n).distinct().agg(F.count(n).alias(f"e_{n}")))
    return sides.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), (F.abs(F.col(f"a_{n}") - F.col(f"e_{n}")) <= 0.08 * F.col(f"e_{n}")).alias("near")) for n in names])))


@query("SELECT n_regionkey AS item, count(*) AS count FROM nation GROUP BY 1")
def agg_approx_top_few(spark, d):
    top = load(spark, d, "nation").agg(f.approx_top_count("n_regionkey", 10).alias("top"))
    return top.select(F.inline("top"))


# Nested fields: rules and former names.


@query("SELECT * FROM (VALUES ('lambda on nothing', true), ('no such field', true), ('! before a name', true)) t(name, refused)")
def nested_rules(spark, d):
    df = orders_nested(spark, d)
    rows = [
        ("lambda on nothing", _refused(Exception, lambda: nested.select(df, {"no_such!": lambda x: x}).collect())),
        ("no such field", _refused(Exception, lambda: nested.select(df, {"customer.no_such": None}).collect())),
        ("! before a name", _refused(ValueError, lambda: paths.steps("a!b"))),
    ]
    return spark.createDataFrame(rows, "name string, refused boolean")


@query(
    "SELECT * FROM (VALUES ('a!.b', 'a!', 'sub', true), ('a!.b', 'a', 'sub', true), ('ab', 'a', 'sub', false), ('a', 'a', 'sub', false), ('a', 'a', 'equal', true), ('a', 'a!.b', 'parent', true), ('a!.b', 'a!.c', 'granularity', true), ('a!.b', 'c', 'granularity', false)) t(path, of, rule, holds)"
)
def path_rules(spark, d):
    rules = {"sub": paths.is_sub_field, "equal": paths.is_sub_field_or_equal, "parent": paths.is_parent_field, "granularity": paths.same_granularity}
    asked = [("a!.b", "a!", "sub"), ("a!.b", "a", "sub"), ("ab", "a", "sub"), ("a", "a", "sub"), ("a", "a", "equal"), ("a", "a!.b", "parent"), ("a!.b", "a!.c", "granularity"), ("a!.b", "c", "granularity")]
    return spark.createDataFrame([(*x, rules[x[2]](x[0], x[1])) for x in asked], "path string, of string, rule string, holds boolean")


@query("SELECT o_orderkey, c_name AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def nested_former_names(spark, d):
    return nested.select_nested_columns(orders_nested(spark, d), {"o_orderkey": None, "name": lambda s: s["customer"]["name"]})


@query("SELECT * FROM (VALUES ('n_nationkey', 'bigint'), ('n_name', 'same')) t(name, kind)")
def common_columns(spark, d):
    nation = load(spark, d, "nation")
    other = nation.select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name", F.lit(1).alias("more"))
    found = tr.get_common_columns(nation.schema, other.schema)
    return spark.createDataFrame([(k, "same" if v is None else v.simpleString()) for k, v in found.items()], "name string, kind string")


@query("SELECT n_regionkey, list(n_name ORDER BY n_name) AS names FROM nation GROUP BY 1")
def normalized_arrays(spark, d):
    return tr.normalize_arrays(load(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("names")))


# Diffs: schemas, guards, value lists, flags and reports.


@query(_said("True", "-n_regionkey INTEGER", "+n_regionkey STRING", "+more STRING", "3"))
def diff_schema_lines(spark, d):
    nation = load(spark, d, "nation")
    found = diff_schemas(nation.schema, nation.withColumn("n_regionkey", F.col("n_regionkey").cast("string")).withColumn("more", F.lit("x")).schema, ["n_nationkey"])
    changed = [x for x in found.diff_str.split("\n") if x[:1] in "+-"]
    return _lines(spark, "\n".join([str(not found.same_schema), *changed, str(found.nb_cols)]))


@query("SELECT 'n_regionkey' AS keys, true AS refused UNION ALL SELECT 'n_nationkey', false")
def diff_guard(spark, d):
    nation = load(spark, d, "nation")
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        rows = [(k, _refused(CombinatorialExplosionError, lambda k=k: compare_dataframes(nation, nation, [k]))) for k in ("n_regionkey", "n_nationkey")]
    return spark.createDataFrame(rows, "keys string, refused boolean")


_NATIONS = "(SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey <> 3) l FULL JOIN (SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN n_regionkey + 10 ELSE n_regionkey END AS n_regionkey FROM nation WHERE n_nationkey <> 5) r ON l.n_nationkey = r.n_nationkey"


def _changed_nations(spark, d) -> DiffResult:
    nation = load(spark, d, "nation").select("n_nationkey", "n_regionkey")
    right = nation.filter("n_nationkey <> 5").withColumn("n_regionkey", F.when(F.col("n_nationkey") % 4 == 0, F.col("n_regionkey") + 10).otherwise(F.col("n_regionkey")))
    with contextlib.redirect_stdout(io.StringIO()):
        return compare_dataframes(nation.filter("n_nationkey <> 3"), right, ["n_nationkey"])


@query(
    f"WITH c AS (SELECT CASE WHEN l.n_nationkey IS NULL THEN 'only_in_right' WHEN r.n_nationkey IS NULL THEN 'only_in_left' WHEN l.n_regionkey = r.n_regionkey THEN 'no_change' ELSE 'changed' END AS state, "
    f"CAST(l.n_regionkey AS VARCHAR) AS left_value, CAST(r.n_regionkey AS VARCHAR) AS right_value, count(*) AS nb FROM {_NATIONS} GROUP BY ALL), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY nb DESC, left_value, right_value) AS row_num FROM c) SELECT state, left_value, right_value, nb FROM n WHERE row_num <= 3"
)
def diff_value_lists(spark, d):
    row = _changed_nations(spark, d).get_diff_per_col_df(3).filter("column_name = 'n_regionkey'")
    value, none = F.col("x.value"), F.lit(None).cast("string")
    parts = [row.select(F.explode("diff.changed").alias("x")).select(F.lit("changed").alias("state"), "x.left_value", "x.right_value", "x.nb")]
    for state, left, right in (("no_change", value, value), ("only_in_left", value, none), ("only_in_right", none, value)):
        parts.append(row.select(F.explode(f"diff.{state}").alias("x")).select(F.lit(state).alias("state"), left.alias("left_value"), right.alias("right_value"), "x.nb"))
    return tr.union_dataframes(parts)


@query(
    f"SELECT state, CAST(row_num AS INTEGER) AS row_num, nb FROM (SELECT state, nb, row_number() OVER (PARTITION BY state ORDER BY nb DESC, a, b) AS row_num FROM (SELECT CASE WHEN l.n_nationkey IS NULL THEN 'only_in_right' WHEN r.n_nationkey IS NULL THEN 'only_in_left' WHEN l.n_regionkey = r.n_regionkey THEN 'no_change' ELSE 'changed' END AS state, "
    f"CAST(l.n_regionkey AS VARCHAR) AS a, CAST(r.n_regionkey AS VARCHAR) AS b, count(*) AS nb FROM {_NATIONS} GROUP BY ALL))"
)
def diff_ranks(spark, d):
    return _changed_nations(spark, d).top_per_col_state_df.filter("column_name = 'n_regionkey'").select("state", "row_num", "nb")


@query("SELECT true AS same_schema, false AS same_data, false AS is_ok, count(*) AS total FROM nation")
def diff_flags(spark, d):
    found = _changed_nations(spark, d)
    return spark.createDataFrame([(found.same_schema, found.same_data, found.is_ok, found.total_nb_rows)], "same_schema boolean, same_data boolean, is_ok boolean, total bigint")


@query("SELECT 'console' AS report, true AS told UNION ALL SELECT 'html', true UNION ALL SELECT 'command', true")
def diff_reports(spark, d):
    from terrane.cli import diff as command

    found, said = _changed_nations(spark, d), io.StringIO()
    with contextlib.redirect_stdout(said), tempfile.TemporaryDirectory() as folder:  # reports are files of the driver
        found.display(show_examples=True)
        text = said.getvalue()
        page, other = os.path.join(folder, "a.html"), os.path.join(folder, "b.html")
        found.export_to_html(output_file_path=page, diff_format_options=DiffFormatOptions(nb_diffed_rows=2))
        command.main(["--tables", f"{d}/nation.parquet", f"{d}/nation.parquet", "--join-cols", "n_nationkey", "--output", other])
        pages = [open(x, encoding="utf-8").read() for x in (page, other)]  # noqa: SIM115
    rows = [("console", "diff NOT ok" in text and "n_regionkey" in text), ("html", "n_regionkey" in pages[0]), ("command", "n_nationkey" in pages[1])]
    return spark.createDataFrame(rows, "report string, told boolean")


# Star steps on whole tables, and a writer's table.


@query(
    "SELECT o_orderkey * 1000 + 77 AS node_id, CAST(c_nationkey AS BIGINT) AS connected_component_id FROM orders JOIN customer ON o_custkey = c_custkey "
    "UNION ALL SELECT c_custkey * 1000 + 50, c_nationkey FROM customer UNION ALL SELECT DISTINCT CAST(c_nationkey AS BIGINT), CAST(c_nationkey AS BIGINT) FROM customer"
)
def graph_components_tree(spark, d):
    """Orders hang on customers and these on nations: the star steps alone, over whole tables."""
    customer = load(spark, d, "customer")
    edges = customer.select((F.col("c_custkey") * 1000 + 50).alias("a"), F.col("c_nationkey").cast("bigint").alias("b"))
    orders = load(spark, d, "orders").join(customer.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return connected_components(edges.unionByName(orders.select((F.col("o_orderkey") * 1000 + 77).alias("a"), (F.col("o_custkey") * 1000 + 50).alias("b"))), local_edges=0)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 1")
def write_table_partitioned(spark, d):
    nation = load(spark, d, "nation")
    name = f"terrane_written_{uuid.uuid4().hex}"  # a folder left by another session would be in the way
    Writer(nation).mode("overwrite").partition_by("n_regionkey").options(description="nations", compression="gzip").save(name)
    Writer(nation.filter("n_regionkey = 1")).mode("append").save(name)
    if not _refused(Exception, lambda: Writer(nation).save(name)):
        raise AnalysisException("an existing table was written over")
    return Session(spark).table(name).select("n_nationkey", "n_name", "n_regionkey")
