import os
import pytest

from terrane.session import cut, drop_path, shared_dir
from terrane.sources import Session, Writer


def test_writer_modes_on_paths_and_tables(spark, tmp_path):
    a, b = spark.createDataFrame([(1,)], "a bigint"), spark.createDataFrame([(2, "x")], "a bigint, b string")
    for table in (str(tmp_path / "t"), "terrane_written"):
        read = Session(spark).table
        Writer(a).save(table)
        with pytest.raises(Exception, match="exist"):
            Writer(a).mode("error").save(table)
        with pytest.raises(Exception, match="exist"):
            Writer(a).save(table, mode="errorifexists")
        Writer(a).mode("append").save(table)
        assert read(table).count() == 2
        Writer(b).mode("IGNORE").save(table)
        assert read(table).columns == ["a"]
        Writer(b).mode("overwrite").options(description="it's", labels="x").save(table) if "/" not in table else Writer(b).mode("overwrite").save(table)
        assert read(table).collect() == [(2, "x")]
    assert "it's" in str(spark.sql("SHOW TBLPROPERTIES terrane_written").collect())
    spark.sql("DROP TABLE terrane_written")
    with pytest.raises(ValueError, match="unknown mode"):
        Writer(a).mode("sideways")


def test_partitions_and_statement(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "a bigint, day string")
    Writer(df).partition_by("day").save(str(tmp_path / "p"))
    assert sorted(x.name for x in (tmp_path / "p").iterdir() if x.is_dir()) == ["day=x", "day=y"]
    assert Writer(df).mode("overwrite").partition_by("day").options(description="d").compile("t") == "CREATE OR REPLACE TABLE t PARTITIONED BY (day) OPTIONS (description='d') AS SELECT * FROM {df}"
    assert Writer(df).mode("append").compile("t") == "INSERT INTO t SELECT * FROM {df}"


def test_views_temp_tables_stats(spark):
    s = Session(spark)
    df = s.rows([(1, "a"), (2, "b")], "id int, name string")
    s.create_or_replace_temp_view(df, "v")
    s.create_or_replace_temp_view(s.sql("SELECT id FROM v WHERE id > 1"), "v")
    assert s.sql("SELECT * FROM v").collect() == [(2,)]
    kept = s.create_or_replace_temp_table(df, "kept")
    assert s.table("kept").count() == 2 and kept.columns == ["id", "name"]
    assert s.stats.estimated_bytes > 0 and "estimated" in s.stats.human_readable() and s.size_of(df)


def test_cut_writes_to_the_shared_folder(spark):
    df = cut(spark.range(5))
    assert df.terrane_path.startswith(shared_dir(spark)) and df.count() == 5
    drop_path(spark, df)
    with pytest.raises(Exception):  # noqa: B017
        df.count()


def test_persisted_tables_are_released(spark):
    from terrane.sources import persist, release

    kept = persist(spark.range(5).toDF("x"))
    where = kept.terrane_path.replace("file://", "").replace("file:", "")
    assert kept.count() == 5 and os.path.isdir(where)
    release(kept)
    assert not os.path.exists(where)


def test_query_cache_and_bytes_read(spark, tmp_path):
    spark.range(200_000).write.parquet(str(tmp_path / "t"))
    session = Session(spark, use_query_cache=True)
    query = f"SELECT sum(id) AS s FROM parquet.`{tmp_path}/t`"
    assert session.sql(query) is session.sql(query) and session.sql(query).first().s == 19_999_900_000
    assert session.sql("SELECT * FROM {x}", x=spark.range(2)) is not session.sql("SELECT * FROM {x}", x=spark.range(2))
    assert session.stats.processed_bytes > 0 and "read so far" in session.stats.human_readable()
    session.clear_query_cache()
    assert Session(spark).sql(query) is not Session(spark).sql(query)


def test_written_intermediates_leave_the_setting_as_it_was(spark):
    from terrane.session import SHUFFLE_CLEANUP

    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    rows = spark.range(100).selectExpr("id % 7 AS k").groupBy("k").count()
    kept = cut(rows, "seven")
    assert spark.conf.get(SHUFFLE_CLEANUP) == before and kept.count() == 7 and kept.count() == rows.count()
    drop_path(spark, kept)
