"""A session over a SparkSession: SQL, tables, views, written temporary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrane.operators.frame import estimated_bytes, human_bytes
from terrane.session import cut, drop_path


class Stats:
    """Bytes that the optimizer expected the session's queries to read, and bytes that all tasks have read since it began."""

    def __init__(self, spark: SparkSession | None = None) -> None:
        self.estimated_bytes, self.spark = 0, spark
        self._before = self._read()

    def _read(self) -> int:
        """Input bytes of all executors, as Spark's status store counts them when tasks end."""
        if self.spark is None:
            return 0
        found = self.spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(found.apply(i).totalInputBytes() for i in range(found.size()))

    @property
    def processed_bytes(self) -> int:
        return self._read() - self._before

    def add(self, df: DataFrame) -> None:
        self.estimated_bytes += sum(int(str(x.stats().sizeInBytes())) for x in _leaves(df))

    def human_readable(self) -> str:
        return f"estimated bytes read: {human_bytes(self.estimated_bytes)}" + (f"; read so far: {human_bytes(self.processed_bytes)}" if self.spark else "")


def _leaves(df: DataFrame) -> list:
    found = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return [found.apply(i) for i in range(found.size())]


class Session:
    """With ``use_query_cache`` a statement that is given again, with no tables of its own, gives the kept result of the first time."""

    def __init__(self, spark: SparkSession, use_query_cache: bool = False):
        self.spark, self.stats, self.use_query_cache = spark, Stats(spark), use_query_cache
        self._results: dict[str, DataFrame] = {}

    def sql(self, query: str, **tables: DataFrame) -> DataFrame:
        """Raw SQL; ``{name}`` stands for a DataFrame given by name."""
        cached = self.use_query_cache and not tables
        if cached and query in self._results:
            return self._results[query]
        df = self.spark.sql(query, **tables) if tables else self.spark.sql(query)
        self.stats.add(df)
        if cached:
            df = self._results[query] = df.persist()
        return df

    def clear_query_cache(self) -> None:
        for df in self._results.values():
            df.unpersist()
        self._results.clear()

    def table(self, name: str) -> DataFrame:
        """A catalogue table, or a path of Parquet files."""
        return self.spark.read.parquet(name) if "/" in name else self.spark.table(name)

    def rows(self, data: list, schema: str) -> DataFrame:
        return self.spark.createDataFrame(data, schema)

    def create_or_replace_temp_view(self, df: DataFrame, name: str) -> None:
        df.createOrReplaceTempView(name)

    def create_or_replace_temp_table(self, df: DataFrame, name: str) -> DataFrame:
        """Run now and kept in the shared folder, whatever executors are lost."""
        kept = persist(df)
        kept.createOrReplaceTempView(name)
        return kept

    def size_of(self, df: DataFrame) -> str:
        return human_bytes(estimated_bytes(df))


def persist(df: DataFrame) -> DataFrame:
    """A new DataFrame over the written result of this one; release() deletes it."""
    return cut(df, "persist")


def release(kept: DataFrame) -> None:
    """Delete what persist() or create_or_replace_temp_table() has written; the DataFrame cannot be read any more."""
    drop_path(kept.sparkSession, kept)
