"""Writing tables with modes, options and one level of partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: What to do if the table exists.
MODES = ("append", "overwrite", "error", "errorifexists", "ignore")


class Writer:
    """writer(df).mode("overwrite").partition_by("day").save("db.table")"""

    def __init__(self, df: DataFrame, mode: str = "error", partition: str | None = None, options: dict | None = None):
        self.df, self._mode, self._partition, self._options = df, mode, partition, dict(options or {})

    def _with(self, **changes) -> Writer:
        return Writer(**({"df": self.df, "mode": self._mode, "partition": self._partition, "options": self._options} | changes))

    def mode(self, mode: str) -> Writer:
        if mode.lower() not in MODES:
            raise ValueError(f"unknown mode '{mode}': use one of {', '.join(MODES)}")
        return self._with(mode=mode.lower())

    def options(self, **options) -> Writer:
        """``description`` and ``labels`` become table properties; others go to the file format."""
        return self._with(options=self._options | options)

    def partition_by(self, column: str) -> Writer:
        return self._with(partition=column)

    def compile(self, table: str) -> str:
        """The statement that ``save`` amounts to."""
        if self._mode == "append":
            return f"INSERT INTO {table} SELECT * FROM {{df}}"
        head = {"overwrite": "CREATE OR REPLACE TABLE", "ignore": "CREATE TABLE IF NOT EXISTS"}.get(self._mode, "CREATE TABLE")
        parts = [f"{head} {table}"]
        if self._partition:
            parts.append(f"PARTITIONED BY ({self._partition})")
        if self._options:
            parts.append("OPTIONS (" + ", ".join(f"{k}={v!r}" for k, v in sorted(self._options.items())) + ")")
        return " ".join([*parts, "AS SELECT * FROM {df}"])

    def save(self, table: str, mode: str | None = None, partition_by: str | None = None, **options) -> None:
        """To a catalogue table, or to Parquet files if the name is a path. Appending goes by position."""
        me = self._with(mode=(mode or self._mode).lower(), partition=partition_by or self._partition, options=self._options | options)
        me.mode(me._mode)
        about = {k: me._options.pop(k) for k in ("description", "labels") if k in me._options}
        spark = me.df.sparkSession
        kind = "error" if me._mode == "errorifexists" else me._mode
        if "/" in table:
            writer = me.df.write.mode(kind).options(**me._options)
            (writer.partitionBy(me._partition) if me._partition else writer).parquet(table)
            return
        exists = spark.catalog.tableExists(table)
        if kind == "append" and exists:
            me.df.write.insertInto(table)
            return
        if kind == "ignore" and exists:
            return
        writer = me.df.write.format("parquet").mode(kind).options(**me._options)
        (writer.partitionBy(me._partition) if me._partition else writer).saveAsTable(table)
        if about:
            pairs = ", ".join(f"'{k}' = '{str(v).replace(chr(39), chr(92) + chr(39))}'" for k, v in about.items())
            spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({pairs})")
