"""Exact dedup against a persistent digest index, bucketed and sorted by hash.

New data is reduced to one summary row per digest, told apart from known digests by sort-merge anti-join
against the index, and appended to it. The index is a bucketed table in the shared folder, so neither the join
nor the final aggregation shuffles it.

Cases. A null text counts as empty. Rows with equal texts and ids: exactly one stays. Ids are numbers or strings and
rank by their type's order, a null id after all others. An empty table gives an empty result; columns other than id and
text are passed on by exact_dedup and not read otherwise, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.common import SPACE, few, free_names, keep_without
from terrane.operators.skew import attach
from terrane.session import cut, drop_path, new_path, shuffles_removed


def digest_of(text: Column) -> Column:
    """SHA-256 of the text without white space, as bytes."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "").cast("binary"), 256))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, points, row): row tells repeated rows apart; cut() before using it twice."""
    return docs.select(
        F.col(f"`{id_col}`").alias("id"),
        digest_of(F.col(f"`{text_col}`")).alias("digest"),
        F.length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).cast("bigint").alias("points"),
        F.monotonically_increasing_id().alias("row"),
    )


def _best(rank: Column) -> Column:
    return F.min(rank).alias("best")


class DigestIndex:
    """Append-only table of digests. ``fresh`` rows are the index; the others record that a later load met them again."""

    def __init__(self, spark: SparkSession, path: str | None = None, name: str | None = None, buckets: int | None = None, id_type: str = "bigint"):
        self.spark = spark
        self.path = path or new_path(spark, "digest-index")
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or max(8, spark.sparkContext.defaultParallelism)
        self.loads = 0
        if path and not spark.catalog.tableExists(self.name) and self._exists():
            spark.sql(
                f"CREATE TABLE {self.name} (digest BINARY, load INT, fresh BOOLEAN, best STRUCT<less: BIGINT, "
                f"no_id: BOOLEAN, id: {id_type}, row: BIGINT>, rows BIGINT) USING parquet LOCATION '{self.path}' "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
            )
        if spark.catalog.tableExists(self.name):
            self.loads = (self.table().agg(F.max("load")).first()[0] or 0) + 1

    def _exists(self) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, prints: DataFrame) -> DataFrame:
        """Append a load of fingerprints(); its summary rows, ``fresh`` where the index did not know the digest."""
        summary = prints.groupBy("digest").agg(
            _best(F.struct((-F.col("points")).alias("less"), F.col("id").isNull().alias("no_id"), "id", "row")),
            F.count("*").alias("rows"),
        )
        summary = cut(summary, "digest-load")
        if self.loads:
            known = self.table().filter("fresh").select("digest").hint("merge")
            new = summary.join(known, "digest", "left_anti").withColumn("fresh", F.lit(True))
            old = summary.join(known, "digest", "left_semi").withColumn("fresh", F.lit(False))
            delta = cut(new.unionByName(old), "digest-delta")
        else:
            delta = summary.withColumn("fresh", F.lit(True))
        load = delta.select("digest", F.lit(self.loads).alias("load"), "fresh", "best", "rows")
        writer = load.repartition(self.buckets, "digest").coalesce(self.buckets).write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
        with shuffles_removed(self.spark):
            writer.option("path", self.path).format("parquet").saveAsTable(self.name)
        if self.loads:
            drop_path(self.spark, summary)
        self.loads += 1
        return load

    def resolve(self) -> DataFrame:
        """(digest, best, rows) over all loads, without a shuffle of the index."""
        return self.table().groupBy("digest").agg(_best(F.col("best")), F.sum("rows").alias("rows"))


    def drop(self) -> None:
        """Forget the table and delete its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        drop_path(self.spark, self.path)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", loads: int = 2) -> DataFrame:
    """Every row with the row that stays: (id, digest, points, row, best, rows), through an index of its own.

    The rows arrive in ``loads`` loads, split by digest-independent row hash, as new data would.
    """
    spark = docs.sparkSession
    prints = cut(fingerprints(docs, id_col, text_col), "fingerprints")
    index = DigestIndex(spark)
    for load in range(loads):
        index.add(prints.filter(F.pmod(F.xxhash64("row"), F.lit(loads)) == load))
    kept = cut(index.resolve(), "digest-groups")
    index.drop()
    return attach(prints, kept, "digest", "rows")


def _stays() -> Column:
    return F.col("best.row") == F.col("row")


def exact_dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: its keeper, the size of its group, and whether it stays."""
    return groups(docs, id_col, text_col).select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        F.col("rows").alias("group_size"),
        _stays().alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns kept."""
    spark = docs.sparkSession
    found = cut(groups(docs, id_col, text_col), "dedup-groups")
    same = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("points") == -F.col("best.less"))
    dropped = cut(found.filter(~same).select("id", "digest", "points").distinct(), "dedup-dropped")
    keys = {
        "id": F.col(f"`{id_col}`"),
        "digest": digest_of(F.col(f"`{text_col}`")),
        "points": F.length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).cast("bigint"),
    }
    stay = keep_without(docs, dropped, keys, dropped.count())
    twice = cut(found.filter(same).groupBy("id", "digest", "points").count().filter("count > 1").drop("count"), "dedup-twice")
    drop_path(spark, found)
    if n := twice.count():  # rows that tie in all that ranks them: one of each set
        once = keep_without(stay, twice, keys, n)
        names = free_names(docs.columns, *(f"key_{k}" for k in keys))
        others = free_names([*docs.columns, *names], *(f"other_{k}" for k in keys))
        again = stay.withColumns(dict(zip(names, keys.values(), strict=True)))
        right = few(twice.select(*[F.col(k).alias(o) for k, o in zip(keys, others, strict=True)]), n, 64)
        again = again.join(right, [F.col(a).eqNullSafe(F.col(o)) for a, o in zip(names, others, strict=True)], "left_semi")
        stay = once.unionByName(again.dropDuplicates(names).select(*[F.col(f"`{c}`") for c in docs.columns]))
    return stay


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY points DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
         count(*) OVER (PARTITION BY h) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM r
"""
