"""Spark sessions and the folder that every executor can reach."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "terrane", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; anything else is left to the cluster's defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the supplied Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which the driver and all executors share.

    Only where the setting is absent on a local master (tests, a laptop) a temporary folder is made for the session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="terrane-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write to the shared folder as Parquet and read back: lineage ends here and survives lost executors."""
    path = new_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.coalesce(files_for(df)).write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.terrane_path = path
    return back


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Writes made inside remove their shuffle files when they are done: what they wrote is read from then on."""
    was = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, was)


def shrink_heaps(spark: SparkSession) -> None:
    """A full collection in every executor: heaps that earlier work has grown shrink to a few times what is alive.

    Else a heap stays as large as any work before has made it, beside the Python workers of the work that follows. There
    is a task for each core, so an executor with no core free may be left out.
    """
    cores = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, cores, 1, cores).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def files_for(df: DataFrame) -> int:
    """Files for a written intermediate: one for 4 MB that is read up to two for each core, and one for 16 MB beyond that."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    read = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, min(read >> 22, max(2 * cores, read >> 24), 1_000_000))


def drop_path(spark: SparkSession, path: str | DataFrame) -> None:
    """Delete a folder made by new_path() or cut() once nothing lazy reads it any more."""
    path = path if isinstance(path, str) else path.terrane_path
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
