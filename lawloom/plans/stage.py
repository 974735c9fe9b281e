"""Lineage cuts and size-checked joins that hold on a cluster whose executors may be lost."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that is broadcast at most: the sides are a few narrow columns, so this is some tens of megabytes.
BROADCAST_ROWS = 1_000_000
#: Rows of one key that a task takes in a shuffle join; keys of more are salted by their exact count.
HOT_ROWS = 1_000_000

_FOLDERS: dict[str, str] = {}  # by application
_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application inside the one that all executors share, named by spark.checkpoint.dir.

    Where that is unset and the master is local (tests), a temporary folder takes its place; on a cluster each executor would
    write to its own disk, so there it's an error. The folder is removed when the driver's JVM ends, whether or not the
    session was stopped.
    """
    context = spark.sparkContext
    app = context.applicationId
    if app not in _FOLDERS:
        base = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="lawloom-")
        folder = f"{base.rstrip('/')}/lawloom-{app}"
        path, system = _path(spark, folder)
        system.mkdirs(path)
        system.deleteOnExit(path)
        _FOLDERS[app] = folder
    return _FOLDERS[app]


def _path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for a table of this application, which release() removes."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet to the shared folder and read back: its lineage ends there.

    Unlike a local checkpoint, losing an executor loses nothing; unlike checkpoint() the columns stay compressed and
    prunable.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int = 0) -> None:
    """Remove the tables that this application wrote, but for the first `since`; DataFrames that read them are void."""
    written = _WRITTEN.get(spark.sparkContext.applicationId, [])
    for folder in written[since:]:
        path, system = _path(spark, folder)
        system.delete(path, True)
    del written[since:]


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Whatever is written inside is removed at the end, so results have to be saved or collected before."""
    before = len(_WRITTEN.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release(spark, before)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a count proves that df has at most this many rows."""
    return df.limit(rows + 1).count() <= rows


def join_unique(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", hot_rows: int = HOT_ROWS, small_rows: int = BROADCAST_ROWS) -> DataFrame:
    """left joined to right, which has one row for each key: no key of left, however hot, gathers in one task.

    A right side that a count proves small is broadcast. Otherwise keys with more than hot_rows rows are counted, and their
    rows dealt over as many salts as their count asks for, with a copy of the right row for each.
    """
    if is_small(right, small_rows):
        return left.join(F.broadcast(right), list(on), how)
    hot = left.groupBy(*on).count().where(F.col("count") > hot_rows).select(*on, F.ceil(F.col("count") / hot_rows).cast("int").alias("__salts"))
    hot = staged(hot, "hot")
    if hot.isEmpty():
        return left.join(right, list(on), how)
    few = F.broadcast(hot) if is_small(hot, small_rows) else hot
    salts = F.coalesce("__salts", F.lit(1))
    dealt = left.join(few, list(on), "left").withColumn("__salt", F.pmod(F.xxhash64(*left.columns), salts).cast("int")).drop("__salts")
    copied = right.join(few, list(on), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return dealt.join(copied, [*on, "__salt"], how).drop("__salt")


def spread_out(df: DataFrame) -> DataFrame:
    """df, dealt out anew if its scan has fewer partitions than the cluster has cores; a large scan stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df
