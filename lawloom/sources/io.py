"""Readers and writers: JSON arrays, folders of one object a file, CSV, partitioned copies, and appends that resume."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lawloom.plans.stage import staged


def read_json(spark: SparkSession, path: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """Files that hold one JSON array or object each, or folders of them; malformed content fails the job."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path if isinstance(path, str) else list(path))


def read_json_cases(spark: SparkSession, folder: str, schema: T.StructType, drop: Sequence[str] = ()) -> DataFrame:
    """A folder of one object a file, with the file's name and without the dropped columns."""
    return read_json(spark, folder, schema).withColumn("case_file", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)).drop(*drop)


#: White space at the edges of a text is part of it. The null mark is a noncharacter, so that a quoted empty field isn't taken for one.
_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
_NULL = "\uffff"


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and quoted line breaks; a field of nothing is null, a quoted one of nothing an empty text, and all else is kept as it stands."""
    return spark.read.schema(schema).options(**_CSV, nullValue=_NULL).option("multiLine", True).option("mode", "FAILFAST").csv(path)


def write_json(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One JSON object a line; an existing folder is kept as it is unless overwrite."""
    df.write.mode("overwrite" if overwrite else "ignore").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """CSV that read_csv() reads back as it was: nulls, blank texts, edge white space and all line breaks."""
    df.write.mode("overwrite" if overwrite else "ignore").options(**_CSV).csv(path)


def write_json_arrays(df: DataFrame, path: str, rows_per_file: int = 10_000) -> None:
    """Files of one JSON array each, of at most rows_per_file rows: the form of files that whole-file readers expect."""
    text = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    parts = df.select(text.alias("row"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    numbered = parts.withColumn("file", F.floor(F.col("at").bitwiseAND((1 << 33) - 1) / rows_per_file))
    arrays = numbered.groupBy("part", "file").agg(F.concat(F.lit("["), F.array_join(F.collect_list("row"), ",\n"), F.lit("]")).alias("value"))
    arrays.repartition("part", "file").select("value").write.mode("overwrite").option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)


def write_cases(df: DataFrame, folder: str, key: str) -> None:
    """A folder of one JSON object a file, named by the key: each task writes its own rows; a replayed task writes the same."""
    text = df.select(F.col(key).cast("string").alias("k"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pa.fs.FileSystem.from_uri(folder)
        system.create_dir(root)
        done = 0
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_output_stream(f"{root}/{k}.json") as out:
                    out.write(t.encode("utf-8"))
            done += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["n"])

    text.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def write_shards(df: DataFrame, path: str, rows_per_shard: int = 100_000) -> None:
    """Parquet files of at most rows_per_shard rows, dealt out by hash: what a data loader reads shard by shard, the same at every run."""
    shards = df.withColumn("__h", F.xxhash64(*df.columns))
    shards.repartition("__h").sortWithinPartitions("__h").drop("__h").write.mode("overwrite").option("maxRecordsPerFile", rows_per_shard).parquet(path)


def write_splits(df: DataFrame, path: str, column: str = "split") -> None:
    """A partitioned copy, one folder for each split."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def pending(df: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    """The rows whose key isn't among those done; rows with a null key stay, as nothing says that they're done."""
    return df if done is None else df.join(done.select(key).distinct(), key, "left_anti")


def resume_append(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the table at path doesn't have, one for each key (rows without a key all); returns how many there were. The table is read once, its key column only."""
    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    fresh = df.where(F.col(key).isNull()).unionByName(df.where(F.col(key).isNotNull()).dropDuplicates([key]))
    todo = staged(pending(fresh, spark.read.schema(df.schema).parquet(path).select(key) if exists else None, key), "pending")
    todo.write.mode("append").parquet(path)
    return todo.count()


def row_range(df: DataFrame, ordinal: str, start: int = 0, end: int = -1) -> DataFrame:
    """Rows with start <= ordinal < end; an end of -1 is open."""
    inside = F.col(ordinal) >= start
    return df.where(inside if end == -1 else inside & (F.col(ordinal) < end))


def dev_limit(df: DataFrame, ordinal: str, n: int) -> DataFrame:
    """The first n rows by ordinal: the smoke-run option of a pipeline."""
    return df.orderBy(ordinal).limit(n)
