"""Questions that keep arriving in a folder, answered once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lawloom.sources.io import resume_append


def process_new(spark: SparkSession, folder: str, schema: T.StructType, work: Callable[[DataFrame], DataFrame], out: str, key: str, checkpoint: str) -> StreamingQuery:
    """Start a stream over the Parquet files of a folder: every micro-batch goes through work, and rows of new keys are appended to out.

    Keys that out has already are skipped, and a key has one row in a batch, so a batch that is replayed after a failure adds nothing twice. The query ends
    when all files that are there have been processed.
    """

    def step(batch: DataFrame, _: int) -> None:
        resume_append(work(batch), out, key)

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
