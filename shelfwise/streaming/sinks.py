"""Running a stream to the end of its input and reading what it wrote."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import BATCH, SNAPSHOT_EVERY, Values


def read_stream(spark: SparkSession, folder: str, like: DataFrame, pattern: str, **options: str) -> DataFrame:
    """A file stream of the parquet files that match ``pattern``; batches are bounded in size."""
    limits = {"maxFilesPerTrigger": "1000", **options}
    return (
        spark.readStream.schema(like.schema).option("pathGlobFilter", pattern).options(**limits).parquet(folder)
    )


def run_batches(stream: DataFrame, out: str, rows_of: Callable[[DataFrame, int], DataFrame] | None = None) -> None:
    """Process all available input, one output folder per micro-batch.

    A replayed micro-batch overwrites its own folder, so each one counts once.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        rows = rows_of(batch, batch_id) if rows_of else batch
        rows.write.mode("overwrite").parquet(f"{out}/rows/{BATCH}={batch_id}")

    run_to_end(stream, out, save, "append")


def run_to_end(stream: DataFrame, out: str, save: Callable[[DataFrame, int], None], mode: str) -> None:
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(save)
        .option("checkpointLocation", f"{out}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_batches(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """All rows of all micro-batches, with the number of the batch."""
    whole = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    return spark.read.schema(whole).parquet(f"{out}/rows")


def aggregate_to_end(stream: DataFrame, out: str, keys: Sequence[str], every: int = SNAPSHOT_EVERY) -> DataFrame:
    """Run an aggregation in update mode and return the current value per key.

    Open windows are part of the result, and a window that late rows change is replaced. What is read in the end is a
    snapshot and the changes after it, not the history of the stream.
    """
    values = Values(stream.sparkSession, out, stream.schema, keys, every)

    def save(batch: DataFrame, batch_id: int) -> None:
        values.snapshot(batch_id)
        values.put(batch_id, batch)

    run_to_end(stream, out, save, "update")
    return values.current().drop(BATCH)
