"""Current values of keys that micro-batches change: a snapshot, and the changes after it.

Every micro-batch writes the rows of the keys it changed to a folder of its own, so a replayed batch replaces what it wrote and counts
once. Now and then everything up to the batch before is written as a new snapshot, and a pointer file is renamed into
place that names it: a reader sees the old snapshot with a longer tail or the new one with a shorter tail, and a run that
stops between the two leaves a folder nobody names. Reading costs the snapshot and the tail, whatever the age of the stream.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = "batch_id"
# A new snapshot is written when the tail has this many batches.
SNAPSHOT_EVERY = 16


class Values:
    """Values by ``keys`` below ``folder``; ``schema`` holds keys and values, without the batch."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, keys: Sequence[str], every: int = SNAPSHOT_EVERY):
        self.spark, self.folder, self.keys, self.every = spark, folder, list(keys), every
        self.schema = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])

    # -- files

    def _files(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def pointed(self) -> tuple[str | None, int]:
        """Folder of the snapshot in force, and the last batch that is in it."""
        system, path = self._files(f"{self.folder}/pointer")
        if not system.exists(path):
            return None, -1
        name = self.spark.read.text(f"{self.folder}/pointer").head()[0]
        return f"{self.folder}/{name}", int(name.split("-")[1])

    def point_to(self, name: str) -> None:
        """Name the snapshot in force, in one step."""
        draft = f"{self.folder}/.pointer-{uuid.uuid4().hex}"
        system, path = self._files(draft)
        stream = system.create(path, True)
        stream.write(bytearray(name.encode()))
        stream.close()
        jvm = self.spark._jvm.org.apache.hadoop.fs
        options = self.spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
        options[0] = jvm.Options.Rename.OVERWRITE
        target = jvm.Path(f"{self.folder}/pointer")
        jvm.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration()).rename(path, target, options)

    def _changes(self, after: int, before: int | None) -> DataFrame:
        system, path = self._files(f"{self.folder}/rows")
        if not system.exists(path):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(f"{self.folder}/rows").where(F.col(BATCH) > after)
        return rows if before is None else rows.where(F.col(BATCH) < before)

    # -- values

    def current(self, before: int | None = None) -> DataFrame:
        """The last value of every key, of all batches or of those ``before`` one, with the batch that set it."""
        snapshot, upto = self.pointed()
        rows = self._changes(upto, before)
        if snapshot is not None:
            rows = rows.unionByName(self.spark.read.schema(self.schema).parquet(snapshot))
        values = [f.name for f in self.schema.fields if f.name not in self.keys]
        last = F.max_by(F.struct(*values), BATCH).alias("last")
        return rows.groupBy(*self.keys).agg(last).select(*self.keys, "last.*")

    def put(self, batch_id: int, changed: DataFrame) -> None:
        """The values that a micro-batch set; again, if it is replayed."""
        changed.drop(BATCH).write.mode("overwrite").parquet(f"{self.folder}/rows/{BATCH}={batch_id}")

    def snapshot(self, batch_id: int, keep: Column | None = None) -> bool:
        """If the tail is long, write the values before ``batch_id``, which no replay changes any more, and name them.

        Keys for which ``keep`` is false are left out, and so forgotten.
        """
        _, upto = self.pointed()
        if batch_id - 1 - upto < self.every:
            return False
        rows = self.current(before=batch_id)
        name = f"snapshot-{batch_id - 1}-{uuid.uuid4().hex}"
        (rows if keep is None else rows.where(keep)).select(self.schema.names).write.parquet(f"{self.folder}/{name}")
        self.point_to(name)
        return True
