"""Places of rows within their groups, without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialized


def numbered(df: DataFrame, groups: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``pos``, the place of a row in its group by ``order``, and the groups with ``n``, their number of rows.

    Rows are dealt into ranges of (groups, order), so a large group is many tasks, and counted along in each range. Only the
    first group of a range can have begun before: at most one row per range corrects the counts. Ties of ``order`` are told
    apart by where a row is read from, so equal rows can be dealt out, too; ``df`` must be read from files. Group columns
    hold no nulls.
    """
    rows = df.withColumn("__read", F.monotonically_increasing_id())
    keys = [*groups, *order, "__read"]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__read")
    added = [T.StructField("__part", T.IntegerType()), T.StructField("__at", T.LongType())]
    schema = T.StructType([*df.schema.fields, *added])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            at = []
            for value in zip(*(batch.column(g).to_pylist() for g in groups), strict=True):
                last, seen = value, (seen + 1 if value == last else 0)
                at.append(seen)
            columns = [*batch.columns, pa.array([part] * len(at), "int32"), pa.array(at, "int64")]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    rows = materialized(rows.mapInArrow(count, schema), "numbered")
    counts = materialized(rows.groupBy(*groups, "__part").agg(F.count("*").alias("__n")), "numbers")
    earlier = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    begun = counts.withColumn("__before", F.sum("__n").over(earlier)).where("__before > 0")
    # At most one row per range.
    begun = F.broadcast(begun.select(*groups, "__part", "__before"))
    pos = F.col("__at") + F.coalesce("__before", F.lit(0))
    placed = rows.join(begun, [*groups, "__part"], "left").withColumn("pos", pos)
    sizes = counts.groupBy(*groups).agg(F.sum("__n").alias("n"))
    return placed.drop("__part", "__at", "__before"), sizes
