"""Helpers that several operators share: table access, held-out rows, ordered parts, files in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfwise.session import materialized, prepare

# What an Arrow batch may hold: documents can be long, and a worker holds a batch or two at a time.
BATCH_ROWS = 1000
BATCH_BYTES = "4m"


def tuned(spark: SparkSession) -> SparkSession:
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def learnable(doc_id: str = "doc_id") -> Column:
    """Rows that labels may be learned from: the remainder is known and not 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 != 2, F.lit(False))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ordered_parts(df: DataFrame, key: str, parts: int, descending: bool = False) -> DataFrame:
    """Add ``part``: ranges of ``key`` with about equally many rows, numbered in key order.

    Rows of equal key share a part. Null keys come first in ascending and last in descending order.
    The bounds are ``parts - 1`` approximate quantiles of the key column alone.
    """
    if parts > 1:
        shares = [i / parts for i in range(1, parts)]
        bounds = df.agg(F.percentile_approx(key, shares, 10 * parts).alias("b")).head()["b"] or []
    else:
        bounds = []
    cuts = np.unique(np.asarray(bounds, dtype="int64"))
    last = len(cuts)

    @F.pandas_udf("int")
    def part_of(keys: pd.Series) -> pd.Series:
        known = keys.notna().to_numpy()
        at = np.zeros(len(keys), dtype="int32")
        at[known] = np.searchsorted(cuts, keys[known].to_numpy(dtype="int64"), side="left")
        return pd.Series(last - at if descending else at)

    return df.withColumn("part", part_of(F.col(key).cast("long")))


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Consecutive rows of equal ``keys``, one table per run; a task holds one run and one batch."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        whole = rows if held is None else pa.concat_tables([held, rows])
        values = list(zip(*(whole.column(k).to_pylist() for k in keys), strict=True))
        starts = [0, *(i for i in range(1, len(values)) if values[i] != values[i - 1])]
        for at, end in zip(starts, starts[1:]):
            yield whole.slice(at, end - at)
        held = whole.slice(starts[-1])
    if held is not None:
        yield held


def numbered(df: DataFrame, group: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``pos``, the place of a row in its ``group`` (no nulls) by ``order``, and (group, ``n``): rows of each group.

    Rows are dealt into ranges of (group, order), so a large group is many tasks, and counted along in each range. Only the first
    group of a range can have begun before: at most one row per range corrects the counts. Ties of ``order`` are told apart by where a
    row is read from, so equal rows can be dealt out, too; ``df`` must be read from files.
    """
    rows = df.withColumn("__read", F.monotonically_increasing_id())
    keys = [group, *order, "__read"]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__read")
    schema = T.StructType([*df.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__at", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            at = []
            for value in batch.column(group).to_pylist():
                last, seen = value, (seen + 1 if value == last else 0)
                at.append(seen)
            columns = [*batch.columns, pa.array([part] * len(at), "int32"), pa.array(at, "int64")]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    rows = materialized(rows.mapInArrow(count, schema), "numbered")
    counts = materialized(rows.groupBy(group, "__part").agg(F.count("*").alias("__n")), "numbers")
    earlier = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    begun = counts.withColumn("__before", F.sum("__n").over(earlier)).where("__before > 0").select(group, "__part", "__before")
    # At most one row per range.
    placed = rows.join(F.broadcast(begun), [group, "__part"], "left")
    placed = placed.withColumn("pos", F.col("__at") + F.coalesce("__before", F.lit(0))).drop("__part", "__at", "__before")
    return placed, counts.groupBy(group).agg(F.sum("__n").alias("n"))


def put_file(folder: str, name: str, *chunks: bytes) -> str:
    """Write a file in one step: a temporary name first, then a rename, so a repeated task replaces it whole.

    ``folder`` is a path or URI that all executors reach (mounted folder, HDFS, object store).
    """
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    draft = f"{base}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        for chunk in chunks:
            out.write(chunk)
    system.move(draft, f"{base}/{name}")
    return f"{folder}/{name}"


def hashed_sample(docs: DataFrame, group: str, size: int, chars: int) -> list[tuple]:
    """(group value, text) of at most ``size`` different texts per group: a bounded sample to fit a model on.

    Texts are dealt into ``size`` buckets by hash and the lowest hash of each bucket is taken, which is a random choice
    that does not depend on order or partitions and needs no sort. Copies of a text are one candidate. A text longer than
    ``chars`` characters gives a stretch of that length from a place that its hash names. Rows with a null group or no text
    are left out.
    """
    rows = docs.where(F.col(group).isNotNull() & (F.length("text") > 0)).select(group, "text", F.xxhash64("text").alias("h"))
    lowest = rows.groupBy(group, F.pmod("h", F.lit(size)).alias("bucket")).agg(F.min("h").alias("h"))
    room = F.greatest(F.length("text") - chars, F.lit(0)) + 1
    stretch = F.substring("text", (F.pmod(F.hash("h"), room) + 1).cast("int"), F.lit(chars))
    lowest = broadcast_if_small(materialized(lowest.select(group, "h"), "sample"))
    taken = rows.join(lowest, [group, "h"]).groupBy(group, "h").agg(F.first(stretch).alias("text"))
    return sorted((r[group], r["text"]) for r in taken.collect())


def with_columns_of_text(
    docs: DataFrame, added: str, fn: Callable[[list[str | None]], list[Sequence]], keep_text: bool = True
) -> DataFrame:
    """``docs`` with columns that ``fn`` derives from batches of ``text``, in place of columns of these names.

    ``added`` is a schema string; ``fn`` gets the texts (null: None) and returns one sequence per column. The other columns pass
    by in the same rows. Without ``keep_text`` the text is not sent back. ``text`` itself may be replaced.
    """
    new = T._parse_datatype_string(added)
    rows = docs.drop(*(n for n in new.names if n != "text"))
    kept = [f for f in rows.schema.fields if (keep_text and "text" not in new.names) or f.name != "text"]
    types = to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(f.name) for f in kept]
            found = fn(batch.column("text").to_pylist())
            columns += [pa.array(c, t.type) for c, t in zip(found, types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept] + new.names)

    return rows.mapInArrow(run, T.StructType([*kept, *new.fields]))


# A table is broadcast up to this many rows of a few short columns, some 50 MB; beyond it joins shuffle.
BROADCAST_ROWS = 500_000


def broadcast_if_small(stored: DataFrame, entries: Column | None = None) -> DataFrame:
    """A hint to broadcast ``stored``, a written table of short columns, if its counted rows allow it, or the sum of its ``entries``,
    for rows that hold arrays."""
    counted = stored.count() if entries is None else stored.agg(F.sum(entries)).head()[0] or 0
    return F.broadcast(stored) if counted <= BROADCAST_ROWS else stored
