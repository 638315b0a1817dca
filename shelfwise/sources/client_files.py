"""Very many small files of lines in a mounted folder, one folder per key, written and read by tasks themselves.

Hadoop's local file system starts a process per file and folder it creates and copies its configuration for each file it opens, so small files
cost milliseconds; renames at a job's end are the driver's alone. Here tasks call the operating system. A folder in a
store that is not mounted, or one a stream writes with a list of its files, is left to Spark's own reader and writer.

Writing has two jobs: tasks write below a hidden folder and tell what they wrote, so an attempt that failed is not in the list; tasks then move the
listed files to their places. Reading lists folders in tasks and cuts files into byte ranges, which are read in other tasks.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dealt, materialized

# Folders listed, and files moved, in a row of work; bytes of a file read by one; text sent on at a time.
FOLDERS = 64
RANGE = 8 * 2**20
SENT = 2**20
NO_KEY = "__HIVE_DEFAULT_PARTITION__"
# What Spark writes as %XX in the name of a folder.
ESCAPED = re.compile(r"[\x01-\x1f\"#%'*/:=?\\\x7f{\[\]^]")
COMPRESSED = re.compile(r"\.(gz|bz2|deflate|lz4|snappy|zst|zstd)$")
BOM = b"\xef\xbb\xbf"


def mounted(spark: SparkSession, path: str) -> str | None:
    """``path`` for the operating system, if Spark takes it for a local one."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(there).toUri()
    return whole.getPath() if whole.getScheme() == "file" else None


def folder_of(column: str, key: str | None) -> str:
    return f"{column}={ESCAPED.sub(lambda c: f'%{ord(c[0]):02X}', key) if key else NO_KEY}"


def put(staged: str, place: str) -> None:
    """Move a file, also if that was done before: a link, as a rename between folders holds a lock of the whole file system."""
    try:
        os.link(staged, place)
    except FileExistsError:
        pass
    except FileNotFoundError:
        if os.path.exists(place):
            return
        os.makedirs(os.path.dirname(place), exist_ok=True)
        try:
            os.link(staged, place)
        except FileExistsError:
            pass
    except OSError:
        # File systems without links.
        os.makedirs(os.path.dirname(place), exist_ok=True)
        os.replace(staged, place)
        return
    Path(staged).unlink(missing_ok=True)


def append_lines(lines: DataFrame, key: str, folder: str, suffix: str) -> None:
    """Add a file per value of ``key`` and task to ``folder/key=value``; ``lines`` has the columns ``key`` and ``line``, dealt out by key."""
    job = uuid.uuid4().hex
    hidden = f"{folder}/_staged-{job}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, part = TaskContext.get(), TaskContext.get().partitionId()
        own = f"{hidden}/{part}-{task.taskAttemptId()}"
        os.makedirs(own, exist_ok=True)
        last, out, at = None, None, 0
        for batch in batches:
            runs = pc.run_end_encode(batch.column(0).cast("string").fill_null(""))
            text, begin, names = batch.column(1).cast("large_binary"), 0, []
            at_line = np.frombuffer(text.buffers()[1], "int64")[text.offset :]
            data = memoryview(text.buffers()[2] or b"")
            for end, value in zip(runs.run_ends.to_pylist(), runs.values.to_pylist()):
                if out is None or value != last:
                    if out is not None:
                        out.close()
                    out, last, at = open(f"{own}/{at}", "wb"), value, at + 1
                    names.append((f"{own}/{at - 1}", f"{folder_of(key, value)}/part-{part:05d}-{job}{suffix}"))
                out.write(data[at_line[begin] : at_line[end]])
                begin = end
            yield pa.RecordBatch.from_arrays([pa.array([n[i] for n in names], "string") for i in (0, 1)], names=["staged", "name"])
        if out is not None:
            out.close()

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for staged, name in zip(*(c.to_pylist() for c in batch.columns)):
                put(staged, f"{folder}/{name}")
            yield batch

    sent = lines.sortWithinPartitions(key).select(key, F.concat("line", F.lit("\n")).cast("binary").alias("line"))
    try:
        written = materialized(sent.mapInArrow(write, "staged string, name string"), "staged-files")
        dealt(written).mapInArrow(move, "staged string, name string").write.format("noop").mode("overwrite").save()
    finally:
        shutil.rmtree(hidden, ignore_errors=True)


def is_hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def files_below(place: str) -> Iterator[tuple[str, int]]:
    """All files at or below ``place`` that are not hidden, with their sizes."""
    try:
        with os.scandir(place) as entries:
            for entry in entries:
                if not is_hidden(entry.name):
                    if entry.is_dir():
                        yield from files_below(entry.path)
                    else:
                        yield entry.path, entry.stat().st_size
    except NotADirectoryError:
        yield place, os.path.getsize(place)


def lines_of(path: str, begin: int, end: int) -> bytes:
    """The lines of a file that begin in a range of bytes."""
    with open(path, "rb") as file:
        at = 0
        if begin:
            file.seek(begin - 1)
            before = file.readline(end - begin + 1)
            if not before.endswith(b"\n"):
                return b""
            at = begin - 1 + len(before)
        text = file.read(end - at)
        if text and not text.endswith(b"\n"):
            text += file.readline()
    text = text.removeprefix(BOM) if not begin else text
    return text.replace(b"\r\n", b"\n").replace(b"\r", b"\n") if b"\r" in text else text


def read_lines(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    """``value``, all lines of all files below ``folder`` except empty ones, and the paths of compressed files, which are left out."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names in batch.column(0).to_pylist():
                found = [f for name in names for f in files_below(f"{folder}/{name}")]
                ranges = [(p, at, min(at + RANGE, size)) for p, size in found for at in range(0, size, RANGE)]
                columns = [[r[i] for r in ranges] for i in range(3)]
                types = ["string", "int64", "int64"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["path", "begin", "end"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for path, begin, end in zip(*(c.to_pylist() for c in batch.columns)):
                # A file may end without a line feed.
                held.append(lines_of(path, begin, end))
                size += len(held[-1])
                if size >= SENT:
                    yield batch_of(held)
                    held, size = [], 0
        yield batch_of(held)

    def batch_of(texts: list[bytes]) -> pa.RecordBatch:
        lines = [line for line in b"\n".join(texts).split(b"\n") if line]
        return pa.RecordBatch.from_arrays([pa.array(lines, "binary")], names=["value"])

    names = sorted(n for n in os.listdir(folder) if not is_hidden(n))
    rows = [(names[at : at + FOLDERS],) for at in range(0, len(names), FOLDERS)]
    parts = max(1, min(len(rows), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    places = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "names array<string>")
    ranges = materialized(places.mapInArrow(find, "path string, begin long, end long"), "log-ranges")
    packed = F.col("path").rlike(COMPRESSED.pattern)
    others = [r["path"] for r in ranges.where(packed).select("path").distinct().collect()]
    lines = dealt(ranges.where(~packed)).mapInArrow(read, "value binary")
    return lines.select(F.col("value").cast("string").alias("value")), [Path(p).as_uri() for p in others]


def is_stream_output(folder: str) -> bool:
    """A stream keeps a list of the files that count."""
    return os.path.isdir(f"{folder}/_spark_metadata")
