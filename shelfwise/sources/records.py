"""CSV records of large files, also those whose quoted cells hold line breaks, in many tasks per file.

Whether a line break ends a record depends on all quotes before it. Each byte range of a file is therefore read for both
cases, starting between records and starting inside a quoted cell, and tells how it ends and how many records end in it:
a transition of a machine of two states. Composing the transitions in file order gives the state and the record number every range starts with,
and a second read cuts the records. What a range cannot finish is put together from its pieces, two per range at most.

Ranges are those of Spark's own text reader, so files may lie wherever Spark reads. Records are cut as Spark's multi-line
CSV reader does: a quote opens a quoted cell only at its beginning, a doubled quote stays inside, empty lines are no records; lines end
with a line feed, or with a carriage return and a line feed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialized

# States at the beginning of a line.
BETWEEN, INSIDE = 0, 1
# The rest of a quoted cell up to its closing quote, and cells that are closed in the line, each with its comma.
QUOTED = re.compile(r'[^"]*+(?:""[^"]*+)*+"')
REST = re.compile(r"[^,]*+,")
CELLS = re.compile(r'(?:(?:"[^"]*+(?:""[^"]*+)*+"(?!")[^,]*+|(?!")[^,]*+),)*+')


def state_after(line: str, state: int) -> int:
    """The state at the beginning of the next line."""
    if '"' not in line:
        return state
    at = 0
    if state == INSIDE:
        closed = QUOTED.match(line)
        if closed is None:
            return INSIDE
        rest = REST.match(line, closed.end())
        if rest is None:
            return BETWEEN
        at = rest.end()
    at = CELLS.match(line, at).end()
    return INSIDE if line.startswith('"', at) and not QUOTED.match(line, at + 1) else BETWEEN


def _is_record(line: str, state: int) -> bool:
    return state == INSIDE or line not in ("", "\r")


class Transition:
    """What a range does to either state it may start in: the state it ends in, and the records that end in it."""

    def __init__(self) -> None:
        self.ends = [BETWEEN, INSIDE]
        self.records = [0, 0]

    def read(self, line: str) -> None:
        after = state_after(line, BETWEEN), state_after(line, INSIDE)
        for start, state in enumerate(self.ends):
            if after[state] == BETWEEN and _is_record(line, state):
                self.records[start] += 1
            self.ends[start] = after[state]


class Cutter:
    """Cuts the lines of a range into records: (number, text, whole)."""

    def __init__(self, state: int, number: int):
        self.state, self.number = state, number
        self.lines: list[str] = []
        self.first = state == INSIDE

    def read(self, line: str) -> Iterator[tuple[int, str, bool]]:
        after = state_after(line, self.state)
        if not _is_record(line, self.state):
            return
        self.lines.append(line)
        self.state = after
        if after == BETWEEN:
            # The first record of a range may have begun before.
            yield self.number, "\n".join(self.lines), not self.first
            self.lines, self.first = [], False
            self.number += 1

    def close(self) -> Iterator[tuple[int, str, bool]]:
        if self.lines:
            yield self.number, "\n".join(self.lines), False


def _lines(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    reader = spark.read.options(lineSep="\n", **options)
    at = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")]
    return reader.text(path).select(*at, "value")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """Lines with the range they are from, some at a time, in order."""
    for batch in batches:
        keys = list(zip(batch["path"].to_pylist(), batch["block"].to_pylist(), strict=True))
        lines = batch["value"].to_pylist()
        starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
        for at, end in zip(starts, [*starts[1:], len(keys)], strict=True):
            yield keys[at], lines[at:end]


def transitions(lines: DataFrame) -> DataFrame:
    """path, block and the transition of every range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], Transition] = {}
        for key, some in _ranges(batches):
            transition = held.setdefault(key, Transition())
            for line in some:
                transition.read(line)
        columns = [[*k, *t.ends, *t.records] for k, t in held.items()]
        names = ["path", "block", "end0", "end1", "records0", "records1"]
        types = ["string", "int64", "int32", "int32", "int64", "int64"]
        arrays = [pa.array([c[i] for c in columns], t) for i, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays(arrays, names=names)

    return lines.mapInArrow(run, "path string, block long, end0 int, end1 int, records0 long, records1 long")


def range_starts(moves: DataFrame) -> DataFrame:
    """path, block, state, number: how every range starts. One row per range goes in, those of a file in order."""
    step = F.struct("block", "end0", "end1", "records0", "records1")
    files = moves.groupBy("path").agg(F.sort_array(F.collect_list(step)).alias("steps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, steps in zip(batch["path"].to_pylist(), batch["steps"].to_pylist(), strict=True):
                state, number, rows = BETWEEN, 0, []
                for s in steps:
                    rows.append((path, s["block"], state, number))
                    number += s[f"records{state}"]
                    state = s[f"end{state}"]
                types = [("path", pa.string()), ("block", pa.int64()), ("state", pa.int32()), ("number", pa.int64())]
                arrays = [pa.array(c, t) for c, (_, t) in zip(zip(*rows), types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in types])

    return files.mapInArrow(run, "path string, block long, state int, number long")


def cut_records(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """path, block, number, record, whole: records, and the pieces of those that cross ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], Cutter] = {}

        def batch_of(key: tuple[str, int], found: list[tuple[int, str, bool]]) -> pa.RecordBatch:
            numbers, texts, whole = zip(*found) if found else ((), (), ())
            size = len(found)
            arrays = [pa.array([key[0]] * size, "string"), pa.array([key[1]] * size, "int64"), pa.array(numbers, "int64")]
            arrays += [pa.array(texts, "string"), pa.array(whole, "bool")]
            return pa.RecordBatch.from_arrays(arrays, names=["path", "block", "number", "record", "whole"])

        for batch in batches:
            at = 0
            for key, some in _ranges([batch]):
                if key not in held:
                    held[key] = Cutter(batch["state"][at].as_py(), batch["number"][at].as_py())
                at += len(some)
                yield batch_of(key, [r for line in some for r in held[key].read(line)])
        for key, cutter in held.items():
            yield batch_of(key, list(cutter.close()))

    # A file's first range starts between records. One row per further range, some megabytes of text each, goes to all tasks;
    # lines stay in order.
    later = F.broadcast(starts.where("block > 0"))
    known = {c: F.coalesce(c, F.lit(0)) for c in ("state", "number")}
    placed = lines.join(later, ["path", "block"], "left").withColumns(known)
    return placed.mapInArrow(run, "path string, block long, number long, record string, whole boolean")


def read_records(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """``(path, number, record)``: the records of CSV files, numbered per file; record 0 is the header."""
    lines = _lines(spark, path, **options)
    starts = materialized(range_starts(transitions(lines)), "range-starts")
    cut = materialized(cut_records(lines, starts), "records")
    pieces = F.sort_array(F.collect_list(F.struct("block", "record")))
    joined = F.array_join(F.transform(pieces, lambda p: p["record"]), "\n").alias("record")
    crossing = cut.where("NOT whole").groupBy("path", "number").agg(joined)
    whole = cut.where("whole").select("path", "number", "record").unionByName(crossing)
    mark = F.when(F.col("number") == 0, F.regexp_replace("record", "^﻿", "")).otherwise(F.col("record"))
    return whole.withColumn("record", F.regexp_replace(mark, "\r$", ""))
