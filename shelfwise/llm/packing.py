"""Packing of examples into training sequences under several limits at once, by the dot-product heuristic.

An example is a row of ids: an optional context, which bears no loss, then the text and the end id, which do. A
sequence may hold at most ``tokens`` ids, ``segments`` pieces and ``loss`` loss-bearing ids. Examples longer than a
sequence are cut. What is left of them, and all shorter ones, is packed window by window: into the open sequence goes
the piece whose demand vector has the largest dot product with the vector of room left (both as shares of the
limits) among those that fit. If none fits while room is left, the best piece is cut so that it fills the room. The few
pieces that cannot fill a sequence at the end of a window are cut into sequences whose lengths are powers of two,
which need no padding.

A window is a stretch of one task's rows, so packing needs no shuffle and a source with a third of all rows is just
more windows. A repeated task reads the same rows in the same order and gives the same sequences.

Defined cases: null text and null context are empty, so every row has at least its end id; null document ids are kept;
equal rows are packed each for itself; an empty table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import text_of
from shelfwise.llm.pieces import MEMO_ENTRIES, library_encoder

WINDOW_PIECES = 2048
WINDOW_TOKENS = 1_000_000
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long,"
    " segment int, loss_tokens long"
)


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 64
    loss: int = 1024


@dataclass
class Example:
    doc_id: int | None
    ids: bytes
    context: int

    @property
    def tokens(self) -> int:
        return len(self.ids) // 4

    def loss(self, start: int, length: int) -> int:
        """Loss-bearing ids among ``length`` from ``start``."""
        return start + length - min(max(start, self.context), start + length)

    def fitting(self, start: int, room: int, loss_room: int) -> int:
        """The longest piece from ``start`` within the room for ids and for loss-bearing ids."""
        free = max(0, self.context - start)
        return min(room, self.tokens - start, free + loss_room)


@dataclass
class Packer:
    """Sequences of one task; ``sequences`` are lists of (example, start, length)."""

    limits: Limits
    sequences: list[list[tuple[Example, int, int]]] = field(default_factory=list)
    pending: list[tuple[Example, int]] = field(default_factory=list)
    tokens: int = 0

    def add(self, example: Example) -> None:
        """Cut off whole sequences, keep the rest for the window."""
        start = 0
        while start < example.tokens:
            length = example.fitting(start, self.limits.tokens, self.limits.loss)
            if length < self.limits.tokens and start + length >= example.tokens:
                self.pending.append((example, start))
                self.tokens += example.tokens - start
                return
            self.sequences.append([(example, start, length)])
            start += length

    @property
    def full(self) -> bool:
        return len(self.pending) >= WINDOW_PIECES or self.tokens >= WINDOW_TOKENS

    def close_window(self) -> None:
        items, limits = self.pending, self.limits
        self.pending, self.tokens = [], 0
        if not items:
            return
        starts = [start for _, start in items]
        # What is left of the open items, in order; a row moves up when one before it is done. Every item is one segment.
        tokens = np.array([e.tokens - s for e, s in items], dtype="f8")
        loss = np.array([e.loss(s, e.tokens - s) for e, s in items], dtype="f8")
        which = np.arange(len(items))
        left = len(items)
        while left:
            room, segments, loss_room = limits.tokens, limits.segments, limits.loss
            held: list[tuple[Example, int, int]] = []
            while left and room >= 1 and segments >= 1:
                # The dot product of an item's shares of the limits and the shares that are free.
                score = tokens[:left] * (room / limits.tokens**2) + loss[:left] * (loss_room / limits.loss**2)
                fits = (tokens[:left] <= room) & (loss[:left] <= loss_room)
                k = int(np.argmax(np.where(fits, score, -1)))
                whole = bool(fits[k])
                if not whole:
                    k = int(np.argmax(score))
                i = int(which[k])
                example = items[i][0]
                length = int(tokens[k]) if whole else example.fitting(starts[i], room, loss_room)
                if length <= 0:
                    break
                held.append((example, starts[i], length))
                spent = example.loss(starts[i], length)
                room, segments, loss_room = room - length, segments - 1, loss_room - spent
                starts[i] += length
                if whole:
                    left -= 1
                    for column in (tokens, loss, which):
                        column[k:left] = column[k + 1 : left + 1]
                else:
                    tokens[k] -= length
                    loss[k] -= spent
            self.sequences += [held] if room < 1 or left else powers_of_two(held)


def powers_of_two(pieces: list[tuple[Example, int, int]]) -> list[list[tuple[Example, int, int]]]:
    """Cut an underfull sequence into sequences whose lengths are powers of two, largest first."""
    left = sum(length for _, _, length in pieces)
    out: list[list[tuple[Example, int, int]]] = []
    room = 0
    for example, start, length in pieces:
        while length:
            if not room:
                room = 1 << (left.bit_length() - 1)
                left -= room
                out.append([])
            take = min(room, length)
            out[-1].append((example, start, take))
            start, length, room = start + take, length - take, room - take
    return out


def pack_examples(
    docs: DataFrame,
    tokenizer: str,
    kind: str,
    end_id: int,
    limits: Limits | None = None,
    context: str | None = None,
    memo_entries: int = MEMO_ENTRIES,
) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text, and the column ``context`` names): where it lies in which sequence.

    ``start`` and ``length`` count ids of the example, ``offset`` counts ids of the sequence, ``segment`` numbers the pieces of a
    sequence. ``sequence_id`` is unique and not gapless. A worker remembers the ids of ``memo_entries`` pieces of text.
    """
    limits = limits or Limits()
    rows = docs.select(
        F.col("doc_id").cast("long"), (text_of(context) if context else F.lit("")).alias("context"), text_of().alias("text")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(tokenizer, kind, memo_entries)
        end = struct.pack("<I", end_id)
        sequence = TaskContext.get().partitionId() << 40
        packer = Packer(limits)

        def finished() -> pa.RecordBatch:
            nonlocal sequence
            columns: list[list] = [[] for _ in SCHEMA.split(",")]
            for pieces in packer.sequences:
                offset = 0
                for segment, (e, start, length) in enumerate(pieces):
                    crc = zlib.crc32(memoryview(e.ids)[4 * start : 4 * (start + length)])
                    row = (e.doc_id, start, length, crc, e.tokens, sequence, offset, segment, e.loss(start, length))
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                    offset += length
                sequence += 1
            packer.sequences = []
            types = [f.strip().rsplit(" ", 1) for f in SCHEMA.split(",")]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, "int32" if t == "int" else "int64") for c, (_, t) in zip(columns, types, strict=True)],
                names=[name for name, _ in types],
            )

        for batch in batches:
            heads, bodies = (encode.many(batch.column(c).to_pylist()) for c in ("context", "text"))
            for doc_id, head, body in zip(batch.column("doc_id").to_pylist(), heads, bodies, strict=True):
                packer.add(Example(doc_id, head + body + end, len(head) // 4))
                if packer.full:
                    packer.close_window()
                    yield finished()
        packer.close_window()
        if packer.sequences:
            yield finished()

    return rows.mapInArrow(pack, SCHEMA)
