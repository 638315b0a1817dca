"""Token files: one array of ids per file, document boundaries and document ids in Elias-Fano code.

A file holds consecutive documents in the order of their ids. Layout: ``MAGIC``, length of the header, header
(JSON), boundaries (n + 1 offsets, the last is the number of ids), document ids, ids. Ids take two bytes when the
vocabulary allows it, else four. Offsets of any document come from select on the boundaries; no offset table is kept.

Defined cases: a null text is empty and gives the end id alone; null document ids come first and stay null; rows of
equal document id are ordered by text (null first); an empty table gives no file and an empty result. Extra columns
are not carried.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.llm import elias_fano
from shelfwise.llm.common import ordered_parts, put_file, shuffle_parts, text_of
from shelfwise.llm.pieces import library_encoder
from shelfwise.session import materialized

MAGIC = b"SWTOKEN1"
FILE_TOKENS = 2_000_000


def pack_file(doc_ids: list[int | None], docs: list[bytes], width: int, **more) -> list[bytes]:
    """Chunks of one file; ``docs`` are ids as little-endian unsigned 32-bit integers."""
    ends = np.cumsum([0, *(len(d) // 4 for d in docs)])
    known = [d for d in doc_ids if d is not None]
    bounds, names = elias_fano.encode(ends), elias_fano.encode(np.asarray(known, dtype="int64"))
    head = {"docs": len(docs), "tokens": int(ends[-1]), "width": width, "null_ids": len(doc_ids) - len(known),
            "bounds": len(bounds), "names": len(names)} | more
    text = json.dumps(head).encode()
    ids = np.frombuffer(b"".join(docs), "<u4").astype(f"<u{width}")
    return [MAGIC, struct.pack("<q", len(text)), text, bounds, names, ids.tobytes()]


class TokenFile:
    """Random access to the documents of one file."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        (n,) = struct.unpack_from("<q", data, len(MAGIC))
        at = len(MAGIC) + 8
        self.head = json.loads(bytes(data[at : at + n]))
        at += n
        self.bounds = elias_fano.EliasFano(data[at : at + self.head["bounds"]])
        at += self.head["bounds"]
        self.names = elias_fano.EliasFano(data[at : at + self.head["names"]])
        at += self.head["names"]
        self.ids = np.frombuffer(data, f"<u{self.head['width']}", self.head["tokens"], at)

    def __len__(self) -> int:
        return self.head["docs"]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.head["null_ids"] + self.names.select(np.arange(len(self.names))).tolist()

    def offsets(self, docs: np.ndarray) -> np.ndarray:
        """Where these documents' ids begin; ``len(self)`` gives the end of the last."""
        return self.bounds.select(docs)

    def document(self, i: int) -> np.ndarray:
        begin, end = self.offsets(np.array([i, i + 1]))
        return self.ids[begin:end]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, kind: str, end_id: int) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into files below ``folder``.

    Returns one row per file, in file order by (part, seq): part, seq, n_docs, n_tokens, first (ids in all files before).
    """
    spark = docs.sparkSession
    rows = ordered_parts(docs.select(F.col("doc_id").cast("long"), text_of().alias("text")), "doc_id", shuffle_parts(spark))
    rows = rows.repartition("part").sortWithinPartitions("part", "doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(tokenizer, kind)
        with open(tokenizer, encoding="utf-8") as f:
            width = 2 if max(json.load(f)["model"]["vocab"].values()) < 2**16 else 4
        end = struct.pack("<I", end_id)
        part, seq, names, ids, size = None, 0, [], [], 0

        def flush():
            nonlocal seq, names, ids, size
            put_file(folder, f"{part:06d}-{seq:06d}.tokens", *pack_file(names, ids, width, part=part, seq=seq))
            done = pa.RecordBatch.from_pydict(
                {"part": pa.array([part], "int32"), "seq": pa.array([seq], "int32"), "n_docs": [len(ids)], "n_tokens": [size]}
            )
            seq, names, ids, size = seq + 1, [], [], 0
            return done

        for batch in batches:
            parts, doc_ids = (batch.column(c).to_pylist() for c in ("part", "doc_id"))
            for p, doc_id, found in zip(parts, doc_ids, encode.many(batch.column("text").to_pylist()), strict=True):
                if ids and (p != part or size >= FILE_TOKENS):
                    yield flush()
                if p != part:
                    part, seq = p, 0
                names.append(doc_id)
                ids.append(found + end)
                size += len(ids[-1]) // 4
        if ids:
            yield flush()

    files = materialized(rows.mapInArrow(write, "part int, seq int, n_docs long, n_tokens long"), "token-files")
    # One row per part meets in one task here: as many as there are parts, not as there are documents or files.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    parts = parts.select("part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("part_first"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("part_first") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return files.join(parts, "part").select("part", "seq", "n_docs", "n_tokens", first.alias("first"))


def read_token_files(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32, part, seq, doc_in_file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                f = TokenFile(data.as_buffer().to_pybytes())
                ends = f.offsets(np.arange(len(f) + 1))
                ids = memoryview(f.ids.astype("<u4").tobytes())
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([f.head["part"]] * len(f), "int32"),
                        "seq": pa.array([f.head["seq"]] * len(f), "int32"),
                        "doc_id": pa.array(f.doc_ids(), "int64"),
                        "doc_in_file": pa.array(np.arange(len(f))),
                        "at": pa.array(ends[:-1]),
                        "n_tokens": pa.array(np.diff(ends)),
                        "ids_crc32": pa.array(crc, "int64"),
                    }
                )

    stored = spark.read.format("binaryFile").option("pathGlobFilter", "*.tokens").load(folder).select("content")
    schema = "part int, seq int, doc_id long, doc_in_file long, at long, n_tokens long, ids_crc32 long"
    rows = stored.mapInArrow(read, schema).join(files.select("part", "seq", "first"), ["part", "seq"])
    return rows.select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "part", "seq", "doc_in_file")
