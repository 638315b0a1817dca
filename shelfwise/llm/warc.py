"""WARC archives: writing with payload deduplication, and reading in parallel by verified record boundaries.

Archives are plain (not compressed) so that any byte range can be read. The string that begins a record may also stand inside a
payload, so a task that looks at a byte range cannot tell records from look-alikes. Reading therefore goes in three steps:

1. Tasks scan ranges of ``SPLIT_BYTES`` and emit every candidate with its successor, the place where its header says the next
   record begins. Inside a range the chain of each candidate is followed to the first place beyond it.
2. Pointer jumping from the start of each file over those places: in round k every pointer spans 2^k ranges, so the number
   of rounds is the logarithm of the ranges of the longest file. What is reached are true record starts, at most one
   per range.
3. Tasks read each range from its verified first record on.

A chain must end at the end of its file; a file whose chain breaks raises an error and no rows are made up.

Writing: among records with equal payloads of at least ``DEDUPE_BYTES`` bytes the one with the largest page id is the
response, the others are revisits without a body that name it.

Defined cases: null html is an empty payload; a null url is left out; a null page id stays null, and such a page revisits the
response of its group if there is one, else it is a response; rows with the same page id and payload are all written, and all with the
largest id are responses; an empty table gives no file and no rows; extra columns are not carried.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import put_file
from shelfwise.session import materialized

MAGIC = b"WARC/1.1\r\n"
GAP = b"\r\n\r\n"
DEDUPE_BYTES = 1000
FILE_BYTES = 32 << 20
SPLIT_BYTES = 4 << 20
# What is read at first to find the end of a header.
HEADER_BYTES = 64 << 10
# Fixed value: the profile of a revisit by equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
MAX_TASKS = 20_000


# ---- writing


def with_references(pages: DataFrame, least: int = DEDUPE_BYTES) -> DataFrame:
    """Add ``digest`` (SHA-1, hex) and ``refers_to`` (the response's page id, null for responses)."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("size", F.octet_length("html"))
    # Only payloads that occur more than once; the counts are combined before the shuffle.
    groups = rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
    groups = materialized(groups.where("n > 1 and kept is not null").drop("n"), "payload-groups")
    joined = rows.join(groups, ["digest", "size"], "left")
    other = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return joined.select("page_id", "url", "html", "digest", F.when(other, F.col("kept")).alias("refers_to"))


def record(page_id: int | None, url: str | None, html: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {url} {digest}')}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {re.sub(r'[\x00-\x1f]', '', url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"Refers-To-Page-ID: {refers_to}"]
    block = http + html if refers_to is None else http
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return MAGIC + "\r\n".join(lines).encode() + GAP + block + GAP


def write_warc(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html); returns name and bytes of each file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, chunks, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, chunks, size
            put_file(folder, name := f"{part:06d}-{seq:06d}.warc", *chunks)
            done = pa.RecordBatch.from_pydict({"name": [name], "bytes": pa.array([size], "int64")})
            seq, chunks, size = seq + 1, [], 0
            return done

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))
            for row in zip(*columns, strict=True):
                chunks.append(record(*row))
                size += len(chunks[-1])
                if size >= file_bytes:
                    yield flush()
        if chunks:
            yield flush()

    return materialized(with_references(pages).mapInArrow(write, "name string, bytes long"), "warc-files")


# ---- reading


def parse_header(header: bytes) -> dict[str, str]:
    """Fields of a header block, names in lower case."""
    fields = {}
    for line in header.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    return fields


def successor(header: bytes, offset: int) -> int:
    """Where the record after this one begins; -1 if the header has no usable length."""
    length = parse_header(header).get("content-length", "")
    if not (length.isascii() and length.isdigit() and len(length) <= 15):
        return -1
    return offset + len(header) + len(GAP) + int(length) + len(GAP)


def may_go_on(header: bytes) -> bool:
    """Whether an unfinished header is one so far: each whole line after the first is a field, or goes on with one."""
    return all(b":" in line or line[:1] in (b" ", b"\t") for line in header.split(b"\r\n")[1:-1])


def header_at(file, data: bytes, begin: int, offset: int, size: int) -> bytes | None:
    """The header of the record at ``offset``: from ``data``, which begins at ``begin``, else read on from the file.

    A header may have any length: what is read doubles until its end, the end of the file or a line that no header has.
    """
    end = data.find(GAP, offset - begin, offset - begin + HEADER_BYTES)
    if end >= 0:
        return data[offset - begin : end]
    window = HEADER_BYTES
    while True:
        more = file.read_at(min(window, size - offset), offset)
        end = more.find(GAP)
        if end >= 0:
            return more[:end]
        if window >= size - offset or not may_go_on(more):
            return None
        window *= 2


def scan_range(file, begin: int, end: int, size: int) -> list[tuple[int, int, int]]:
    """Candidates that begin in [begin, end): offset, successor, first place of its chain beyond the range (-1: it breaks)."""
    data = file.read_at(min(end + len(MAGIC) - 1, size) - begin, begin)
    found: list[tuple[int, int]] = []
    at = data.find(MAGIC)
    while at >= 0:
        header = header_at(file, data, begin, begin + at, size)
        found.append((begin + at, successor(header, begin + at) if header is not None else -1))
        at = data.find(MAGIC, at + 1)
    leaves: dict[int, int] = {}
    for offset, after in reversed(found):
        leaves[offset] = after if after >= end else leaves.get(after, -1)
    return [(offset, after, leaves[offset]) for offset, after in found]


def _open(folder: str, name: str):
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder)
    return system.open_input_file(f"{base}/{name}")


def ranges_of(files: DataFrame, split_bytes: int) -> DataFrame:
    """Byte ranges of the files: name, bytes, begin, end; spread over tasks."""
    n = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes)).cast("long")).head()[0] or 1
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long")))
    ranges = files.select("name", "bytes", begin.alias("begin"))
    return ranges.withColumn("end", F.least(F.col("begin") + split_bytes, "bytes")).repartition(min(n, MAX_TASKS))


def candidates(files: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Every place that looks like a record start: name, offset, after, leaves (see ``scan_range``)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _open(folder, row["name"]) as file:
                    found = scan_range(file, row["begin"], row["end"], row["bytes"])
                offset, after, leaves = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_pydict(
                    {
                        "name": pa.array([row["name"]] * len(found), "string"),
                        "offset": pa.array(offset, "int64"),
                        "after": pa.array(after, "int64"),
                        "leaves": pa.array(leaves, "int64"),
                    }
                )

    schema = "name string, offset long, after long, leaves long"
    return ranges_of(files, split_bytes).mapInArrow(scan, schema)


def verified_starts(files: DataFrame, found: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Pointer jumping: the first true record start in each range that has one, as (name, entry)."""
    longest = files.agg(F.max(F.ceil(F.col("bytes") / split_bytes)).cast("long")).head()[0] or 0
    reached = files.where("bytes > 0").select("name", F.lit(0).cast("long").alias("offset"))
    # Only places that a chain enters a range by can be passed, so the table has a few rows per range.
    entered = found.where("leaves >= 0").select("name", F.col("leaves").alias("offset")).union(reached).distinct()
    jump = materialized(found.select("name", "offset", "leaves").join(entered, ["name", "offset"]), "warc-jumps")
    for _ in range(max(longest - 1, 0).bit_length()):
        moved = reached.join(jump, ["name", "offset"]).select("name", F.col("leaves").alias("offset")).where("offset >= 0")
        reached = materialized(reached.union(moved).distinct(), "warc-reached")
        onward = jump.select("name", F.col("offset").alias("leaves"), F.col("leaves").alias("onward"))
        # A chain that has left the file or broken off stays where it is.
        stay = F.coalesce("onward", "leaves")
        jump = materialized(jump.join(onward, ["name", "leaves"], "left").select("name", "offset", stay.alias("leaves")), "warc-jumps")
    return reached.withColumnRenamed("offset", "entry")


def read_range(file, entry: int, end: int, size: int) -> Iterator[dict]:
    """Records from the verified start ``entry`` as long as they begin before ``end``."""
    data, begin = b"", entry
    at = entry
    while at < end:
        if at + HEADER_BYTES > begin + len(data) or at < begin:
            data, begin = file.read_at(min(SPLIT_BYTES, size - at), at), at
        header = header_at(file, data, begin, at, size) if data[at - begin : at - begin + len(MAGIC)] == MAGIC else None
        after = successor(header, at) if header is not None else -1
        if after < 0 or after > size:
            raise ValueError(f"broken record at {at}")
        first = at + len(header) + len(GAP)
        if after > begin + len(data):
            block = file.read_at(after - first, first)
        else:
            block = data[first - begin : after - begin]
        if block[-len(GAP) :] != GAP:
            raise ValueError(f"record at {at} does not end where its header says")
        yield {"fields": parse_header(header), "block": block[: -len(GAP)], "after": after}
        at = after


def page_of(found: dict) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a record."""
    fields, block = found["fields"], found["block"]
    http = block.find(GAP)
    named = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    size = int(parse_header(block[:http])["content-length"])
    kind = fields["warc-type"]
    if kind == "response":
        payload = block[http + len(GAP) :]
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != named:
            raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
    number = lambda name: int(fields[name]) if name in fields else None
    return number("page-id"), size, named, kind, number("refers-to-page-id")


def read_warc(spark: SparkSession, files: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row per record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    found = materialized(candidates(files, folder, split_bytes), "warc-candidates")
    starts = verified_starts(files, found, split_bytes)
    ranges = files.join(starts, "name").where("entry < bytes")
    ends = F.least((F.floor(F.col("entry") / split_bytes) + 1) * split_bytes, F.col("bytes"))
    ranges = materialized(ranges.withColumn("end", ends), "warc-ranges")
    n = max(1, min(ranges.count(), MAX_TASKS))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                after, rows = row["entry"], []
                with _open(folder, row["name"]) as file:
                    for r in read_range(file, row["entry"], row["end"], row["bytes"]):
                        rows.append(page_of(r))
                        after = r["after"]
                if not row["end"] <= after <= row["bytes"]:
                    raise ValueError(f"{row['name']}: the chain of records does not end with the file")
                columns = zip(*rows, strict=True)
                types = ("int64", "int64", "string", "string", "int64")
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return ranges.repartition(n).mapInArrow(read, schema)
