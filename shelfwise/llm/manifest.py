"""Merkle manifest of a table of documents: a tree of digests per language, a tree over those, and a proof for every row.

A leaf is the digest of a row. While a tree has several nodes on a level, every two consecutive ones become the digest of both, the
last one alone if their number is odd. Roots of the languages, in order of language (null first), are the leaves of the tree of the
dataset. The proof of a row are the digests beside its path, from the leaf up to the root of the dataset.

Both directions are time-forward processing. A node's label is (last leaf below it, height), so children come before
parents, and a priority queue ordered by label delivers digests to parents: between bands of ``BAND`` levels the queue is
external, a table that Spark sorts by label; inside a band a task sweeps over at most 2 ** BAND nodes and its heap holds one message per level.
The reversed sweep delivers proof suffixes from the root to the leaves, with the labels of a band in reversed order. A language that
holds most rows is as many tasks as it has bands, and every band is written to the shared folder.

Defined cases: a null value is ``-``; rows of equal or null ``doc_id`` are ordered by their digests, null ids first; a null ``doc_id`` is never
tampered with; repeated rows are leaves of their own; an empty table gives no rows; columns other than the five are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import numbered, runs
from shelfwise.session import materialized

# Levels of a tree that one task sweeps at a time: blocks of 1024 nodes.
BAND = 10
DIGEST = 64
# A step of a path to the root: no sibling, or the sibling on one side and its digest.
ALONE, LEFT, RIGHT = ".", "<", ">"

Label = tuple[int, int]


def digest_of(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height_of(nodes: int) -> int:
    """Levels above the leaves until one node is left."""
    return (nodes - 1).bit_length()


# ---- sweeps over one block


def label_of(index: int, height: int, leaves: int) -> Label:
    return min((index + 1) << height, leaves) - 1, height


def sweep_up(leaves: list[str], height: int) -> dict[Label, str]:
    """Digests of all nodes up to ``height``, by label and in the order of labels."""
    queue: list[tuple[Label, int, str]] = []
    nodes: dict[Label, str] = {}

    def settle(label: Label, digest: str) -> None:
        nodes[label] = digest
        last, level = label
        if level < height:
            heapq.heappush(queue, (label_of(last >> (level + 1), level + 1, len(leaves)), last, digest))

    for at, leaf in enumerate(leaves):
        settle((at, 0), leaf)
        while queue and queue[0][0][0] <= at:
            label, told = queue[0][0], []
            while queue and queue[0][0] == label:
                told.append(heapq.heappop(queue)[2])
            settle(label, digest_of(*told))
    return nodes


def sweep_down(nodes: dict[Label, str], path: str) -> list[str]:
    """Paths of the leaves to the root, if ``path`` is that of the top node."""
    (last, top), leaves = next(reversed(nodes)), sum(1 for _, level in nodes if level == 0)
    queue = [((-last, -top), path)]
    found: list[str] = []
    for last, level in reversed(nodes):
        receiver, path = heapq.heappop(queue)
        assert receiver == (-last, -level), "a message for every node, in reversed order of labels"
        if level == 0:
            found.append(path)
            continue
        second = (last >> level << level) + (1 << (level - 1))
        if second > last:
            heapq.heappush(queue, ((-last, 1 - level), ALONE + path))
        else:
            first = second - 1, level - 1
            heapq.heappush(queue, ((-first[0], -first[1]), RIGHT + nodes[last, level - 1] + path))
            heapq.heappush(queue, ((-last, 1 - level), LEFT + nodes[first] + path))
    return found[::-1]


def folded(digest: str, path: str) -> str:
    """The root that follows from a leaf and its path."""
    at = 0
    while at < len(path):
        if path[at] == ALONE:
            digest, at = digest_of(digest), at + 1
        else:
            other = path[at + 1 : at + 1 + DIGEST]
            digest = digest_of(other, digest) if path[at] == LEFT else digest_of(digest, other)
            at += 1 + DIGEST
    return digest


def proof_of(path: str) -> str:
    """Digest of the siblings on a path."""
    return digest_of(path.translate({ord(c): None for c in (ALONE, LEFT, RIGHT)}))


# ---- bands of all trees

LEVEL = "tree string, pos long, n long, digest string"
SENT = "tree string, pos long, path string, subroot string, root string"


def in_blocks(rows: DataFrame, band: int) -> DataFrame:
    rows = rows.withColumn("block", F.shiftright(F.col("pos"), band))
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "told", "pos")


def band_up(level: DataFrame, band: int) -> DataFrame:
    """The nodes ``band`` levels higher, or the root of a tree that has fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, ["tree", "block"]):
            tree, at, n = (block.column(c)[0].as_py() for c in ("tree", "block", "n"))
            top = sweep_up(block.column("digest").to_pylist(), min(band, height_of(n)))
            above = (n - 1 >> band) + 1
            yield pa.RecordBatch.from_pydict({"tree": [tree], "pos": [at], "n": [above], "digest": [top[next(reversed(top))]]})

    return in_blocks(level.select("tree", "pos", "n", "digest", F.lit(1).alias("told")), band).mapInArrow(run, LEVEL)


def grown(leaves: DataFrame, band: int) -> list[DataFrame]:
    """The nodes of all trees at every ``band``-th level, from the leaves to one root per tree."""
    levels = [leaves]
    while (levels[-1].agg(F.max("n")).head()[0] or 0) > 1:
        levels.append(materialized(band_up(levels[-1], band), "manifest-level"))
    return levels


def band_down(level: DataFrame, sent: DataFrame, extra: list[str], finish, schema: str, band: int) -> DataFrame:
    """Deliver the paths of the nodes above, ``sent``, to the nodes of ``level``.

    ``finish`` makes a batch of a block's rows, their paths, and the subroot and root told with them.
    """
    rows = level.select("tree", "pos", "n", "digest", *extra, F.lit(1).alias("told"))
    empty = [F.lit(None).cast(level.schema[c].dataType).alias(c) for c in extra]
    # A block's message comes before its nodes.
    message = sent.select(
        "tree", F.shiftleft("pos", band).alias("pos"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("digest"),
        *empty, F.lit(0).alias("told"), "path", "subroot", "root",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, ["tree", "block"]):
            path, subroot, root = (block.column(c)[0].as_py() for c in ("path", "subroot", "root"))
            nodes = block.slice(1)
            height = min(band, height_of(nodes.column("n")[0].as_py()))
            yield finish(nodes, sweep_down(sweep_up(nodes.column("digest").to_pylist(), height), path), subroot, root)

    both = in_blocks(rows.unionByName(message, allowMissingColumns=True), band)
    return both.mapInArrow(run, schema)


def _passed_on(nodes: pa.Table, paths: list[str], subroot: str | None, root: str) -> pa.RecordBatch:
    size = len(paths)
    columns = [nodes.column("tree").to_pylist(), nodes.column("pos").to_pylist(), paths, [subroot] * size, [root] * size]
    return pa.RecordBatch.from_pydict(
        {n: pa.array(c, "int64" if n == "pos" else "string") for n, c in zip(("tree", "pos", "path", "subroot", "root"), columns, strict=True)}
    )


def _proved(nodes: pa.Table, paths: list[str], subroot: str | None, root: str) -> pa.RecordBatch:
    leaves = nodes.column("digest").to_pylist()
    tampered = nodes.column("tampered").to_pylist()
    found = [folded(b or a, p) for a, b, p in zip(leaves, tampered, paths, strict=True)]
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array(nodes.column("doc_id").to_pylist(), "int64"),
            "leaf": leaves,
            "subroot": [subroot] * len(leaves),
            "root": [root] * len(leaves),
            "proof_sha256": [proof_of(p) for p in paths],
            "folded_root": found,
            "verified": [f == root for f in found],
        }
    )


PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def told_down(levels: list[DataFrame], sent: DataFrame, down_to: int, band: int) -> DataFrame:
    """Paths of the nodes of level ``down_to`` from those of the trees' roots."""
    for level in reversed(levels[down_to:-1]):
        sent = materialized(band_down(level, sent, [], _passed_on, SENT, band), "manifest-paths")
    return sent


# ---- documents


def part_of_leaf(value: Column) -> Column:
    """UTF-8 byte count, ``:`` and the value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*map(part_of_leaf, (doc_id, source, lang, n_chars, text))), 256)


def manifest(docs: DataFrame, tampered: Column | None = None, band: int = BAND) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``tampered`` says for which rows the root is recomputed from a row whose ``n_chars`` is one more; a null ``n_chars`` stays. A task
    sweeps over ``band`` levels.
    """
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = F.coalesce(F.lit(False) if tampered is None else tampered, F.lit(False)) & F.col("n_chars").isNotNull()
    other = leaf_of(*columns[:3], F.col("n_chars") + 1, F.col("text"))
    # A tree's name sorts as its language does, null first.
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("tree")
    leaves = docs.select(tree, F.col("doc_id").cast("long").alias("doc_id"), leaf_of(*columns).alias("digest"), F.when(changed, other).alias("tampered"))
    placed, sizes = numbered(materialized(leaves, "manifest-leaves"), "tree", ["doc_id", "digest"])
    levels = grown(placed.join(materialized(sizes, "manifest-sizes"), "tree"), band)
    subroots = levels[-1].where("pos = 0").select(F.lit("").alias("all"), F.col("tree").alias("name"), "digest")
    trees, count = numbered(materialized(subroots, "manifest-subroots"), "all", ["name"])
    crown = grown(trees.join(materialized(count, "manifest-count"), "all").withColumnRenamed("all", "tree"), band)
    root = crown[-1].select("tree", "pos", F.lit("").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    ends = told_down(crown, root, 0, band)
    names = crown[0].select("tree", "pos", "name", F.col("digest").alias("subroot"))
    ends = ends.drop("subroot").join(names, ["tree", "pos"])
    ends = materialized(ends.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", "subroot", "root"), "manifest-roots")
    return band_down(levels[0], told_down(levels, ends, 1, band), ["doc_id", "tampered"], _proved, PROOFS, band)


def every_seventh(doc_id: Column) -> Column:
    """Rows whose id's checksum is divisible by 7."""
    return F.crc32(doc_id.cast("string")) % 7 == 0
