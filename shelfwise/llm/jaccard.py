"""Groups of documents whose sets of word shingles are alike: a Jaccard join by signature trees.

Equal sets are one class from the start. A tree over all classes would compare any two of them, so classes are first dealt
into groups that no link can cross, and a tree joins each group:

* The hash range is cut into k parts. Two linked sets of sizes x <= y differ in at most d = (x + y) * (1 - t) / (1 + t)
  elements, so of the first d + 1 + e parts at least e + 1 are equal. A class names every non-empty one of
  its first d + 1 + e parts (where part and content make the key), d for the largest partner it can have, and k is the same for
  both sizes. If more than e of its parts are empty, it also names the elements of its prefix, the first n - ceil(t n) + 1 in hash
  order, of which two linked sets share one. So linked classes share a key; a key of several elements is rarely shared by chance.
* The classes that name one key are a key group; keys with the same classes are one. Sharing keys is no reason to be compared: passages of many
  documents would chain all of them. So a class travels as a sketch first, a bitmap of two to four bits per element. Every member
  is held against the smallest of its key group; what may be linked is connected. Key groups that hold several of these connected parts
  are joined by trees of sketches, whose nodes have OR-combined bitmaps and size ranges, and which pass over what is connected. No link is lost, as the
  bound of a sketch is never below the true overlap.
* The components of what may be linked are the groups whose sets travel. Large groups, of keys and of sets, are cut into bands of sizes, and
  bands into blocks: pairs of blocks in the same or in adjacent bands are units. A unit is one tree in one task, and holds a
  bounded number of sets and elements.

Every set travels once per unit it belongs to, as its compressed text, only connecting links leave a unit, and no step lists the pairs of a group.

Defined cases: null and empty text, or text without words, has the empty set (n_shingles 0) and its own id as component; a null
id is never the smallest unless the component has no other; rows with equal text are one class, so repeated rows get equal
results; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import broadcast_if_small, with_columns_of_text
from shelfwise.llm.components import components, contract
from shelfwise.llm.shingles import mix, set_digest, shingle_sets
from shelfwise.llm.signature_tree import SignatureTree, connect_sketches, may_link, sketch
from shelfwise.session import materialized

UNIT_SETS = 4096
UNIT_ELEMENTS = 2_000_000
# Classes whose keys a task remembers having named, and classes of one key that it holds.
NAMED_CLASSES = 200_000
HELD_CLASSES = 100_000


# ---- keys


@lru_cache
def spare_parts(k: int) -> int:
    return 2 + k // 10


def most_partner(n: int, percent: int) -> int:
    return 100 * n // percent


def most_difference(x: int, y: int, percent: int) -> int:
    return (100 - percent) * (x + y) // (100 + percent)


@lru_cache(maxsize=100_000)
def parts_for(y: int, percent: int) -> int:
    """The number of parts for pairs whose larger set has y elements: 4, 6, 8, 12, 16, 24, ..."""
    need = most_difference(y, y, percent) + 1
    k, next_k = 4, 6
    while k - spare_parts(k) < need:
        k, next_k = next_k, 2 * k
    return k


@lru_cache(maxsize=100_000)
def levels_of(n: int, percent: int) -> list[tuple[int, int]]:
    """(k, d) for a set of n elements: the numbers of parts its pairs use, and the differences to allow for."""
    top = most_partner(n, percent)
    out = []
    k = parts_for(n, percent)
    last = parts_for(top, percent)
    while True:
        # Partners under this k are at most as large as k was made for.
        largest = top
        if k != last:
            low, high = n, top
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if parts_for(middle, percent) <= k else (low, middle - 1)
            largest = low
        out.append((k, most_difference(n, largest, percent)))
        if k == last:
            return out
        k = parts_for(largest + 1, percent)


def keys_of(s: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a sorted set; linked sets that differ share one."""
    n = len(s)
    if most_difference(n, most_partner(n, percent), percent) < 1:
        return np.zeros(0, "uint64")
    out = []
    mixed = mix(s)
    starved = False
    for k, d in levels_of(n, percent):
        e = spare_parts(k)
        part = ((s >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        named = part[starts]
        used = min(k, d + 1 + e)
        content = np.add.reduceat(mixed, starts)[named < used]
        named = named[named < used]
        starved |= used - len(named) > e
        out.append(mix(content ^ mix(named * np.uint64(1 << 20) + np.uint64(k))))
    if starved:
        out.append(mix(s[: n - math.ceil(percent * n / 100) + 1] + np.uint64(1)))
    return np.concatenate(out)


def class_id(digest: bytes) -> int:
    """A short name of a class; classes that happen to share it are only grouped together."""
    return int.from_bytes(digest[:8], "little", signed=True)


# ---- Spark steps


def shingle_classes(docs: DataFrame, width: int, keep_text: bool = False) -> DataFrame:
    """``docs`` with n_shingles, digest (null for the empty set), cid, and the smallest hash and the sketch of the set."""

    def run(texts: list[str | None]) -> list[list]:
        sizes, digests, least, maps = [], [], [], []
        for s in shingle_sets(texts, width):
            sizes.append(len(s))
            digests.append(set_digest(s) if len(s) else None)
            least.append(int(s[:1].view("int64")[0]) if len(s) else None)
            maps.append(sketch(s) if len(s) else None)
        return [sizes, digests, [None if d is None else class_id(d) for d in digests], least, maps]

    return with_columns_of_text(docs, "n_shingles long, digest binary, cid long, least long, map binary", run, keep_text)


def key_groups(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(grp, cid, leader): the classes that name a key, if several do, and the smallest of them; equal groups once."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies of a text within a task mostly name their keys once
        for batch in batches:
            keys, ids = [], []
            for s in shingle_sets(batch.column("text").to_pylist(), width):
                if len(s) and (cid := class_id(set_digest(s))) not in seen:
                    if len(seen) == NAMED_CLASSES:
                        seen.clear()
                    seen.add(cid)
                    keys.append(keys_of(s, percent))
                    ids.append(np.full(len(keys[-1]), cid, dtype="int64"))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view("int64")), pa.array(np.concatenate(ids))], names=["key", "cid"]
                )

    def close(names: np.ndarray, ids: np.ndarray, leaders: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(c) for c in (names.view("int64"), ids, leaders)]
        return pa.RecordBatch.from_arrays(columns, names=["grp", "cid", "leader"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ids = np.zeros(0, "int64")
        open_key = leader = None  # a key of more classes than are held names its group itself
        for batch in batches:
            keys, ids = (np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate((keys, ids)))
            new = np.ones(len(keys), dtype=bool)
            new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
            keys, ids = keys[new], ids[new]
            if open_key is not None:
                more = int(np.searchsorted(keys, open_key, side="right"))
                yield close(mix(np.full(more, open_key).view("uint64")), ids[:more], np.full(more, leader))
                keys, ids = keys[more:], ids[more:]
                if not len(keys):
                    continue
                open_key = None
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1]))
            yield grouped(keys[:last], ids[:last])
            keys, ids = keys[last:], ids[last:]
            if len(keys) > HELD_CLASSES:
                open_key, leader = keys[0], ids[0]
                yield close(mix(keys.view("uint64")), ids, np.full(len(ids), leader))
                keys, ids = keys[:0], ids[:0]
        yield grouped(keys, ids)

    def grouped(keys: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        """Whole runs of keys; a group is named by its classes, so that keys of the same classes are one group."""
        if not len(keys):
            return close(keys, ids, ids)
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.diff(np.append(starts, len(keys)))
        names = mix(np.add.reduceat(mix(ids.view("uint64")), starts) + counts.astype("uint64"))
        several = np.repeat(counts > 1, counts)
        columns = np.repeat(names, counts), ids, np.repeat(ids[starts], counts)
        return close(*(c[several] for c in columns))

    keys = docs.select("text").mapInArrow(name, "key long, cid long")
    rows = keys.repartition("key").sortWithinPartitions("key", "cid").mapInArrow(deal, "grp long, cid long, leader long")
    return rows.distinct()


def candidate_groups(docs: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, root): classes, by cid, connected by pairs that share a key and that their sketches allow to be linked."""
    groups = materialized(key_groups(docs, width, percent), "key-groups")
    sketches = reps.select("cid", "n_shingles", "least", "map")

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("x", "map_a", "y", "map_b")), strict=True)
            keep = pa.array([may_link(*row, percent) for row in rows], "bool")
            yield batch.select(["a", "b"]).filter(keep)

    pairs = groups.where("cid <> leader").select(F.col("leader").alias("a"), F.col("cid").alias("b")).distinct()
    ends = [sketches.select(F.col("cid").alias(c), F.col("n_shingles").alias(n), F.col("map").alias(f"map_{c}")) for c, n in ("ax", "by")]
    alike = [(100 * F.col(n)) >= percent * F.col(m) for n, m in ("xy", "yx")]
    close = pairs.join(ends[0], "a").join(ends[1], "b").where(alike[0] & alike[1]).select("a", "b", "x", "map_a", "y", "map_b")
    near = close.mapInArrow(lambda batches: contract(allowed(batches)), "a long, b long")
    known = materialized(components(near, contracted=True), "candidates")

    members = groups.select("grp", "cid").join(known.select(F.col("node").alias("cid"), "root"), "cid", "left")
    members = materialized(members.select("grp", "cid", F.coalesce("root", "cid").alias("known")), "key-members")
    parts = members.groupBy("grp").agg(F.min("known").alias("low"), F.max("known").alias("high"))
    members = members.join(parts.where("low < high").select("grp"), "grp")
    members = members.join(reps.select("cid", "digest", "n_shingles"), "cid")
    dealt = with_units(members, percent).select("cid", "known", F.explode("units").alias("unit"))
    rows = dealt.join(sketches, "cid").select("unit", "known", "n_shingles", "least", "map")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []

        def close_unit() -> pa.RecordBatch:
            known, sizes, least, maps = zip(*held, strict=True)
            links = connect_sketches(list(least), list(sizes), list(maps), percent, list(known))
            return pa.RecordBatch.from_arrays([pa.array([known[link[side]] for link in links], "int64") for side in (0, 1)], names=["a", "b"])

        for batch in batches:
            for u, *row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if u != unit:
                    if len(held) > 1:
                        yield close_unit()
                    unit, held = u, []
                held.append(row)
        if len(held) > 1:
            yield close_unit()

    rows = rows.repartition("unit").sortWithinPartitions("unit")
    found = rows.mapInArrow(lambda batches: contract(join(batches)), "a long, b long")
    # Units connect what is known by its roots; a class that nothing is known of is its own.
    tops = components(found, contracted=True)
    moved = known.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    moved = moved.select("node", F.coalesce("top", "root").alias("root"))
    return moved.union(tops.join(known.select("node"), "node", "left_anti"))


def with_units(members: DataFrame, percent: int) -> DataFrame:
    """``members`` (digest, grp, n_shingles, ...) with ``units``, the trees a class takes part in."""
    # A linked pair is at most one band apart: bands are a little wider than the largest ratio of sizes.
    width = math.log(100 / (percent - 0.5))
    rows = members.withColumn("band", F.floor(F.log("n_shingles") / width))
    bands = rows.groupBy("grp", "band").agg(F.count("*").alias("sets"), F.sum("n_shingles").alias("elements"))
    whole = bands.groupBy("grp").agg((F.sum("sets") <= UNIT_SETS).alias("few"), (F.sum("elements") <= UNIT_ELEMENTS).alias("short"))
    blocks = F.greatest(F.ceil(F.col("sets") / UNIT_SETS), F.ceil(F.col("elements") / UNIT_ELEMENTS)).cast("int")
    bands = bands.join(whole, "grp").select("grp", "band", blocks.alias("own"), (F.col("few") & F.col("short")).alias("one"))
    bands = materialized(bands, "bands")
    beside = lambda step, name: bands.select("grp", (F.col("band") + step).alias("band"), F.col("own").alias(name))
    rows = rows.join(bands, ["grp", "band"])
    rows = rows.join(beside(-1, "upper"), ["grp", "band"], "left").join(beside(1, "lower"), ["grp", "band"], "left")
    rows = rows.withColumn("block", F.pmod(F.hash("digest"), F.col("own")))
    counted = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))

    def unit(band, i, band_2, j):
        return F.xxhash64(F.col("grp"), band, i, band_2, j)

    band, block = F.col("band"), F.col("block")
    same = F.transform(
        F.filter(counted("own"), lambda j: (j != block) | (F.col("upper").isNull() & F.col("lower").isNull() & (F.col("own") == 1))),
        lambda j: unit(band, F.least(block, j), band, F.greatest(block, j)),
    )
    up = F.transform(counted("upper"), lambda j: unit(band, block, band + 1, j))
    down = F.transform(counted("lower"), lambda j: unit(band - 1, j, band, block))
    alone = F.array(F.xxhash64(F.col("grp")))
    rows = rows.withColumn("units", F.when(F.col("one"), alone).otherwise(F.concat(same, up, down)))
    return rows.drop("band", "own", "upper", "lower", "block", "one")


def packed(text: str) -> bytes:
    """A compressed text: about a third of its set of hashes, which do not compress."""
    data = text.encode()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> str:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True).decode()


def tree_links(docs: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): digests of linked classes, enough to connect what is connected, contracted in their tasks.

    ``members``: doc_id of a document of the class, its digest, units.
    """
    small = broadcast_if_small(members.select(F.col("doc_id").alias("rep"), "digest", "units"), F.size("units"))
    texts = docs.select("doc_id", "text").join(small, F.col("doc_id").eqNullSafe(F.col("rep"))).select("text", "digest", "units")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, digest, data = [], [], []
            texts = batch.column("text").to_pylist()
            wanted = zip(texts, batch.column("digest").to_pylist(), batch.column("units").to_pylist(), strict=True)
            for s, (text, d, units) in zip(shingle_sets(texts, width), wanted, strict=True):
                if len(s) and set_digest(s) == d:  # another row may have the same id
                    unit += units
                    digest += [d] * len(units)
                    data += [packed(text)] * len(units)
            yield pa.RecordBatch.from_arrays(
                [pa.array(unit, "int64"), pa.array(digest, "binary"), pa.array(data, "binary")], names=["unit", "digest", "data"]
            )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, {}

        def close() -> pa.RecordBatch:
            names = list(held)
            sets = list(shingle_sets((unpacked(held[d]) for d in names), width)) if len(names) > 1 else []
            links = SignatureTree(sets, percent).connect() if sets else []
            return pa.RecordBatch.from_arrays(
                [pa.array([names[link[side]] for link in links], "binary") for side in (0, 1)], names=["a", "b"]
            )

        for batch in batches:
            for u, d, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if u != unit:
                    if held:
                        yield close()
                    unit, held = u, {}
                held[d] = data
        if held:
            yield close()

    rows = texts.mapInArrow(sets, "unit long, digest binary, data binary")
    rows = rows.repartition("unit").sortWithinPartitions("unit", "digest")
    return rows.mapInArrow(lambda batches: contract(join(batches)), "a binary, b binary")


def jaccard_groups(docs: DataFrame, width: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """The classes of ``docs`` (doc_id, text): digest, doc_id (the smallest), n_shingles, component_id; and ``shingle_classes`` of
    the rows. ``root`` names the component."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    stored = materialized(shingle_classes(docs, width), "shingle-classes")
    reps = stored.where(F.col("digest").isNotNull()).groupBy("digest", "cid", "n_shingles", "least", "map").agg(F.min("doc_id").alias("doc_id"))
    reps = materialized(reps, "class-representatives")
    near = candidate_groups(docs, reps, width, percent)
    members = reps.drop("least", "map").join(near.select(F.col("node").alias("cid"), F.col("root").alias("grp")), "cid")
    members = materialized(with_units(members, percent), "members")
    stars = components(tree_links(docs, members, width, percent), contracted=True)
    rooted = reps.join(stars.select(F.col("node").alias("digest"), "root"), "digest")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    joined = rooted.join(least, "root").select("digest", "root", "component_id")
    groups = reps.join(joined, "digest", "left").select(
        "digest", "doc_id", "n_shingles", F.coalesce("root", "digest").alias("root"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
    return materialized(groups, "jaccard-groups"), stored


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable by links, itself included)."""
    groups, stored = jaccard_groups(docs, width, percent)
    rows = stored.join(groups.select("digest", "component_id"), "digest", "left")
    empty = F.col("digest").isNull()
    return rows.select("doc_id", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each_group(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest id (null last) stays.

    Rows without words all stay. Of repeated rows (same id and same set) one stays.
    """
    groups, stored = jaccard_groups(docs, width, percent)
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("digest"))).alias("first")
    winners = groups.groupBy("root").agg(first).select(F.col("first.doc_id").alias("__doc"), F.col("first.digest").alias("__set"))
    winners = broadcast_if_small(materialized(winners.withColumn("__wins", F.lit(True)), "winners"))
    own = "__digest binary"
    rows = with_columns_of_text(docs, own, lambda texts: [[set_digest(s) if len(s) else None for s in shingle_sets(texts, width)]])
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.col("__digest") == F.col("__set"))
    kept = rows.join(winners, same, "left").where(F.col("__digest").isNull() | F.col("__wins"))
    twice = stored.where(F.col("digest").isNotNull()).groupBy("doc_id", "digest").count().where("count > 1")
    twice = materialized(twice.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__again")), "repeated-rows")
    if not twice.isEmpty():
        again = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__again"))
        twice = broadcast_if_small(twice)
        single = kept.join(twice, again, "left_semi").dropDuplicates(["__doc", "__set"])
        kept = kept.join(twice, again, "left_anti").unionByName(single)
    return kept.select(docs.columns)
