"""Near-duplicate vectors by NN-descent: a neighbour graph refined through neighbours of neighbours.

Vectors are compared with those of the same label and length. Equal vectors are one class from the start.

1. First lists: random hyperplanes deal classes into buckets, several times; inside a bucket (cut into chunks if large) every class gets
   its best ``LIST`` neighbours. Planes grow with the number of classes, and tables with the planes: a pair at the threshold shares
   a bucket of some table with a chance of ``FOUND``.
2. Descent: around every class meet its neighbours and those it is a neighbour of, in chunks if there are many, and all pairs that
   meet are compared. Lists keep the best; a list that is saturated with links (all entries reach the threshold) may grow to twice
   its length in each round. Rounds end when fewer than ``STILL`` of the entries change.
3. Every meeting also emits links that connect what is connected in it. The components of all links are the groups; inside a group
   every list is enlarged to the whole group: all its pairs are compared, in blocks, and links are counted, not listed.
4. Audit, for each label and length: a bounded sample of the classes outside its largest group is compared with all classes. Every
   missed link that could join two groups has an end there, so large groups do not swamp the others. If a single class of the sample
   misses a link, the search goes on with twice as many tables, under a new sample; where the last audit fails, all pairs are compared.
   Labels of so few classes that a bucket holds them all have been compared completely and need no audit.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite components, or whose label is null, has no links and is its
own component; copies of a vector (repeated rows too) link with each other; a null id is never the smallest unless the
component has no other id; an empty table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import broadcast_if_small
from shelfwise.llm.components import components
from shelfwise.session import materialized

LIST = 6
TABLES = 10
MOST_BITS = 30
BUCKET = 64
CHUNK = 512
ROUNDS = 2
STILL = 0.01
BLOCK = 1024
AUDIT = 1024
FOUND = 0.999
ATTEMPTS = 3
SEED = 20_240_229
PAIRS = "node long, other long, sim double, link boolean"


# ---- arrays


def unit_rows(data: list[bytes]) -> np.ndarray:
    """Rows of doubles scaled to length 1."""
    x = np.stack([np.frombuffer(d, "<f8") for d in data])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@lru_cache(maxsize=1024)
def hyperplanes(dim: int, table: int) -> np.ndarray:
    """(MOST_BITS, dim): the planes of a table depend on its number only."""
    return np.random.default_rng([SEED, table]).standard_normal((MOST_BITS, dim))


def connecting(near: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect the components of a symmetric boolean matrix, as a forest."""
    n = len(near)
    free = near.any(axis=1)
    out: list[tuple[int, int]] = []
    for start in range(n):
        if not free[start]:
            continue
        free[start] = False
        reached = [start]
        for at in reached:
            new = np.flatnonzero(near[at] & free)
            free[new] = False
            out += [(at, int(j)) for j in new]
            reached += new.tolist()
    return out


def meet(nodes: np.ndarray, x: np.ndarray, worst: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """Compare all pairs: for each node its best others that beat ``worst``, and links that connect."""
    sim = np.clip(x @ x.T, -1, 1)
    np.fill_diagonal(sim, -2)
    k = min(LIST, len(nodes) - 1)
    best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    found = np.take_along_axis(sim, best, axis=1)
    row, col = np.nonzero(found > worst[:, None])
    a, b = row, best[row, col]
    links = np.array(connecting(sim >= threshold), dtype="int64").reshape(-1, 2)
    a, b = np.concatenate([a, links[:, 0]]), np.concatenate([b, links[:, 1]])
    return nodes[a], nodes[b], sim[a, b], np.concatenate([np.zeros(len(row), bool), np.ones(len(links), bool)])


# ---- groups of rows in tasks


def in_groups(rows: DataFrame, key: str, order: list[str], fn: Callable[[dict], pa.RecordBatch | None], schema: str, most: int | None) -> DataFrame:
    """Rows of equal ``key`` together, in ``order``, as a dict of lists; groups are cut after ``most`` rows."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {n: [] for n in names}
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in names}
            keys = columns[key]
            at = 0
            while at < len(keys):
                end = at + 1
                full = len(keys) if most is None else at + most - (len(held[key]) if held[key] and held[key][0] == keys[at] else 0)
                while end < len(keys) and end < full and keys[end] == keys[at]:
                    end += 1
                if held[key] and (held[key][0] != keys[at] or (most and len(held[key]) >= most)):
                    if (out := fn(held)) is not None:
                        yield out
                    held = {n: [] for n in names}
                    continue
                for n in names:
                    held[n] += columns[n][at:end]
                at = end
        if held[key] and (out := fn(held)) is not None:
            yield out

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def meetings(rows: DataFrame, threshold: float) -> DataFrame:
    """``rows``: place, node, worst, vector. Everything at a place is compared, in chunks."""

    def compare(held: dict) -> pa.RecordBatch | None:
        first = {n: i for i, n in enumerate(held["node"])}
        if len(first) < 2:
            return None
        at = list(first.values())
        found = meet(
            np.array(list(first)), unit_rows([held["vector"][i] for i in at]), np.array([held["worst"][i] for i in at]), threshold
        )
        return pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["node", "other", "sim", "link"])

    rows = rows.select("place", F.xxhash64("place", "node").alias("turn"), "node", "worst", "vector")
    return in_groups(rows, "place", ["turn"], compare, PAIRS, CHUNK)


# ---- steps


def vector_classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the key of their class (null: cannot link), and the classes: node, vec_id, copies, grp, vector."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.col("label").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda v: v != 0)
    key = F.sha1(F.to_json(F.struct(F.col("label").alias("l"), x.alias("x"))))
    rows = vectors.select(F.col("vec_id").cast("long"), F.when(F.coalesce(usable, F.lit(False)), key).alias("key"), "label", x.alias("x"))
    kept = rows.where(F.col("key").isNotNull())
    classes = kept.groupBy("key").agg(
        F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("x").alias("x")
    )

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.asarray(v, dtype="<f8").tobytes() for v in batch.column("x").to_pylist()]
            columns = [batch.column(n) for n in ("key", "vec_id", "copies", "grp", "node")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(data, "binary")], names=["key", "vec_id", "copies", "grp", "node", "vector"])

    grp = F.xxhash64("label", F.size("x")).alias("grp")
    classes = classes.select("key", "vec_id", "copies", grp, F.monotonically_increasing_id().alias("node"), "x")
    classes = materialized(classes.mapInArrow(coded, "key string, vec_id long, copies long, grp long, node long, vector binary"), "vector-classes")
    return rows.select("vec_id", "key"), classes


def group_sizes(classes: DataFrame, threshold: float) -> DataFrame:
    """grp, count, bits and tables of a search."""
    bits = F.least(F.greatest(F.ceil(F.log2(F.col("count") / BUCKET)), F.lit(0)), F.lit(MOST_BITS)).cast("int")
    # A plane leaves a pair at the threshold on one side with this chance.
    together = F.pow(F.lit(1 - math.acos(threshold) / math.pi), F.col("bits"))
    tables = F.greatest(F.lit(TABLES), F.ceil(F.log(F.lit(1 - FOUND)) / F.log(1 - together))).cast("int")
    counts = classes.groupBy("grp").count().withColumn("bits", bits).withColumn("tables", tables)
    return materialized(counts, "group-counts")


def bucketed(classes: DataFrame, sizes: DataFrame, attempt: int) -> DataFrame:
    """place, node, worst, vector: every class once per table, at the bucket its hyperplanes name.

    The first attempt has the tables of the group's size, the next ones as many as all before.
    """
    first = F.lit(0) if attempt == 0 else F.col("tables") * 2 ** (attempt - 1)
    bounds = sizes.select("grp", "bits", first.cast("int").alias("first"), (F.col("tables") * 2**attempt).cast("int").alias("last"))
    rows = classes.select("grp", "node", "vector").join(broadcast_if_small(bounds), "grp")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("vector").to_pylist()
            by_length: dict[int, list[int]] = {}
            for i, d in enumerate(data):
                by_length.setdefault(len(d), []).append(i)
            for length, at in by_length.items():
                x = unit_rows([data[i] for i in at])
                some = batch.take(pa.array(at))
                bits, first, last = (some.column(n).to_numpy() for n in ("bits", "first", "last"))
                for t in range(int(first.min()), int(last.max())):
                    here = np.flatnonzero((first <= t) & (t < last))
                    if not len(here):
                        continue
                    signs = ((x[here] @ hyperplanes(length // 8, t).T) > 0) & (np.arange(MOST_BITS) < bits[here, None])
                    code = (signs * (1 << np.arange(MOST_BITS))).sum(axis=1)
                    dealt = some.take(pa.array(here))
                    yield pa.RecordBatch.from_arrays(
                        [dealt.column("grp"), pa.array(code * 4096 + t), dealt.column("node"), dealt.column("vector")],
                        names=["grp", "code", "node", "vector"],
                    )

    rows = rows.mapInArrow(place, "grp long, code long, node long, vector binary")
    return rows.select(F.xxhash64("grp", "code").alias("place"), "node", F.lit(-2.0).alias("worst"), "vector")


def merged(pairs: DataFrame, threshold: float, growth: int) -> DataFrame:
    """Best lists: node, other, sim, rank. Entries beyond ``LIST`` stay if they are links, up to ``growth`` times as many."""
    best = pairs.select("node", "other", "sim").distinct()
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "other"))
    best = best.withColumn("rank", rank).where(F.col("rank") <= LIST * growth)
    return best.where((F.col("rank") <= LIST) | (F.col("sim") >= threshold))


def descend(classes: DataFrame, lists: DataFrame, threshold: float) -> DataFrame:
    """One round: pairs that meet around a class."""
    there = lists.select(F.col("node").alias("at"), F.col("other").alias("node"))
    back = lists.select(F.col("other").alias("at"), "node")
    itself = classes.select(F.col("node").alias("at"), "node")
    visits = there.union(back).union(itself).distinct()
    # Many may have the same neighbour: its visitors are dealt out to as many places as needed.
    degree = visits.groupBy("at").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("places"))
    visits = visits.join(degree, "at").select(F.xxhash64("at", F.pmod(F.hash("node"), "places")).alias("place"), "node")
    worst = lists.groupBy("node").agg(F.count("*").alias("n"), F.min("sim").alias("w"))
    worst = worst.select("node", F.when(F.col("n") >= LIST, F.col("w")).otherwise(-2.0).alias("worst"))
    known = classes.select("node", "vector").join(worst, "node", "left").select("node", "vector", F.coalesce("worst", F.lit(-2.0)).alias("worst"))
    return meetings(visits.join(known, "node").select("place", "node", "worst", "vector"), threshold)


def search(classes: DataFrame, sizes: DataFrame, threshold: float, attempt: int) -> DataFrame:
    """Links (a, b) found by the hyperplane tables of an attempt, and descent from there."""
    pairs = materialized(meetings(bucketed(classes, sizes, attempt), threshold), "pairs")
    links = pairs.where("link")
    lists = materialized(merged(pairs, threshold, 1), "lists")
    for r in range(1, ROUNDS + 1):
        pairs = materialized(descend(classes, lists, threshold), "pairs")
        links = links.union(pairs.where("link"))
        better = materialized(merged(lists.select("node", "other", "sim").union(pairs.select("node", "other", "sim")), threshold, 2**r), "lists")
        same = better.select("node", "other").intersect(lists.select("node", "other")).count()
        total = better.count()
        lists = better
        if total - same < STILL * total:
            break
    links = links.union(lists.where(F.col("sim") >= threshold).select("node", "other", "sim", F.lit(True).alias("link")))
    return links.select(F.col("node").alias("a"), F.col("other").alias("b"))


def audit(classes: DataFrame, grouped: DataFrame, sizes: DataFrame, threshold: float, attempt: int) -> DataFrame:
    """(grp, a, b): links between different groups of the links found so far, of the labels in ``sizes``, all in one job.

    For each label some ``AUDIT`` classes outside its largest group, others in each attempt, are compared with all its classes, which
    come in parts of some ``BLOCK``.
    """
    parts = sizes.select("grp", "count", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))
    rows = classes.join(broadcast_if_small(parts), "grp").join(grouped, "node", "left")
    rows = rows.select("node", "grp", "vector", F.coalesce("root", "node").alias("root"), "count", "parts")
    roots = materialized(rows.groupBy("grp", "root").count(), "group-sizes")
    giants = roots.groupBy("grp").agg(F.max(F.struct("count", "root")).alias("top")).select("grp", "top.root", F.col("top.count").alias("most"))
    rest = giants.join(sizes.select("grp", "count"), "grp").select("grp", F.col("root").alias("giant"), (F.col("count") - F.col("most")).alias("rest"))
    turn = F.pmod(F.xxhash64("node", F.lit(SEED + attempt)), F.lit(1 << 31))
    chosen = (F.col("root") != F.col("giant")) & (turn * F.col("rest") < F.lit(AUDIT) * F.lit(1 << 31))
    asked = rows.join(broadcast_if_small(materialized(rest, "rests")), "grp").where(chosen)
    asked = materialized(asked.select("grp", "parts", "node", "vector", "root"), "audit-sample")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("grp", "part", "node", "vector", "root")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")).select("grp", "part", "node", "vector", "root")

    def compare(asked: pa.Table, rows: pa.Table) -> pa.Table:
        a, b = np.zeros(0, "int64"), np.zeros(0, "int64")
        if asked.num_rows and rows.num_rows:
            nodes, roots = ([t[c].to_numpy() for t in (rows, asked)] for c in ("node", "root"))
            x, y = (unit_rows(t["vector"].to_pylist()) for t in (rows, asked))
            row, col = np.nonzero((x @ y.T >= threshold) & (roots[0][:, None] != roots[1]))
            a, b = nodes[0][row], nodes[1][col]
        grp = (asked if asked.num_rows else rows)["grp"][0].as_py()
        return pa.table({"grp": pa.array([grp] * len(a), "int64"), "a": pa.array(a, "int64"), "b": pa.array(b, "int64")})

    met = asked.groupBy("grp", "part").cogroup(rows.groupBy("grp", "part"))
    return materialized(met.applyInArrow(compare, "grp long, a long, b long"), "audit")


def in_blocks(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with block, own and place: any two rows of equal ``key`` meet at a place, those of one block where it meets itself."""
    blocks = rows.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(blocks, key).withColumn("block", F.pmod(F.hash("node"), "blocks"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = F.xxhash64(key, F.least("block", "with"), F.greatest("block", "with"))
    return rows.withColumn("own", F.col("block") == F.col("with")).withColumn("place", place)


def complete(classes: DataFrame, grouped: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that connect what is connected, beyond the groups known so far. All pairs are compared, block by block."""
    rows = classes.select("grp", "node").join(grouped, "node", "left").select("grp", "node", F.coalesce("root", "node").alias("root"))
    rows = in_blocks(rows, "grp").select("place", "node", "root").join(classes.select("node", "vector"), "node")

    def compare(held: dict) -> pa.RecordBatch | None:
        x = unit_rows(held["vector"])
        nodes, roots = np.array(held["node"]), np.array(held["root"])
        found = np.array(connecting((x @ x.T >= threshold) & (roots[:, None] != roots)), dtype="int64").reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(nodes[found[:, i]]) for i in (0, 1)], names=["a", "b"])

    return in_groups(rows, "place", ["node"], compare, "a long, b long", None)


def count_links(classes: DataFrame, grouped: DataFrame, threshold: float) -> DataFrame:
    """(node, links): rows of other classes that each class links with. All pairs of a group are compared, block by block."""
    rows = in_blocks(grouped, "root").select("node", "block", "own", "place")
    rows = rows.join(classes.select("node", "copies", "vector"), "node")

    def count(held: dict) -> pa.RecordBatch | None:
        x = unit_rows(held["vector"])
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        # Two blocks meet here: pairs inside a block are counted where the block meets itself.
        block = np.array(held["block"])
        near &= (block[:, None] == block) == held["own"][0]
        links = near @ np.array(held["copies"])
        return pa.RecordBatch.from_arrays([pa.array(held["node"], "int64"), pa.array(links, "int64")], names=["node", "links"])

    counted = in_groups(rows, "place", ["node"], count, "node long, links long", None)
    return counted.groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """``vectors`` (vec_id, embedding, label) to vec_id, n_links, component_id, kept."""
    rows, classes = vector_classes(vectors)
    sizes = group_sizes(classes, threshold)
    links = None
    for attempt in range(ATTEMPTS):
        asked = classes if links is None else classes.join(sizes.select("grp"), "grp", "left_semi")
        found = search(asked, sizes, threshold, attempt)
        links = materialized(found if links is None else links.union(found), "links")
        grouped = materialized(components(links), "groups")
        sizes = sizes.where("bits > 0")
        missed = audit(classes, grouped, sizes, threshold, attempt)
        links = links.union(missed.select("a", "b"))
        sizes = materialized(sizes.join(missed.select("grp").distinct(), "grp", "left_semi"), "failed-groups")
        if sizes.isEmpty():
            break
    else:
        links = links.union(complete(classes.join(sizes.select("grp"), "grp", "left_semi"), grouped, threshold))
        grouped = materialized(components(links), "groups")
    counted = count_links(classes, grouped, threshold)
    known = classes.select("key", "node", "vec_id", "copies").join(grouped, "node", "left").join(counted, "node", "left")
    known = materialized(known.withColumn("root", F.coalesce("root", "node")), "vector-groups")
    least = known.groupBy("root").agg(F.min("vec_id").alias("component"))
    known = known.join(least, "root").select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), "component")
    out = rows.join(known, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
