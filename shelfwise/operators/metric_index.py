"""Exact nearest vectors with pruning: pivot cells, rings, and a running k-th similarity per message.

Vectors of a group are dealt to the nearest of a few pivots, and the members of a cell, ordered by their angle to the
pivot, are cut into blocks: rings of bounded size. A message at angle ``a`` to the pivot is at least ``a - outer`` and ``inner - a``
away from every member of a ring (angles obey the triangle inequality), which bounds its similarity to all of them. Every message visits
the most promising block first; its k-th similarity there is one that the answer reaches at least, and
blocks with a lower bound are never sent to it. Only block descriptions meet all messages, one row per some thousand vectors.

Blocks that follow each other share a hall, and messages and vectors meet by halls: a row is copied once per hall or
part of the visitors, not once per block, and a mask says which blocks of the hall a message visits. Both sides of a meeting are
bounded: the blocks of a hall and at most so many of its visitors. A group with a third of all rows has more cells, rings and
meetings, not larger ones. A group of one block needs no pivots. Of rows that are equal in vector and price only the k lowest enter.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import EPSILON
from ..session import materialized
from .places import numbered

BLOCK_MESSAGES = 32_768
BLOCK_PRODUCTS = 4096
# Blocks of a hall; the mask of a visit has a bit for each.
HALL_BLOCKS = 16
# Messages that meet the descriptions of all blocks at a time.
CHOOSING_MESSAGES = 1024
# Messages of one matrix product.
TILE_MESSAGES = 256
# Pivots of a group at most, and rows that are dealt to them at a time.
PIVOTS = 256
DEALT_ROWS = 16_384
# Similarities equal to this many places tie, and ties go to the lower row number.
TIE_PLACES = 9
# Angles are certain to this much; a bound is never that close to a similarity it must not exclude.
ANGLE_SLACK = 1e-6

HITS = "msg_id long, row_id long, sim double"


def unit_rows(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of an Arrow column, all of one length, as a matrix of normalised rows."""
    vectors = column.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype("float64")
    matrix = flat.reshape(len(vectors), -1)
    return matrix / (np.linalg.norm(matrix, axis=1, keepdims=True) + EPSILON)


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


class Best:
    """The best ``k`` found so far of every message, and the similarity below which nothing more is needed."""

    def __init__(self, queries: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, kth: np.ndarray | None):
        self.queries, self.rows, self.row_ids, self.k = queries, rows, row_ids, k
        # Single precision is off by this much at most, for unit vectors of this length.
        self.slack = (rows.shape[1] + 8) * 2.0**-23 + 10.0**-TIE_PLACES
        self.least = np.full(len(queries), -np.inf)
        if kth is not None:
            self.least = np.where(np.isnan(kth), -np.inf, kth - self.slack)
        none = np.zeros(0, "int64")
        self.kept = none, none, np.zeros(0)
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_found = 0

    def add(self, at: np.ndarray, of: np.ndarray) -> None:
        self.found.append((at, of))
        self.n_found += len(at)

    def settle(self) -> None:
        """Score what was found in double precision and keep the best by similarity, then row number."""
        if not self.n_found:
            return
        at, of = (np.concatenate(c) for c in zip(*self.found, strict=True))
        sims = np.empty(len(at))
        for i in range(0, len(at), 65_536):
            some = slice(i, i + 65_536)
            sims[some] = np.einsum("ij,ij->i", self.queries[at[some]], self.rows[of[some]])
        new = at, of, np.round(sims, TIE_PLACES)
        at, of, sims = (np.concatenate(c) for c in zip(self.kept, new, strict=True))
        order = np.lexsort((self.row_ids[of], -sims, at))
        at, of, sims = at[order], of[order], sims[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        last = place == self.k - 1
        self.least[at[last]] = np.maximum(self.least[at[last]], sims[last] - self.slack)
        self.kept = tuple(c[place < self.k] for c in (at, of, sims))
        self.found, self.n_found = [], 0


def best_of_block(k: int):
    """The kernel of a meeting: similarities, optional price mask, best k per message.

    Similarities are taken in single precision, a tile at a time; only what may reach the k-th best so far is scored in
    double precision. Rows of a block lie by price, so that a price range is a run of them.
    """

    def kernel(messages: pa.Table, products: pa.Table) -> pa.Table:
        schema = pa.schema([("msg_id", pa.int64()), ("row_id", pa.int64()), ("sim", pa.float64())])
        if messages.num_rows == 0 or products.num_rows == 0:
            return schema.empty_table()
        priced = "lo" in messages.column_names
        number = lambda table, name: table[name].to_numpy().astype("float64")
        queries, rows = unit_rows(messages["vec"]), unit_rows(products["vec"])
        slots = products["slot"].to_numpy()
        prices = number(products, "price_eur") if priced else np.zeros(len(rows))
        order = np.lexsort((prices, slots))
        order = order[np.isfinite(rows[order]).all(axis=1)]
        rows, slots, prices = rows[order], slots[order], prices[order]
        kth = number(messages, "kth") if "kth" in messages.column_names else None
        best = Best(queries, rows, products["row_id"].to_numpy()[order], k, kth)
        masks = messages["mask"].to_numpy()
        sound = np.isfinite(queries).all(axis=1)
        narrow_queries, narrow_rows = queries.astype("float32"), rows.astype("float32")
        if priced:
            lo, hi = number(messages, "lo"), number(messages, "hi")

        for slot in np.unique(slots):
            begin, end = np.searchsorted(slots, [slot, slot + 1])
            asking = np.flatnonzero(sound & ((masks >> int(slot)) & 1 == 1))
            first, last = np.full(len(asking), begin), np.full(len(asking), end)
            if priced:
                low, high = lo[asking], hi[asking]
                limited = ~np.isnan(low)
                first[limited] = begin + np.searchsorted(prices[begin:end], low[limited])
                last[limited] = begin + np.searchsorted(prices[begin:end], high[limited], "right")
                wanted = (last > first) & ~(limited & np.isnan(high))
                asking, first, last = asking[wanted], first[wanted], last[wanted]
                # Ranges of like width and place share tiles.
                by_place = np.lexsort((first, np.log2(last - first).astype(int)))
                asking, first, last = asking[by_place], first[by_place], last[by_place]
            for i in range(0, len(asking), TILE_MESSAGES):
                some = slice(i, i + TILE_MESSAGES)
                _tile(best, narrow_queries, narrow_rows, asking[some], first[some], last[some])
                # A few for each message, then what was found is worth sorting.
                if best.n_found > 2 * len(best.kept[0]) + 4 * k * TILE_MESSAGES + 1_000_000:
                    best.settle()
            if best.n_found > 2 * len(best.kept[0]):
                best.settle()
        best.settle()
        at, of, sims = best.kept
        found = {"msg_id": messages["msg_id"].to_numpy()[at], "row_id": best.row_ids[of], "sim": sims}
        return pa.table(found, schema=schema)

    return kernel


def _tile(best: Best, queries: np.ndarray, rows: np.ndarray, asking: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
    """Meet some messages with the rows between the least first and the greatest last of them."""
    begin, end = first.min(), last.max()
    sims = queries[asking] @ rows[begin:end].T
    if first.max() > begin or last.min() < end:
        place = np.arange(begin, end)
        sims[(place < first[:, None]) | (place >= last[:, None])] = -np.inf
    least = best.least[asking]
    new = np.flatnonzero(np.isneginf(least))
    cut = end - begin - best.k
    if len(new) and cut > 0:
        least[new] = np.partition(sims[new], cut, axis=1)[:, cut] - 2 * best.slack
        # This many reach it for certain.
        best.least[asking[new]] = least[new]
    least = np.maximum(least, -2.0).astype("float32") - np.float32(1e-7)
    at, of = np.nonzero(sims >= least[:, None])
    best.add(asking[at], of + begin)


def _parts(rows: Column, size: int) -> Column:
    return F.ceil(rows / size).cast("int")


def _meet(left: DataFrame, right: DataFrame, keys: Sequence[str], kernel, schema: str) -> DataFrame:
    """``kernel`` on both sides' rows of every key.

    A meeting is long for its few bytes, so tasks are those of the session and not merged by size.
    """
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = (side.repartition(tasks, *keys).groupBy(*keys) for side in (left, right))
    return next(sides).cogroup(next(sides)).applyInArrow(kernel, schema)


def _typed(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


# ---- the index


def pivots(products: DataFrame, sizes: DataFrame, group: list[str], block: int) -> DataFrame:
    """group, cell, centre: some vectors of each group, by the hash of their row numbers, one per block at most."""
    wanted = F.least(F.lit(PIVOTS), _parts(F.col("n"), block))
    by_hash = Window.partitionBy(*group).orderBy(F.xxhash64("row_id"), "row_id")
    chosen = products.select(*group, "row_id", "vec").withColumn("cell", F.row_number().over(by_hash))
    chosen = chosen.where(F.col("cell") <= PIVOTS).join(sizes, group).where(F.col("cell") <= wanted)
    return chosen.select(*group, "cell", F.col("vec").alias("centre"))


def dealt_to_cells(products: DataFrame, centres: DataFrame, sizes: DataFrame, group: list[str]) -> DataFrame:
    """``products`` with the cell of the nearest pivot and the angle to it."""
    names = products.columns
    parts = sizes.select(*group, _parts(F.col("n"), DEALT_ROWS).alias("parts"))
    rows = products.join(parts, group).withColumn("part", F.pmod(F.xxhash64("row_id"), F.col("parts")).cast("int"))
    each = centres.join(parts, group).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def deal(rows: pa.Table, centres: pa.Table) -> pa.Table:
        away = angles(unit_rows(rows["vec"]), unit_rows(centres["centre"])) if rows.num_rows else np.zeros((0, 1))
        nearest = away.argmin(axis=1)
        cells = centres["cell"].to_numpy()[nearest] if rows.num_rows else np.zeros(0, "int32")
        out = rows.select(names).append_column("cell", pa.array(cells, "int32"))
        return out.append_column("angle", pa.array(away[np.arange(len(nearest)), nearest], "float64"))

    schema = f"{_typed(products, names)}, cell int, angle double"
    return _meet(rows.drop("parts"), each.drop("parts"), [*group, "part"], deal, schema)


def build(products: DataFrame, sizes: DataFrame, group: list[str], block: int) -> tuple[DataFrame, DataFrame]:
    """Rows of large groups with cell and ring, and a description of every block: its pivot, its ring, what it holds."""
    centres = materialized(pivots(products, sizes, group, block), "pivots")
    cells = materialized(dealt_to_cells(products, centres, sizes, group), "cells")
    placed, _ = numbered(cells, [*group, "cell"], ["angle", "row_id"])
    rows = placed.withColumn("ring", F.floor(F.col("pos") / block).cast("int")).drop("pos")
    about = [F.min("angle").alias("inner"), F.max("angle").alias("outer"), F.count("*").alias("rows")]
    if "price_eur" in products.columns:
        about += [F.min("price_eur").alias("least"), F.max("price_eur").alias("most")]
    # One row per block: few.
    in_order = Window.partitionBy(*group).orderBy("cell", "ring")
    blocks = rows.groupBy(*group, "cell", "ring").agg(*about).withColumn("place", F.row_number().over(in_order) - 1)
    seats = {"hall": F.floor(F.col("place") / HALL_BLOCKS).cast("int"), "slot": F.col("place") % HALL_BLOCKS}
    blocks = materialized(blocks.withColumns(seats).drop("place").join(centres, [*group, "cell"]), "blocks")
    return rows, blocks


# ---- visits


def bounds(messages: pa.Table, blocks: pa.Table) -> np.ndarray:
    """The highest similarity that a message can have to any row of a block it may take; -inf where it may take none."""
    away = angles(unit_rows(messages["vec"]), unit_rows(blocks["centre"]))
    inner, outer = blocks["inner"].to_numpy(), blocks["outer"].to_numpy()
    gap = np.maximum(np.maximum(away - outer, inner - away) - ANGLE_SLACK, 0)
    bound = np.cos(gap)
    if "lo" in messages.column_names:
        lo, hi = (messages[c].to_numpy().astype("float64")[:, None] for c in ("lo", "hi"))
        least, most = (blocks[c].to_numpy().astype("float64") for c in ("least", "most"))
        bound = np.where(np.isnan(lo) | ((least <= hi) & (most >= lo)), bound, -np.inf)
    return bound


def visits(
    messages: DataFrame, blocks: DataFrame, group: list[str], k: int, message_block: int, known: DataFrame | None, halls: bool = False
) -> DataFrame:
    """group, msg_id, cell, ring: where a message goes; with ``halls`` group, msg_id, hall and the mask of blocks there.

    Without ``known``: its most promising blocks, as many as it takes for k rows. With ``known`` (msg_id, kth, the least
    similarity that can still matter): all with a bound that reaches it.
    """
    size = messages.groupBy(*group).agg(_parts(F.count("*"), message_block).alias("parts"))
    size = materialized(size, "message-parts")
    sides = messages.join(size, group).withColumn("part", F.pmod(F.xxhash64("msg_id"), F.col("parts")).cast("int"))
    each = blocks.join(size, group).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    if known is not None:
        sides = sides.join(known, "msg_id", "left")
    later = known is not None
    place = ["hall", "mask"] if halls else ["cell", "ring"]
    schema = f"{_typed(messages, [*group, 'msg_id'])}, {place[0]} int, {place[1]} int"

    def choose(messages: pa.Table, blocks: pa.Table) -> pa.Table:
        if messages.num_rows == 0 or blocks.num_rows == 0:
            wanted = np.zeros((messages.num_rows, blocks.num_rows), bool)
        else:
            bound = bounds(messages, blocks)
            if later:
                kth = messages["kth"].to_numpy().astype("float64")[:, None]
                wanted = np.isnan(kth) | (bound + 10.0**-TIE_PLACES >= kth)
            else:
                best = np.argsort(-bound, axis=1, kind="stable")
                sizes = blocks["rows"].to_numpy()[best]
                wanted = np.zeros(bound.shape, bool)
                np.put_along_axis(wanted, best, np.cumsum(sizes, axis=1) - sizes < k, axis=1)
            wanted &= np.isfinite(bound)
        if halls:
            hall, of_hall = np.unique(blocks["hall"].to_numpy(), return_inverse=True)
            masks = np.zeros((messages.num_rows, len(hall)), "int64")
            for block, (h, slot) in enumerate(zip(of_hall, blocks["slot"].to_pylist(), strict=True)):
                masks[:, h] |= wanted[:, block].astype("int64") << slot
            at, of = np.nonzero(masks)
            where = [pa.array(hall[of], "int32"), pa.array(masks[at, of], "int32")]
        else:
            at, of = np.nonzero(wanted)
            where = [blocks[c].take(pa.array(of)) for c in place]
        return pa.table([messages[c].take(pa.array(at)) for c in (*group, "msg_id")] + where, names=[*group, "msg_id", *place])

    return _meet(sides.drop("parts"), each.drop("parts"), [*group, "part"], choose, schema)


def score(visiting: DataFrame, rows: DataFrame, group: list[str], k: int, message_block: int) -> DataFrame:
    """Best k per meeting of messages (with hall and mask) and the rows of that hall (with slot)."""
    keys = [*group, "hall"]
    parts = visiting.groupBy(*keys).agg(_parts(F.count("*"), message_block).alias("parts"))
    parts = materialized(parts, "meeting-parts")
    left = visiting.join(parts, keys).withColumn("part", F.pmod(F.xxhash64("msg_id"), F.col("parts")).cast("int"))
    right = rows.join(parts, keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return _meet(left.drop("parts"), right.drop("parts", "angle", "cell", "ring"), [*keys, "part"], best_of_block(k), HITS)


def foremost(products: DataFrame, group: list[str], k: int) -> DataFrame:
    """Of the rows of a group that are equal in vector and price, the ``k`` lowest: no other can be among the best ``k`` of a message.

    Every task cuts its own rows first, so a vector that a third of all rows have is no large key.
    """
    like = [*group, "vec", *(c for c in products.columns if c == "price_eur")]
    by_id = Window.partitionBy(*like).orderBy("row_id")
    return products.withColumn("_place", F.row_number().over(by_id)).where(F.col("_place") <= k).drop("_place")


def nearest(
    messages: DataFrame,
    products: DataFrame,
    k: int,
    group: list[str],
    message_block: int = BLOCK_MESSAGES,
    product_block: int = BLOCK_PRODUCTS,
) -> DataFrame:
    """Hits ``(msg_id, row_id, sim)`` with the best ``k`` of every message among them.

    ``messages``: group, msg_id, vec and, for a price mask, lo and hi. ``products``: group, row_id, vec and price_eur. A
    message with rows in several groups is asked in all of them. Vectors of products are computed once and written.
    """
    wanted = messages.select(*group).distinct()
    products = materialized(foremost(products.join(wanted, group, "left_semi"), group, k), "foremost")
    sizes = materialized(products.groupBy(*group).agg(F.count("*").alias("n")), "group-sizes")
    large = sizes.where(F.col("n") > product_block)
    few = sizes.where(F.col("n") <= product_block).select(*group)
    # No pivots where there is one block; written sizes let the planner broadcast them if they are small.
    hall = F.lit(0).alias("hall")
    near = score(
        messages.join(few, group, "left_semi").select("*", hall, F.lit(1).alias("mask")),
        products.join(few, group, "left_semi").select("*", hall, F.lit(0).alias("slot")),
        group, k, message_block,
    )
    if large.isEmpty():
        return near
    asking = materialized(messages.join(large.select(*group), group, "left_semi"), "asking")
    sought = products.join(large.select(*group), group, "left_semi")
    rows, blocks = build(sought, large, group, product_block)
    rows = rows.join(blocks.select(*group, "cell", "ring", "hall", "slot"), [*group, "cell", "ring"])
    at_once = min(message_block, CHOOSING_MESSAGES)
    keys = [*group, "msg_id"]
    first = materialized(visits(asking, blocks, group, k, at_once, None, halls=True), "first-visits")
    found = near.unionByName(score(asking.join(first, keys), rows, group, k, message_block))
    found = materialized(found, "first-hits")
    by_sim = Window.partitionBy("msg_id").orderBy(F.desc("sim"), "row_id")
    kth = found.withColumn("rank", F.row_number().over(by_sim)).where(F.col("rank") <= k).where(F.col("rank") == k)
    kth = materialized(kth.select("msg_id", F.col("sim").alias("kth")), "kth")
    seen = first.withColumnRenamed("mask", "seen")
    others = visits(asking, blocks, group, k, at_once, kth, halls=True).join(seen, [*keys, "hall"], "left")
    others = others.withColumn("mask", F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0))))).where("mask != 0")
    others = asking.join(others.drop("seen"), keys).join(kth, "msg_id", "left")
    return found.unionByName(score(others, rows, group, k, message_block))
