"""Exact best inner products by an index of postings in order of impact, read score at a time.

The index is cut into blocks of some ``BLOCK_ROWS`` vectors. In a block every dimension has a posting list, ordered by weight; a run of
equal quantised weight is a segment. A query's gain from a segment is its own weight times the segment's best weight, above the least gain the
dimension can bring. A block is read for many queries together: segments of all dimensions by descending gain, which is the most that one of the queries has
from them. Weights that are read lie within their segment, the others within the segments left in the dimension; products of these
limits with the queries are bounds of every vector's score. Reading stops on proof: when few vectors can still be among a query's best k, since all
others have a bound below the k-th best score that is certain already. Those few are scored again, exactly.
A block that proves nothing is read to its end; nothing is dropped.

Queries are cut into blocks, too. Every block of queries meets every block of the index, which is one bounded task slice, and sends back its best k;
a rank with partial limits merges them. A block of the index is shipped once per ``BLOCK_QUERIES`` queries. The k-th best score that a task has found for
a query is certain in the blocks that it reads later; what is below is not sent back.

Defined cases: vectors that are null or hold null or non-finite components take no part; a shorter vector has weight 0 in the dimensions it lacks
(an empty one scores 0 everywhere); rows with the query's id are left out, whatever their vector; a query id with several different vectors is
one query each; rows without an id can be found and come last among equal scores; repeated rows are found as often as they stand; an empty table gives no rows;
other columns are not looked at. Scores are integers of 64 bits; a block whose scores could be larger is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.session import materialized

SCALE = 1024
BLOCK_ROWS = 4096
BLOCK_QUERIES = 2048
# A segment spans 2 ** SHIFT weights.
SHIFT = 5
# Shares of the postings of a block after which it is looked whether anything is proved.
STEPS = (0.25, 0.5, 0.75, 0.9, 1.0)
# Scoring what is left costs less than reading on when it is at most this share of the block.
FEW = 0.05
# Bounds computed, and weights gathered for exact scores, at a time.
TILE, GATHERED = 2**18, 2**22
# Vectors of high bounds that are scored to begin with, for each of the k.
PROBES = 8
# Below any score.
NONE = -np.inf


class Block:
    """Vectors of a block of the index and its segments, in the form they are stored in."""

    def __init__(self, weights: np.ndarray, order: np.ndarray):
        self.weights = weights
        n, dims = weights.shape
        ordered = np.take_along_axis(weights, order.T.astype("int64"), axis=0).T if n else weights.T
        steps = ordered >> SHIFT
        new = np.ones(steps.shape, bool)
        new[:, 1:] = steps[:, 1:] != steps[:, :-1]
        self.dim, at = np.nonzero(new)
        # Where a segment starts in the lists one after the other, how long it is, its least and its greatest weight.
        start = self.dim * n + at
        self.size = np.diff(np.append(start, dims * n))
        flat = ordered.ravel()
        self.low, self.high = (flat[i].astype("float64") for i in (start, start + self.size - 1))
        self.least, self.most = (ordered[:, i].astype("float64") if n else np.zeros(dims) for i in (0, -1))
        # Postings, as places in a matrix of a row per dimension.
        self.order = order
        self.postings = (order + np.arange(dims)[:, None] * n).ravel()

    @classmethod
    def build(cls, weights: np.ndarray) -> Block:
        return cls(weights, np.argsort(weights, axis=0, kind="stable").T.astype("uint16"))

    def best(self, query: np.ndarray, k: int, left_out: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and exact scores of all vectors that can be among the best ``k``, and the number of postings read."""
        own = np.flatnonzero(left_out)
        found = list(self.search(query[None], k, np.zeros(len(own), "int64"), own, np.full(1, NONE)))
        return found[0][1:]

    def search(
        self, queries: np.ndarray, k: int, out_query: np.ndarray, out_place: np.ndarray, certain: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """Numbers of queries, places and exact scores of all pairs that can be among a query's best ``k``, some queries at a time, and the postings read.

        The pairs (``out_query``, ``out_place``) are left out. Scores below ``certain``, one per query, are not looked for.
        """
        n, dims = self.weights.shape
        top = max(np.abs(self.least).max(initial=0), np.abs(self.most).max(initial=0))
        # Bounds are sums of whole numbers: exact below 2 ** 24 in single precision, below 2 ** 53 in double.
        reach = 2 * top * float(np.abs(queries).sum(axis=1).max(initial=0))
        kind = "float32" if reach < 2**24 else "float64"
        slack = 0.0 if reach < 2**53 else 4.0 * dims
        q, weights = queries.astype(kind), self.weights.astype(kind)
        up, certain = np.maximum(q, 0), certain.copy()
        rises, falls = up.max(axis=0, initial=0).astype("float64"), -q.min(axis=0, initial=0).astype("float64")
        gain = np.maximum(rises[self.dim] * (self.high - self.least[self.dim]), falls[self.dim] * (self.most[self.dim] - self.low))
        # Segments of dimensions that bring nothing need no reading.
        worth = np.flatnonzero(gain > 0)
        by_gain = worth[np.argsort(-gain[worth], kind="stable")]
        read = np.cumsum(self.size[by_gain])
        cuts = np.unique(np.searchsorted(read, np.multiply(STEPS, read[-1] if len(read) else 0)) + 1)
        # Least weight that a posting can have, and the room above it.
        low, room = np.zeros((dims, n), kind), np.zeros((dims, n), kind)
        limits = np.full(len(self.dim), np.nan), np.full(len(self.dim), np.nan)
        unread, going, begin = np.ones(len(self.dim), bool), np.arange(len(q)), 0
        for end in cuts:
            unread[by_gain[begin:end]] = False
            limits = self._limit(unread, limits, low, room)
            begin, postings = end, int(read[min(end, len(read)) - 1]) if len(read) else 0
            more = []
            for some in np.array_split(going, -(-len(going) * n // TILE)):
                bound = q[some] @ low
                bound += up[some] @ room
                out = self._left_out(some, len(q), out_query, out_place)
                bound[out] = NONE
                blank = np.flatnonzero(certain[some] == NONE)
                if len(blank) and n > PROBES * k:
                    certain[some[blank]] = probe(q[some[blank]], weights, bound[blank], k)
                left = bound >= np.maximum(certain[some] - slack, np.finfo(kind).min).astype(kind)[:, None]
                proved = (left.sum(axis=1) <= FEW * n) | (end >= len(by_gain))
                more.append(some[~proved])
                rows, places = np.divmod(np.flatnonzero(left & proved[:, None]), n)
                if proved.any():
                    yield some[rows], places, exact(q, weights, some[rows], places).astype("int64"), postings
            going = np.concatenate(more)
            if not len(going):
                break

    def _limit(self, unread: np.ndarray, before: tuple, low: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest weights of segments, their own if read, else of all that is unread in the dimension; changed ones are put into ``low``
        and ``room`` by their postings."""
        first, last = np.full(len(self.least), np.inf), np.full(len(self.least), -np.inf)
        np.minimum.at(first, self.dim[unread], self.low[unread])
        np.maximum.at(last, self.dim[unread], self.high[unread])
        least, most = np.where(unread, first[self.dim], self.low), np.where(unread, last[self.dim], self.high)
        new = (least != before[0]) | (most != before[1])
        at = self.postings[np.repeat(new, self.size)]
        low.ravel()[at] = np.repeat(least[new], self.size[new])
        room.ravel()[at] = np.repeat((most - least)[new], self.size[new])
        return least, most

    @staticmethod
    def _left_out(some: np.ndarray, queries: int, out_query: np.ndarray, out_place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs left out of the queries ``some``, by their place in these."""
        place = np.full(queries, -1)
        place[some] = np.arange(len(some))
        rows = place[out_query]
        return rows[rows >= 0], out_place[rows >= 0]


def exact(queries: np.ndarray, weights: np.ndarray, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Scores of the pairs (row of ``queries``, place)."""
    scores, some = np.empty(len(rows), queries.dtype), max(1, GATHERED // max(1, queries.shape[1]))
    for at in range(0, len(rows), some):
        part = slice(at, at + some)
        scores[part] = np.einsum("ij,ij->i", weights[places[part]], queries[rows[part]])
    return scores


def probe(queries: np.ndarray, weights: np.ndarray, bound: np.ndarray, k: int) -> np.ndarray:
    """A score of each query that ``k`` vectors reach for certain: the k-th best exact one among some vectors of the highest bounds."""
    places = np.argpartition(bound, -PROBES * k, axis=1)[:, -PROBES * k :]
    rows = np.repeat(np.arange(len(queries)), PROBES * k)
    scores = exact(queries, weights, rows, places.ravel()).astype("float64").reshape(places.shape)
    scores[np.take_along_axis(bound, places, axis=1) == NONE] = NONE
    return np.partition(scores, -k, axis=1)[:, -k]


def packed(values: np.ndarray) -> tuple[bytes, str]:
    """Integers in as few bytes as they fit into."""
    for kind in ("int16", "int32"):
        if not values.size or (np.abs(values).max() <= np.iinfo(kind).max):
            return values.astype(kind).tobytes(), kind
    return values.tobytes(), "int64"


def padded(lists: pa.ListArray, dims: int) -> np.ndarray:
    """Integers of lists as rows of ``dims``: cut off there, or filled up by zeros."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    rows, columns = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(sizes), dims), "int64")
    out[rows[columns < dims], columns[columns < dims]] = flat[columns < dims]
    return out


def numbers(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which ids are known, and the ids, 0 for others."""
    return ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)


def own_places(asked: pa.Array, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the queries ``asked`` and the places of a block that have the same id."""
    known, number = numbers(ids)
    places = np.flatnonzero(known)
    places = places[np.argsort(number[places], kind="stable")]
    given, query = numbers(asked)
    begin, end = (np.searchsorted(number[places], query, side=side) for side in ("left", "right"))
    sizes = np.where(given, end - begin, 0)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begin, sizes)
    return np.repeat(np.arange(len(query)), sizes), places[at]


def best_of(rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs are the best ``k`` of their query, and their ranks from 0; of equal scores the first pairs."""
    order = np.lexsort((-scores, rows))
    of = rows[order]
    new = np.append(True, of[1:] != of[:-1])[: len(of)]
    rank = np.arange(len(of)) - np.maximum.accumulate(np.where(new, np.arange(len(of)), 0))
    return order[rank < k], rank[rank < k]


# ---- blocks as rows


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, w): floor of the scaled components, of vectors whose components are all finite."""
    wrong = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    usable = F.col("embedding").isNotNull() & ~F.exists("embedding", wrong)
    whole = F.transform("embedding", lambda e: F.floor(e.cast("double") * scale).cast("long"))
    return vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("w"))


def _dealt(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """Rows with a block number; equal rows are dealt out, too, by where they are read from."""
    blocks = max(1, -(-rows.count() // size))
    return rows.withColumn(name, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")), blocks


def build_index(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """Written index of ``rows`` (vec_id, w), read from files: a row per block, and the number of blocks."""
    dealt, blocks = _dealt(rows, block_rows, "block")

    # A posting numbers a row of its block in 16 bits: 16 times the rows that the hash deals out.
    def build(table: pa.Table) -> pa.Table:
        # Rows of equal score rank by id, those without one last.
        table = table.sort_by("vec_id").combine_chunks()
        lists = table.column("w").combine_chunks()
        dims = pc.max(pc.list_value_length(lists)).as_py()
        weights = padded(lists, dims)
        data, kind = packed(weights)
        return pa.table(
            {
                "block": pa.array([table.column("block")[0].as_py()], "int32"),
                "ids": pa.array([table.column("vec_id").to_pylist()], pa.list_(pa.int64())),
                "dims": pa.array([dims], "int32"),
                "kind": [kind],
                "weights": [data],
                "postings": [Block.build(weights).order.tobytes()],
            }
        )

    rows = dealt.groupBy("block").applyInArrow(build, "block int, ids array<long>, dims int, kind string, weights binary, postings binary")
    return materialized(rows, "impact-index"), blocks


def top_k(
    vectors: DataFrame, queries: Column, k: int = 10, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES
) -> DataFrame:
    """query_id, rank, vec_id, score: the best ``k`` rows of ``vectors`` (vec_id, embedding) for those that ``queries`` selects."""
    rows = materialized(integer_vectors(vectors), "integer-vectors")
    index, blocks = build_index(rows, block_rows)
    asked = materialized(rows.where(queries).select(F.col("vec_id").alias("query_id"), "w").distinct(), "queries")
    asked, groups = _dealt(asked, block_queries, "asked")
    asked = asked.withColumn("mark", F.xxhash64("w"))
    asked = asked.groupBy("asked").agg(F.collect_list(F.struct("query_id", "mark", "w")).alias("queries"))
    # Every block of queries meets every block of the index: the numbers say where.
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    index = index.withColumn("asked", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The best scores that this task has found for the queries of a block.
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                at = {c: batch.column(c)[row] for c in batch.schema.names}
                ids, dims, given = at["ids"].values, at["dims"].as_py(), at["queries"].values
                weights = np.frombuffer(at["weights"].as_buffer(), at["kind"].as_py()).reshape(len(ids), dims)
                block = Block(weights, np.frombuffer(at["postings"].as_buffer(), "uint16").reshape(dims, len(ids)))
                wanted = padded(given.field("w"), dims)
                if np.abs(weights.astype("float64")).max(initial=0) * np.abs(wanted.astype("float64")).sum(axis=1).max(initial=0) >= 2**53:
                    raise OverflowError("scores of these vectors do not fit")
                best = found.setdefault(at["asked"].as_py(), np.full((len(given), k), NONE))
                hits = []
                for rows, places, scores, _ in block.search(wanted, k, *own_places(given.field("query_id"), ids), best[:, -1].copy()):
                    kept, rank = best_of(rows, scores, k)
                    rows, places, scores = rows[kept], places[kept], scores[kept]
                    here = np.full(best.shape, NONE)
                    here[rows, rank] = scores
                    best = np.sort(np.concatenate([best, here], axis=1), axis=1)[:, : -k - 1 : -1]
                    hits.append((rows, places, scores))
                found[at["asked"].as_py()] = best
                rows, places, scores = (np.concatenate(c) for c in zip(*hits))
                columns = [given.field(c).take(pa.array(rows)) for c in ("query_id", "mark")]
                columns += [ids.take(pa.array(places)), pa.array(scores, "int64")]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "mark", "vec_id", "score"])

    # The planner does not see how blocks of queries are multiplied and would send them to every task.
    pairs = index.join(asked.hint("merge"), ["block", "asked"]).select("asked", "ids", "dims", "kind", "weights", "postings", "queries")
    hits = pairs.mapInArrow(search, "query_id long, mark long, vec_id long, score long")
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
