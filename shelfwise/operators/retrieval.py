"""Exact cosine top-k for many messages at once.

Messages meet bounded blocks of products (``metric_index``), each meeting one small matrix product in
its own task slice, which emits only its best k per message; a per-message rank then merges them. A
tenant that holds a third of all rows has as many blocks as its size asks for, messages skip the
blocks that cannot hold one of their best, and no (message, product) pair leaves a meeting unless it
is among the best k there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import DEFAULT_TOP_K
from ..functions.vector import cosine_similarity
from ..session import materialized
from .candidates import (
    effective_filters,
    matches,
    message_candidates,
    product_scopes,
    wanted_scopes,
)
from .metric_index import HITS, TIE_PLACES, nearest, unit_rows

# Up to this many candidates, a message is scored pair by pair.
FEW_CANDIDATES = 128


def _similarities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sims = np.zeros(batch.num_rows)
        lengths = pc.list_value_length(batch["m_vec"]).to_numpy(zero_copy_only=False)
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            some = batch.take(pa.array(at))
            sides = (unit_rows(pa.chunked_array([some[c]])) for c in ("m_vec", "p_vec"))
            sims[at] = np.einsum("ij,ij->i", *sides)
        columns = [batch["msg_id"], batch["row_id"], pa.array(np.round(sims, TIE_PLACES))]
        yield pa.RecordBatch.from_arrays(columns, names=["msg_id", "row_id", "sim"])


def pair_hits(pairs: DataFrame, messages: DataFrame, products: DataFrame) -> DataFrame:
    """Similarity of given ``(tenant_id, msg_id, row_id)`` pairs."""
    p_side = products.select("tenant_id", "row_id", F.col("vec").alias("p_vec"))
    m_side = messages.select("tenant_id", "msg_id", F.col("vec").alias("m_vec"))
    # Narrow pairs are dealt out before vectors join them: a message has few, so no key is large.
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.repartition(tasks, "tenant_id", "msg_id")
    both = dealt.join(m_side, ["tenant_id", "msg_id"]).join(p_side, ["tenant_id", "row_id"])
    return both.select("msg_id", "row_id", "m_vec", "p_vec").mapInArrow(_similarities, HITS)


def keep_best(found: DataFrame, k: int) -> DataFrame:
    """First ``k`` hits per message by similarity, then row number."""
    order = Window.partitionBy("msg_id").orderBy(F.desc("sim"), F.asc("row_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def own_k(column: str) -> Column:
    return F.coalesce(F.col(column).cast("int"), F.lit(DEFAULT_TOP_K))


def largest_k(messages: DataFrame, k: int | str) -> int:
    """``k``, or the largest one in the column of that name; what a message gets beyond its own is cut by ``within_own_k``."""
    return k if isinstance(k, int) else max(1, messages.agg(F.max(own_k(k))).head()[0] or 1)


def within_own_k(
    ranked: DataFrame, messages: DataFrame, k: int | str, size: Callable[[Column], Column] = lambda own: own
) -> DataFrame:
    """Hits whose rank is at most ``size`` of their message's own k; a number leaves ``ranked`` as it is."""
    if isinstance(k, int):
        return ranked
    own = messages.select("msg_id", size(own_k(k)).alias("_k"))
    return ranked.join(own, "msg_id").where(F.col("rank") <= F.col("_k")).drop("_k")


def cosine_topk(messages: DataFrame, products: DataFrame, k: int | str) -> DataFrame:
    """Best ``k`` of the tenant's whole catalog; ``k`` is a number or the column of ``messages`` that holds it (null: the default)."""
    # Read several times, parsed and embedded once.
    asked = materialized(messages.select("tenant_id", "msg_id", "vec"), "asked")
    top = largest_k(messages, k)
    found = nearest(asked, products.select("tenant_id", "row_id", "vec"), top, ["tenant_id"])
    return within_own_k(keep_best(found, top), messages, k)


def overfetch_size(k: int) -> int:
    return max(6 * k, 24)


def retrieve_overfetch(
    messages: DataFrame, products: DataFrame, k: int | str = DEFAULT_TOP_K
) -> DataFrame:
    """Rank first, filter after: best ``max(6k, 24)`` of the catalog, then the candidates in them.

    May return fewer than ``k`` products, even none. The candidate rule is applied to the ranked
    hits only, so no candidate list is built. ``k`` may name a column, as in ``cosine_topk``; each message then
    has its own number of ranked hits, too.
    """
    filters = effective_filters(messages, products).drop("n_match")
    top = largest_k(messages, k)
    ranked = cosine_topk(messages, products, overfetch_size(top))
    ranked = within_own_k(ranked, messages, k, lambda own: F.greatest(own * 6, F.lit(24))).drop("rank")
    facts = products.select("tenant_id", "row_id", "category", "price_eur")
    allowed = matches(*[F.col(c) for c in ("price_eur", "category", "lo", "hi", "hints")])
    kept = ranked.join(filters, "msg_id").join(facts, ["tenant_id", "row_id"]).where(allowed)
    return within_own_k(keep_best(kept.select("msg_id", "row_id", "sim"), top), messages, k)


def retrieve_prefilter(
    messages: DataFrame, products: DataFrame, k: int | str = DEFAULT_TOP_K, few: int = FEW_CANDIDATES
) -> DataFrame:
    """Filter first, rank inside the candidates.

    The number of candidates of every message is known before any vector is touched. Messages with
    a few candidates are scored pair by pair, whatever the size of the catalog. The others meet the
    blocks of their categories that can still hold one of their best, and the price range masks
    inside a block. Groups nobody asks for are dropped before the shuffle. ``k`` may name a column, as in ``cosine_topk``.
    """
    # Narrow, and needed several times: computed once.
    own = [] if isinstance(k, int) else [k]
    messages = materialized(messages.select("tenant_id", "msg_id", "lo", "hi", "hints", "vec", *own), "messages")
    products = products.select("tenant_id", "row_id", "category", "price_eur", "vec")
    products = materialized(products, "products")
    filters = materialized(effective_filters(messages, products), "filters")
    selective = F.col("n_match").between(1, few)
    pairs = pair_hits(message_candidates(filters.where(selective), products), messages, products)

    broad = filters.where(~selective)
    scope = F.explode(wanted_scopes(F.col("hints"))).alias("scope")
    vectors = messages.select("tenant_id", "msg_id", "vec").join(broad, ["tenant_id", "msg_id"])
    m_side = vectors.select("tenant_id", scope, "msg_id", "vec", "lo", "hi")
    p_side = products.select(
        "tenant_id",
        F.explode(product_scopes(F.col("category"))).alias("scope"),
        "row_id", "vec", "price_eur",
    )
    top = largest_k(messages, k)
    near = nearest(m_side, p_side, top, ["tenant_id", "scope"])
    return within_own_k(keep_best(pairs.unionByName(near), top), messages, k)


def single_query_topk(products: DataFrame, query: Column, k: int) -> DataFrame:
    """Best ``k`` products for one query vector."""
    sim = F.round(cosine_similarity(F.col("vec"), query), TIE_PLACES)
    return (
        products.select("row_id", sim.alias("sim")).orderBy(F.desc("sim"), F.asc("row_id")).limit(k)
    )
