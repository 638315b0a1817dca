"""Exact retrieval and candidate rules against brute force, with one tenant holding most rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import candidates as cand
from shelfwise.operators import metric_index
from shelfwise.operators import retrieval as ret
from shelfwise.operators.metric_index import nearest
from shelfwise.session import materialized

CATEGORIES = ["a", "b", "c", None]


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(5)
    products, messages = [], []
    for i in range(160):
        tenant = "hot" if i % 3 else f"t{i % 4}"
        price = None if i % 17 == 0 else float(rng.choice([0.0, 9.99, 10.0, 10.001, 25.5, 99.9, 2e7, rng.uniform(0, 300)]))
        vec = rng.normal(size=6) if i % 5 else np.ones(6)
        products.append((tenant, i, CATEGORIES[i % 4], price, [float(np.float32(x)) for x in vec]))
    for i in range(60):
        tenant = "hot" if i % 3 else f"t{i % 4}"
        kind = i % 5
        lo, hi = [(None, None), (0.0, 30.0), (9.995, 10.0), (5.0, 3e7), (1.0, 1.5)][kind]
        hints = [[], ["a"], ["b", "zzz"], ["c", "a"]][i % 4]
        messages.append((tenant, i, lo, hi, hints, [float(np.float32(x)) for x in rng.normal(size=6)]))
    p = spark.createDataFrame(products, "tenant_id string, row_id long, category string, price_eur double, vec array<float>").cache()
    m = spark.createDataFrame(messages, "tenant_id string, msg_id long, lo double, hi double, hints array<string>, vec array<float>").cache()
    return products, messages, p, m


def allowed(m, p):
    price = m[2] is None or (p[3] is not None and m[2] <= p[3] <= m[3])
    return price and (not m[4] or p[2] in m[4])


def ranking(m, ps, k):
    q = np.array(m[5]) / (np.linalg.norm(m[5]) + 1e-12)
    score = lambda p: round(float(np.array(p[4]) / (np.linalg.norm(p[4]) + 1e-12) @ q), 9)
    return [p[1] for p in sorted(ps, key=lambda p: (-score(p), p[1]))[:k]]


def as_lists(df):
    out = {}
    for r in df.orderBy("msg_id", "rank").collect():
        out.setdefault(r["msg_id"], []).append(r["row_id"])
    return out


def test_candidate_pairs_and_counts(world):
    products, messages, p, m = world
    pairs = sorted((r["msg_id"], r["row_id"]) for r in cand.message_candidates(m, p).collect())
    expected = sorted((x[1], y[1]) for x in messages for y in products if x[0] == y[0] and allowed(x, y))
    assert pairs == expected
    counts = {r["msg_id"]: (r["n_match"], r["n_candidates"]) for r in cand.candidates_or_all(m, p).collect()}
    for x in messages:
        own = [y for y in products if y[0] == x[0]]
        n = sum(allowed(x, y) for y in own)
        assert counts[x[1]] == (n, n or len(own))


@pytest.mark.parametrize(("first", "last"), [(0, 0), (3, 2), (0, 3), (1, 14), (5, 99_999), (16, 63), (0, 10**9)])
def test_cover_is_disjoint_and_complete(spark, first, last):
    one = spark.createDataFrame([(first, last)], "a long, b long")
    cells = cand.with_cover(one, "a", "b").collect()
    spans = sorted((c["cell"] * cand.FANOUT ** c["level"], (c["cell"] + 1) * cand.FANOUT ** c["level"] - 1) for c in cells)
    assert len(cells) < 120
    if first > last:
        assert spans == []
        return
    assert spans[0][0] == first and spans[-1][1] == last
    assert all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("block", [1000, 7])
def test_topk_is_exact_for_any_block_size(world, block):
    products, messages, p, m = world
    asked = materialized(m.select("tenant_id", "msg_id", "vec"), "messages")
    hits = nearest(asked, p.select("tenant_id", "row_id", "vec"), 5, ["tenant_id"], message_block=block, product_block=block + 4)
    got = as_lists(ret.keep_best(hits, 5))
    for x in messages:
        assert got[x[1]] == ranking(x, [y for y in products if y[0] == x[0]], 5)


def test_price_masks_in_many_blocks(world):
    """With masks, a message may find fewer than k in the block it visits first, and looks on."""
    products, messages, p, m = world
    asked = materialized(m.select("tenant_id", "msg_id", "vec", "lo", "hi"), "messages")
    hits = nearest(asked, p.select("tenant_id", "row_id", "vec", "price_eur"), 4, ["tenant_id"], message_block=9, product_block=11)
    got = as_lists(ret.keep_best(hits, 4))
    for x in messages:
        own = [y for y in products if y[0] == x[0] and allowed((*x[:4], []), y)]
        assert got.get(x[1], []) == ranking(x, own, 4)


def test_hot_tenant_skips_blocks(spark):
    """A tenant with nearly all rows: results are exact, and most meetings of messages and blocks do not take place."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 12))
    vectors = centres[rng.integers(0, 60, 24_000)] + rng.normal(size=(24_000, 12)) * 0.15
    vectors[:6000] = vectors[0]  # a quarter are copies of one vector
    asked = np.concatenate([vectors[rng.integers(0, 24_000, 150)] + rng.normal(size=(150, 12)) * 0.05, vectors[:2]])
    rows = [("hot" if i % 50 else "small", i, v) for i, v in enumerate(vectors.astype("float32").tolist())]
    p = materialized(spark.createDataFrame(rows, "tenant_id string, row_id long, vec array<float>").repartition(6), "products")
    m = spark.createDataFrame([("hot", i, v) for i, v in enumerate(asked.astype("float32").tolist())], "tenant_id string, msg_id long, vec array<float>")
    m = materialized(m, "messages")
    got = as_lists(ret.keep_best(nearest(m, p, 5, ["tenant_id"], 64, 500), 5))
    unit = lambda x: x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)
    ids = np.array([i for i in range(24_000) if i % 50])
    sims = np.round(unit(asked.astype("float32").astype("float64")) @ unit(vectors.astype("float32").astype("float64")).T, 9)[:, ids]
    for i in range(len(asked)):
        assert got[i] == ids[np.lexsort((ids, -sims[i]))[:5]].tolist()

    sizes = materialized(p.groupBy("tenant_id").agg(F.count("*").alias("n")), "sizes").where("n > 500")
    placed, blocks = metric_index.build(p.join(sizes.select("tenant_id"), "tenant_id"), sizes, ["tenant_id"], 500)
    assert placed.groupBy("cell", "ring").count().agg(F.max("count")).head()[0] <= 500
    assert blocks.where("inner = outer and rows = 500").count() >= 10  # the copies are rings of their own
    known = spark.createDataFrame([(i, float(np.sort(sims[i])[-5])) for i in range(len(asked))], "msg_id long, kth double")
    visits = metric_index.visits(m, blocks, ["tenant_id"], 5, 64, known).groupBy("msg_id").count()
    assert visits.agg(F.avg("count")).head()[0] < blocks.count() / 4


@pytest.mark.parametrize("few", [0, 6, 1000])
def test_prefilter_and_overfetch(world, few):
    products, messages, p, m = world
    pre, over = as_lists(ret.retrieve_prefilter(m, p, 4, few=few)), as_lists(ret.retrieve_overfetch(m, p, 4))
    for x in messages:
        own = [y for y in products if y[0] == x[0]]
        ok = {y[1] for y in own if allowed(x, y)} or {y[1] for y in own}
        assert pre[x[1]] == [i for i in ranking(x, own, len(own)) if i in ok][:4]
        assert over.get(x[1], []) == [i for i in ranking(x, own, 24) if i in ok][:4]
        if len(own) <= ret.overfetch_size(4):
            assert over.get(x[1], []) == pre[x[1]]


def test_small_index_order(spark):
    p = spark.createDataFrame([("t", 0, [1.0, 0.0]), ("t", 1, [0.0, 1.0]), ("t", 2, [1.0, 1.0])], "tenant_id string, row_id long, vec array<float>")
    q = F.array(F.lit(1.0), F.lit(0.0))
    assert [r["row_id"] for r in ret.single_query_topk(p, q, 2).collect()] == [0, 2]
