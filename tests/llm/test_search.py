"""The impact-ordered index against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import impact_index
from shelfwise.llm.common import tuned

SCHEMA = "vec_id long, embedding array<float>, label string, w string, rank int, block int, score string"


def brute_force(rows, k):
    """{query id: the score lists of its different vectors, by rank}"""
    usable = []
    for vec_id, x in rows:
        if x is not None and all(e is not None and np.isfinite(e) for e in x):
            usable.append((vec_id, tuple(int(np.floor(1024.0 * float(np.float32(e)))) for e in x)))
    out = {}
    for query, w in sorted({u for u in usable if u[0] is not None and u[0] % 100 == 0}):
        scored = [(-sum(a * b for a, b in zip(w, v)), i is None, i or 0) for i, v in usable if i != query]
        best = [(None if missing else i, -s) for s, missing, i in sorted(scored)[:k]]
        out.setdefault(query, []).append(best)
    return out


def test_every_odd_vector(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(160)]
    rows += [(0, None), (200, None), (300, [1.0, None]), (400, [float("nan")]), (500, [float("inf"), 1.0]), (600, []), (700, [0.5]), (None, [3.0] * 6), (None, [3.0] * 6)]
    rows += [(100, [9.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (7, rows[7][1]), (7, rows[7][1]), (33, [0.0] * 6), (34, [0.0] * 6), (800, [0.0] * 6), (-100, [1.0, 2.0] * 5)]
    df = tuned(spark).createDataFrame([(i, x, "l", "w", 1, 2, None) for i, x in rows], SCHEMA).repartition(3)
    for sizes in ({}, {"block_rows": 20, "block_queries": 2}):
        found = impact_index.top_k(df, F.col("vec_id") % 100 == 0, 5, **sizes).collect()
        got: dict = {}
        for r in found:
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        expected = brute_force(rows, 5)
        assert got.keys() == expected.keys()
        for query, lists in expected.items():
            assert sorted(got[query], key=repr) == sorted(((r, i, s) for best in lists for r, (i, s) in enumerate(best, 1)), key=repr)


def test_nothing_to_search(spark):
    assert impact_index.top_k(tuned(spark).createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).collect() == []
    one = spark.createDataFrame([(100, [1.0], None, None, None, None, None)], SCHEMA)
    assert impact_index.top_k(one, F.col("vec_id") % 100 == 0).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_reading_stops_on_proof(seed):
    """Whatever is read, the best are among what is scored; where few weights matter, most postings stay unread."""
    rng = np.random.default_rng(seed)
    weights = (rng.normal(size=(2000, 32)) * 200 * (rng.random((2000, 32)) < [1, 0.03][seed % 2])).astype("int64")
    block = impact_index.Block.build(weights.astype("int16"))
    for at in range(0, 2000, 250):
        query = weights[at]
        own = np.arange(2000) == at
        places, scores, postings = block.best(query, 10, own)
        truth = np.where(own, -(2**60), weights @ query)
        kth = np.sort(truth)[-10]
        assert set(np.flatnonzero(truth >= kth)) <= set(places.tolist())
        assert (scores == truth[places]).all()
        assert postings < weights.size
        if seed % 2:
            assert postings < weights.size / 4


def test_weights_beyond_16_bits():
    weights = np.random.default_rng(1).integers(-(10**6), 10**6, size=(300, 3))
    block = impact_index.Block.build(weights)
    places, scores, _ = block.best(weights[0], 3, np.zeros(300, bool))
    assert set(np.argsort(-(weights @ weights[0]))[:3]) <= set(places.tolist())
    assert impact_index.packed(weights)[1] == "int32" and impact_index.packed(weights * 10**5)[1] == "int64"


@pytest.mark.parametrize("scale, copies", [(200, 1), (200, 40), (10**7, 1)])
def test_a_block_is_read_for_many_queries_together(monkeypatch, scale, copies):
    """All that can be among the best of any query is scored, above what is certain; the block is read once, not once per query."""
    rng = np.random.default_rng(7)
    weights = np.repeat((rng.normal(size=(1200 // copies, 16)) * scale).astype("int64"), copies, axis=0)
    queries, k = weights[::10], 10
    own = np.arange(0, len(weights), 10)
    truth = queries @ weights.T
    truth[np.arange(len(queries)), own] = -(2**62)
    kth = np.sort(truth, axis=1)[:, -k]
    certain = np.where(np.arange(len(queries)) % 2, kth, -np.inf)
    readings = []
    limit = impact_index.Block._limit
    monkeypatch.setattr(impact_index.Block, "_limit", lambda *a: readings.append(0) or limit(*a))
    monkeypatch.setattr(impact_index, "TILE", 2**14)
    block = impact_index.Block.build(weights)
    parts = list(block.search(queries, k, np.arange(len(queries)), own, certain))
    assert len(readings) <= len(impact_index.STEPS)
    rows, places, scores = (np.concatenate(c) for c in list(zip(*parts))[:3])
    assert (scores == truth[rows, places]).all()
    assert set(zip(*(truth >= kth[:, None]).nonzero())) <= set(zip(rows.tolist(), places.tolist()))
    kept, rank = impact_index.best_of(rows, scores, k)
    got = np.full((len(queries), k), -1)
    got[rows[kept], rank] = scores[kept]
    assert (got == -np.sort(-truth, axis=1)[:, :k]).all()


def test_repeated_vectors_rank_by_id_in_small_slices(spark):
    """Many ties over blocks that meet the same queries one after the other."""
    rows = [(i, [float(i % 3), 1.0, -0.5 * (i % 2)]) for i in range(300)] + [(None, [2.0, 1.0, 0.0])] * 2
    df = tuned(spark).createDataFrame([(i, x, "l", "w", 1, 2, None) for i, x in rows], SCHEMA).repartition(3)
    expected = brute_force(rows, 12)
    for sizes in ({}, {"block_rows": 30, "block_queries": 1}):
        found = impact_index.top_k(df, F.col("vec_id") % 100 == 0, 12, **sizes).collect()
        for query, (best,) in expected.items():
            assert [(r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == query] == best
