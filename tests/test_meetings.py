"""Meetings of messages and products by halls: what is sent, and that the single precision screen loses nothing."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import candidates as cand
from shelfwise.operators import metric_index
from shelfwise.session import materialized


def unit(x):
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)


@pytest.mark.parametrize("priced", [False, True])
def test_kernel_is_exact(priced):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(900, 8)).astype("float32")
    vectors[300:700] = vectors[rng.integers(0, 20, 400)]  # ties
    vectors[700:800] = vectors[5] + rng.normal(size=(100, 8)).astype("float32") * 1e-5  # closer than single precision tells
    vectors[899] = np.nan
    asked = np.concatenate([rng.normal(size=(300, 8)), vectors[:20]]).astype("float32")
    masks = rng.integers(1, 8, 320)
    slots, prices = rng.integers(0, 3, 900), np.where(rng.random(900) < 0.1, np.nan, rng.integers(0, 50, 900))
    lo = np.where(rng.random(320) < 0.3, np.nan, rng.integers(0, 50, 320))
    hi = lo + rng.choice([0, 3, 100, np.nan], 320)
    sims = np.round(unit(asked.astype("float64")) @ unit(vectors.astype("float64")).T, 9)
    allowed = ((masks[:, None] >> slots) & 1 == 1) & np.isfinite(sims)
    m = {"msg_id": np.arange(320), "vec": list(asked), "mask": masks}
    p = {"row_id": np.arange(900), "vec": list(vectors), "slot": slots}
    if priced:
        m |= {"lo": pa.array(lo, from_pandas=True), "hi": pa.array(hi, from_pandas=True)}
        p |= {"price_eur": pa.array(prices, from_pandas=True)}
        allowed &= np.isnan(lo)[:, None] | ((prices >= lo[:, None]) & (prices <= hi[:, None]))
    expected = []
    for i in range(320):
        order = np.lexsort((np.arange(900), -sims[i]))
        expected.append([j for j in order if allowed[i, j]][:4])
    kth = np.array([sims[i, e[3]] if i % 2 and len(e) == 4 else np.nan for i, e in enumerate(expected)])
    for known in ({}, {"kth": pa.array(kth, from_pandas=True)}):
        found = metric_index.best_of_block(4)(pa.table(m | known), pa.table(p)).to_pylist()
        got = [[] for _ in range(320)]
        for hit in found:
            got[hit["msg_id"]].append(hit["row_id"])
        assert got == expected


def test_copies_beyond_k_never_meet(spark):
    """A third of all rows are copies of one vector: k of each price go on, the lowest."""
    rows = [("t", i, [1.0, 0.0] if i % 3 == 0 else [float(i), 1.0], float(i % 2)) for i in range(600)]
    p = spark.createDataFrame(rows, "tenant_id string, row_id long, vec array<float>, price_eur double").repartition(5)
    kept = {r["row_id"] for r in metric_index.foremost(p, ["tenant_id"], 4).collect()}
    assert kept == {i for i in range(600) if i % 3} | {0, 3, 6, 9, 12, 15, 18, 21}


def test_a_message_is_sent_once_to_a_hall(spark):
    rng = np.random.default_rng(3)
    rows = [("t", i, v) for i, v in enumerate(rng.normal(size=(4000, 6)).astype("float32").tolist())]
    p = materialized(spark.createDataFrame(rows, "tenant_id string, row_id long, vec array<float>"), "products")
    m = materialized(p.where("row_id < 50").withColumnRenamed("row_id", "msg_id"), "messages")
    sizes = p.groupBy("tenant_id").agg(F.count("*").alias("n"))
    _, blocks = metric_index.build(p, sizes, ["tenant_id"], 100)
    known = spark.createDataFrame([(i, -1.0) for i in range(50)], "msg_id long, kth double")
    sent = metric_index.visits(m, blocks, ["tenant_id"], 5, 64, known, halls=True).groupBy("msg_id")
    sent = sent.agg(F.count("*").alias("rows"), F.sum(F.bit_count("mask")).alias("blocks")).collect()
    n = blocks.count()
    assert n >= 40 and {r["blocks"] for r in sent} == {n}
    assert {r["rows"] for r in sent} == {-(-n // metric_index.HALL_BLOCKS)}


def test_candidates_among_given_pairs(spark):
    """Only the given pairs are judged, by the rule that forms all pairs."""
    products = [("t", i, [None, "a", "b"][i % 3], [None, 5.0, 10.0, 10.004][i % 4]) for i in range(24)]
    messages = [(i, lo, hi, hints) for i, (lo, hi, hints) in enumerate(
        [(None, None, []), (5.0, 10.0, []), (10.0, 10.0, ["a"]), (6.0, None, []), (None, None, ["b", "z"]), (None, None, None)])]
    p = spark.createDataFrame(products, "tenant_id string, row_id long, category string, price_eur double")
    m = spark.createDataFrame([("t", *x) for x in messages], "tenant_id string, msg_id long, lo double, hi double, hints array<string>")
    among = m.crossJoin(p.select("row_id")).where("(msg_id + row_id) % 2 = 0").select("tenant_id", "msg_id", "row_id")
    pairs = lambda df: sorted(map(tuple, df.collect()))
    whole = pairs(cand.message_candidates(m, p))
    assert whole
    assert pairs(cand.message_candidates(m, p, among=among)) == [x for x in whole if (x[1] + x[2]) % 2 == 0]
    plan = cand.message_candidates(m, p, among=among)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_full_cells_are_cut_and_not_broadcast(spark, monkeypatch):
    """All pairs of the rule, each once, when places are cut into blocks; the cells of the catalog are not sent to every task."""
    monkeypatch.setattr(cand, "BLOCK", 2)
    prices = [None, 5.0, 10.0, 10.004, 11.0, 500.0]
    products = [("tu"[i % 5 == 0], i, [None, "a", "b"][i % 3], prices[i % 6]) for i in range(60)]
    wanted = [(None, None, []), (5.0, 11.0, []), (10.0, 10.0, ["a"]), (0.0, 400.0, ["b", "a"]), (6.0, None, []), (None, None, ["b", "z"])]
    messages = [(t, 10 * i + len(t), *x) for t in ("t", "u", "none") for i, x in enumerate(wanted)]
    p = spark.createDataFrame(products, "tenant_id string, row_id long, category string, price_eur double")
    m = spark.createDataFrame(messages, "tenant_id string, msg_id long, lo double, hi double, hints array<string>")
    rule = cand.matches(*[F.col(c) for c in ("price_eur", "category", "lo", "hi", "hints")])
    want = m.join(p, "tenant_id").where(rule).select("tenant_id", "msg_id", "row_id")
    got = cand.message_candidates(m, p)
    pairs = lambda df: sorted(map(tuple, df.collect()))
    assert pairs(got) == pairs(want)
    assert "SortMergeJoin [tenant_id" in got._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_made_from_lists_by_all_tasks(spark):
    """A message meets a block of products as one row, and tasks are not put together by the size of rows that make many pairs each."""
    p = spark.createDataFrame([("t", i, "a", 5.0 + i % 7) for i in range(500)] + [(None, 900, "a", 5.0)], "tenant_id string, row_id long, category string, price_eur double")
    m = spark.createDataFrame([("t", i, 5.0, 8.0 + i % 3, ["a"]) for i in range(30)] + [(None, 99, None, None, [])], "tenant_id string, msg_id long, lo double, hi double, hints array<string>")
    got = cand.message_candidates(m, p)
    rows = got.collect()
    assert len(rows) == len(set(rows)) == sum(1 for i in range(500) for j in range(30) if i % 7 <= 3 + j % 3)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.index("Join Inner") < plan.index("collect_list")
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_evaluation_retrieves_once(spark):
    """The summary reads its cases several times; the search is not part of what it reads."""
    from shelfwise.plans import evaluation

    made = evaluation.results(spark, "/root/testdata/sf0.001")
    assert "CoGroups" not in made._jdf.queryExecution().optimizedPlan().toString()
