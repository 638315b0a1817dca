"""Tenant keywords by automaton against a test per keyword."""

import random

import pytest
from pyspark.sql import functions as F

from shelfwise.operators.keywords import Names, with_names


def one_by_one(patterns, low):
    order = sorted(patterns, key=lambda p: tuple((v is not None, v if v is not None else 0) for v in p))
    return list(dict.fromkeys(name for _, name, word in order if word in low))


def test_pattern_order_and_overlapping_words():
    patterns = [(2, "late", "he"), (0, "first", "hers"), (1, "inside", "er"), (3, "late", "she"), (4, "all", ""), (5, "never", "hex")]
    names = Names(patterns)
    assert names.found("ushers") == ["first", "inside", "late", "all"]
    assert names.found("") == ["all"]
    assert names.found(None) == []
    assert Names([]).found("x") == []


def test_ten_thousand_keywords():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcde", k=rng.randint(1, 9))) for _ in range(10_000)]
    patterns = [(rng.choice([None, i % 900]), f"n{i % 700}", w) for i, w in enumerate(words)]
    names = Names(patterns)
    for _ in range(20):
        low = "".join(rng.choices("abcdef ", k=rng.randint(0, 60)))
        assert names.found(low) == one_by_one(patterns, low)


@pytest.mark.parametrize(("shipped", "part"), [(8_000_000, 4096), (0, 7)])
def test_messages_of_many_tenants(spark, shipped, part):
    """One tenant holds most messages; some have no tenant, no text, no keywords."""
    rng = random.Random(9)
    tenants = ["hot"] * 8 + ["a", "b", "none", None, ""]
    texts = [None, "", "Un sérum", "GEL crème", "gelatine", "nothing", "hydrating gel serum"]
    rows = [(i, rng.choice(tenants), rng.choice(texts), [i]) for i in range(300)]
    words = [("hot", 1, "gel", "Gel"), ("hot", 0, "serum", "sérum"), ("hot", 2, "gel", "gelatine"), ("hot", 2, "gel", "gelatine"),
             ("a", 0, "any", ""), ("a", 1, None, "crème"), ("b", 0, "x", None), ("", 0, "blank", "nothing"), (None, 0, "lost", "gel")]
    messages = spark.createDataFrame(rows, "msg_id long, tenant_id string, message string, other array<int>").repartition(3)
    patterns = spark.createDataFrame(words, "tenant_id string, ordinal int, canonical string, keyword string")
    got = with_names(messages, patterns, "names", shipped, part)
    assert got.columns == [*messages.columns, "names"]
    plain = str.maketrans("éè", "ee")
    for r in got.collect():
        own = [(o, n, w.lower().translate(plain)) for t, o, n, w in words if t == r["tenant_id"] and t is not None and w is not None]
        low = None if r["message"] is None else r["message"].lower().translate(plain)
        assert r["names"] == ([] if low is None else one_by_one(own, low))
    assert got.select("msg_id", "other").exceptAll(messages.select("msg_id", "other")).count() == 0
    assert got.agg(F.count("*")).head()[0] == len(rows)
