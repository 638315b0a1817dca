import hashlib

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import index as ix
from shelfwise.sources import store as st


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def catalog(spark, **tenants):
    rows = [(t, i, x) for t, texts in tenants.items() for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, "tenant_id string, row_id long, retrieval_text string").repartition(3)


def signatures(df, **kw):
    return {r["tenant_id"]: r["signature"] for r in ix.catalog_signature(df, "m", **kw).collect()}


def tree(texts, first=0):
    """The signature by its definition: rows are numbered from ``first``."""
    level = {first + i: sha(t) for i, t in enumerate(texts)}
    for _ in range(2):
        nodes = {}
        for i in sorted(level):
            nodes.setdefault(i >> 12, []).append(level[i])
        level = {i: sha("\n".join(parts)) for i, parts in nodes.items()}
    return sha(sha("\n".join(level[i] for i in sorted(level))) + "|m|retriever_v1_tree")


def test_signature_follows_texts_order_and_model(spark):
    texts = [f"ñ{i}" for i in range(9000)]
    df = catalog(spark, a=texts, b=["x", "y"], c=["y", "x"])
    got = signatures(df)
    assert got["a"] == tree(texts) and got["b"] == tree(["x", "y"])
    assert got["b"] != got["c"]
    assert signatures(df, version="v2")["b"] != got["b"]
    swapped = [texts[1], texts[0], *texts[2:]]
    assert signatures(catalog(spark, a=swapped))["a"] != got["a"]


@pytest.mark.parametrize("first", [0, 4095, 65_534, 65_536, 70_000, 1 << 24])
def test_one_definition_for_every_numbering(spark, first):
    rows = [("a", first + i, t) for i, t in enumerate(["x", "y", "z"])]
    df = spark.createDataFrame(rows, "tenant_id string, row_id long, retrieval_text string")
    assert signatures(df)["a"] == tree(["x", "y", "z"], first)


def test_an_index_that_lacks_rows_is_not_reused(spark):
    now = catalog(spark, a=["x", "y"], b=["z"])
    signed = ix.catalog_signature(now, "m")
    meta = signed.withColumn("count", F.lit(1).cast("long"))
    assert [r["tenant_id"] for r in ix.reusable(signed, meta, now).collect()] == ["b"]


def test_embedding_function_is_called_in_batches(spark):
    df = catalog(spark, a=[f"{i}" for i in range(250)]).coalesce(1)
    sizes = ix.embed(df, "retrieval_text", lambda texts: [[float(len(texts))]] * len(texts))
    assert sorted({r["vec"][0] for r in sizes.collect()}) == [50.0, 100.0]
    with pytest.raises(Exception, match="vectors for"):
        ix.embed(df, "retrieval_text", lambda texts: [[1.0]]).count()


def test_rebuild_touches_stale_tenants_only(spark, tmp_path):
    path = str(tmp_path / "store")
    first = catalog(spark, a=["x", "y"], b=["z"])
    vectors = ix.embed(first, "retrieval_text", dim=8).join(ix.catalog_signature(first, "m"), "tenant_id")
    st.write_embedding_store(vectors.drop("retrieval_text"), path, "m")
    files = lambda t: sorted(p.name for p in (tmp_path / "store" / "vectors" / f"tenant_id={t}").glob("*.parquet"))
    before = files("a")
    second = catalog(spark, a=["x", "y"], b=["z", "new"], c=["c"])
    wanted = st.rebuild_embeddings(second, path, "m", dim=8)
    assert files("a") == before
    back = st.read_embedding_store(spark, path, wanted)
    assert sorted((r["tenant_id"], r["row_id"]) for r in back.collect()) == [("a", 0), ("a", 1), ("b", 0), ("b", 1), ("c", 0)]
    meta = {r["tenant_id"]: (r["count"], r["dim"]) for r in st.read_store(spark, path, "meta").collect()}
    assert meta == {"a": (2, 8), "b": (2, 8), "c": (1, 8)}
    assert st.read_embedding_store(spark, path, ix.catalog_signature(first, "m")).where("tenant_id = 'b'").count() == 0


def test_only_float_vectors_are_stored(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, "s", [1.0])], "tenant_id string, row_id long, signature string, vec array<double>")
    with pytest.raises(TypeError, match="array<float>"):
        st.write_embedding_store(df, str(tmp_path / "x"))


def test_readiness(spark):
    tenants = lambda *names: spark.createDataFrame([(n,) for n in names], "tenant_id string")
    rows = spark.createDataFrame([("a", "p"), ("b", None), ("c", "p"), ("d", "p")], "tenant_id string, product_name string")
    vecs = spark.createDataFrame([("a", 0, "s", [1.0]), ("d", 0, "s", [1.0])], "tenant_id string, row_id long, signature string, vec array<float>")
    meta = ix.index_meta(vecs).withColumn("count", F.when(F.col("tenant_id") == "d", 5).otherwise(F.col("count")))
    out = ix.index_readiness(tenants("a", "b", "c", "d", "e"), tenants("a", "b", "c", "d"), rows, vecs, meta)
    got = {r["tenant_id"]: r["errors"] for r in out.collect()}
    assert got == {
        "a": [], "b": ["assistant: catalog unusable"], "c": ["index: not found"], "d": ["index: metadata mismatch"],
        "e": ["not registered", "assistant: catalog unusable"],
    }
    assert ix.service_ready(out).first()["ok"] is False
    assert ix.service_ready(out.where("ok")).first()["ok"] is True
    assert ix.service_ready(out.where("false")).first()["ok"] is True
