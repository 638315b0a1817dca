"""Embedding index: signatures, embedding, reuse, statistics, readiness."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import EMBEDDING_BATCH, EMBEDDING_DIM, EMBEDDING_MODEL, INDEX_VERSION
from ..functions.vector import hash_embedding, l2_normalize

# Rows per signature block.
BLOCK_BITS = 12


def catalog_signature(
    catalog: DataFrame,
    model: str = EMBEDDING_MODEL,
    version: str = INDEX_VERSION,
    text: str = "retrieval_text",
) -> DataFrame:
    """Content signature per tenant, sensitive to texts, their order, model and version.

    A hash tree over row numbers: texts are hashed, the hashes of 4096 neighbouring row numbers are joined in order
    and hashed to a node, 4096 nodes likewise to the next, and these nodes are joined and hashed with model and
    version. One definition holds for every size, and no task ever holds a catalog.
    """

    def joined(position: str, value: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct(position, value)))
        return F.array_join(F.transform(ordered, lambda e: e[value]), "\n")

    def level(rows: DataFrame) -> DataFrame:
        """One step up the tree: 4096 neighbours become one node."""
        return (
            rows.withColumn("parent", F.shiftright("row_id", BLOCK_BITS))
            .groupBy("tenant_id", "parent")
            .agg(F.sha2(joined("row_id", "text"), 256).alias("text"))
            .withColumnRenamed("parent", "row_id")
        )

    leaves = catalog.select("tenant_id", "row_id", F.sha2(text, 256).alias("text"))
    root = level(level(leaves)).groupBy("tenant_id").agg(joined("row_id", "text").alias("all"))
    full = F.concat_ws("|", F.sha2("all", 256), F.lit(model), F.lit(f"{version}_tree"))
    return root.select("tenant_id", F.sha2(full, 256).alias("signature"))


def embed(
    df: DataFrame,
    text: str,
    fn: Callable[[list[str]], Sequence[Sequence[float]]] | None = None,
    dim: int = EMBEDDING_DIM,
    batch: int = EMBEDDING_BATCH,
) -> DataFrame:
    """Add ``vec``: the hash embedding, or the user's model called on batches of texts."""
    if fn is None:
        return df.withColumn("vec", hash_embedding(F.col(text), dim))
    schema = T.StructType([*df.schema.fields, T.StructField("vec", T.ArrayType(T.FloatType()))])

    def call(texts: list[str]) -> list[list[float]]:
        vectors = fn(texts)
        if len(vectors) != len(texts):
            raise ValueError(f"model returned {len(vectors)} vectors for {len(texts)} texts")
        return [[float(x) for x in v] for v in vectors]

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame[text].tolist()
            vectors = [v for i in range(0, len(texts), batch) for v in call(texts[i : i + batch])]
            yield frame.assign(vec=vectors)

    return df.mapInPandas(parts, schema)


def normalized(df: DataFrame) -> DataFrame:
    return df.withColumn("vec", l2_normalize(F.col("vec")).cast("array<float>"))


def reusable(signatures: DataFrame, meta: DataFrame, catalog: DataFrame) -> DataFrame:
    """Tenants whose stored index was made from exactly the current catalog and has a vector for each of its rows."""
    counts = catalog.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("count"))
    whole = signatures.join(counts, "tenant_id")
    return whole.join(meta.select("tenant_id", "signature", "count"), ["tenant_id", "signature", "count"], "left_semi")


def embedding_cache_join(
    catalog: DataFrame,
    signatures: DataFrame,
    store: DataFrame,
    meta: DataFrame,
    fn: Callable[[list[str]], Sequence[Sequence[float]]] | None = None,
    dim: int = EMBEDDING_DIM,
) -> DataFrame:
    """Vectors of all catalogs: stored ones where the signature fits, new ones elsewhere."""
    fresh_ids = reusable(signatures, meta, catalog).select("tenant_id", "signature")
    kept = store.join(fresh_ids, ["tenant_id", "signature"]).select(
        "tenant_id", "row_id", "signature", "vec", F.lit(True).alias("reused")
    )
    stale = catalog.join(fresh_ids.select("tenant_id"), "tenant_id", "left_anti")
    made = normalized(embed(stale, "retrieval_text", fn, dim)).join(signatures, "tenant_id")
    return kept.unionByName(
        made.select("tenant_id", "row_id", "signature", "vec", F.lit(False).alias("reused"))
    )


def index_meta(store: DataFrame, model: str = EMBEDDING_MODEL) -> DataFrame:
    """One row per stored index. Count and dimension are those of the vectors."""
    return store.groupBy("tenant_id", "signature").agg(
        F.lit(model).alias("embedding_model"),
        F.max(F.size("vec")).alias("dim"),
        F.count(F.lit(1)).alias("count"),
    )


def index_stats(store: DataFrame) -> DataFrame:
    return store.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("count"),
        F.max(F.size("vec")).cast("long").alias("dim"),
        (F.sum(F.size("vec")) * 4).alias("bytes"),
    )


def index_meta_mismatch(store: DataFrame, meta: DataFrame) -> DataFrame:
    """Indexes whose metadata disagrees with their vectors."""
    said = meta.select(
        "tenant_id", F.col("count").alias("meta_count"), F.col("dim").alias("meta_dim")
    )
    differs = (F.col("count") != F.col("meta_count")) | (F.col("dim") != F.col("meta_dim"))
    return index_stats(store).join(said, "tenant_id").where(differs)


def index_readiness(
    wanted: DataFrame, registry: DataFrame, catalogs: DataFrame, store: DataFrame, meta: DataFrame
) -> DataFrame:
    """Per wanted tenant: its errors, and whether it can serve."""
    registered = registry.select("tenant_id").distinct().withColumn("registered", F.lit(True))
    usable = catalogs.groupBy("tenant_id").agg(F.count("product_name").alias("n_named"))
    stats = index_stats(store).select("tenant_id", "count", "dim")
    broken = index_meta_mismatch(store, meta).select("tenant_id").withColumn("broken", F.lit(True))
    state = wanted.select("tenant_id")
    for part in (registered, usable, stats, broken):
        state = state.join(part, "tenant_id", "left")
    no_catalog = F.coalesce(F.col("n_named"), F.lit(0)) == 0
    errors = F.array_compact(
        F.array(
            F.when(F.col("registered").isNull(), "not registered"),
            F.when(no_catalog, "assistant: catalog unusable"),
            F.when(~no_catalog & F.col("count").isNull(), "index: not found"),
            F.when(~no_catalog & F.col("broken"), "index: metadata mismatch"),
        )
    )
    return state.select("tenant_id", "count", "dim", errors.alias("errors")).withColumn(
        "ok", F.size("errors") == 0
    )


def service_ready(readiness: DataFrame) -> DataFrame:
    """Ready only when every wanted tenant is."""
    return readiness.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok"))
