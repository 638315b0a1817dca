"""The embedding store: vectors partitioned by tenant, and one metadata row per index."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import EMBEDDING_DIM, EMBEDDING_MODEL
from ..operators.index import catalog_signature, embed, normalized, reusable
from ..session import materialized


def write_embedding_store(vectors: DataFrame, path: str, model: str = EMBEDDING_MODEL) -> None:
    """Write ``(tenant_id, row_id, signature, vec)``; vectors must be float arrays.

    Only the tenants in ``vectors`` are replaced. Rows are rebalanced by tenant before the write:
    small tenants share a task, a large one is split over as many as its size asks for.
    """
    kind = vectors.schema["vec"].dataType
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.FloatType):
        raise TypeError(f"vec must be array<float>, not {kind.simpleString()}")
    rows = normalized(vectors).select(
        "row_id", "signature", F.size("vec").alias("dim"), "vec", "tenant_id"
    )
    _save(rows, f"{path}/vectors")
    # Metadata describes what is stored; it reads the narrow columns of the store only.
    stored = read_store(vectors.sparkSession, path)
    meta = stored.groupBy("tenant_id", "signature").agg(
        F.lit(model).alias("embedding_model"),
        F.max("dim").alias("dim"),
        F.count(F.lit(1)).alias("count"),
    )
    _save(meta, f"{path}/meta")


def _save(df: DataFrame, path: str) -> None:
    (
        df.hint("rebalance", "tenant_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("tenant_id")
        .parquet(path)
    )


def read_store(spark: SparkSession, path: str, name: str = "vectors") -> DataFrame:
    stored = spark.read.parquet(f"{path}/{name}")
    return stored.withColumn("tenant_id", F.col("tenant_id").cast("string"))


def read_embedding_store(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Stored vectors of the tenants whose signature is the wanted one.

    A tenant with another signature, or without an index, contributes nothing.
    """
    keys = ["tenant_id", "signature"]
    return read_store(spark, path).join(wanted.select(*keys), keys)


def rebuild_embeddings(
    catalog: DataFrame,
    path: str,
    model: str = EMBEDDING_MODEL,
    fn: Callable[[list[str]], Sequence[Sequence[float]]] | None = None,
    dim: int = EMBEDDING_DIM,
) -> DataFrame:
    """Bring the store up to date with all catalogs; returns the current signatures.

    Tenants with an unchanged signature are neither embedded nor rewritten.
    """
    spark = catalog.sparkSession
    wanted = materialized(catalog_signature(catalog, model), "signatures")
    fresh = reusable(wanted, read_store(spark, path, "meta"), catalog).select("tenant_id")
    stale = catalog.join(fresh, "tenant_id", "left_anti").join(wanted, "tenant_id")
    made = embed(stale.select("tenant_id", "row_id", "signature", "retrieval_text"), "retrieval_text", fn, dim)
    write_embedding_store(made, path, model)
    return wanted
