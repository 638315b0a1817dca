"""Catalog shaping: normalised text, prices, retrieval text, cards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import LEAN_LIMITS, RETRIEVAL_FIELDS, SCHEMA_MAP, TEXT_FIELDS
from ..functions.text import json_text, non_empty, normalize, shorten
from ..sources.catalog import apply_schema_map, infer_text_columns, quoted

CARD_FIELDS = [
    "product_name",
    "brand",
    "category",
    "benefits",
    "key_ingredients",
    "skin_types",
    "price_eur",
    "short_description",
    "contraindications",
]


def normalize_catalog_text(df: DataFrame, fields: Sequence[str] = TEXT_FIELDS) -> DataFrame:
    present = [c for c in fields if c in df.columns]
    return df.withColumns({c: normalize(F.col(c)) for c in present})


def coerce_price(df: DataFrame) -> DataFrame:
    """``price_eur`` as a number; what is no number, or absent, is null."""
    if "price_eur" not in df.columns:
        return df.withColumn("price_eur", F.lit(None).cast("double"))
    price = F.col("price_eur").try_cast("double")
    return df.withColumn("price_eur", F.when(~F.isnan(price), price))


def price_text(price: Column) -> Column:
    return F.concat(F.lit("price "), F.format_string("%.2f", price), F.lit("€"))


def build_retrieval_text(df: DataFrame) -> DataFrame:
    """Non-empty text fields and the price, joined by bars."""
    parts = [non_empty(F.col(c)) for c in RETRIEVAL_FIELDS if c in df.columns]
    price = F.when(F.col("price_eur").isNotNull(), price_text(F.col("price_eur")))
    return df.withColumn("retrieval_text", F.concat_ws(" | ", *parts, price))


def load_catalog(df: DataFrame, canonical=SCHEMA_MAP) -> DataFrame:
    """Raw catalog columns to the canonical catalog with its retrieval text."""
    shaped = coerce_price(normalize_catalog_text(apply_schema_map(df, canonical)))
    if "product_name" not in shaped.columns:
        raise ValueError("catalog has no product_name column after header mapping")
    return build_retrieval_text(shaped)


def make_corpus(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Text columns joined by dashes; missing ones stay as empty parts."""
    chosen = list(columns or infer_text_columns(df))
    parts = [F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")) for c in chosen]
    return F.array_join(F.array(*parts), " - ")


def _field(df: DataFrame, name: str) -> Column:
    if name in df.columns:
        return F.coalesce(F.col(name), F.lit(""))
    return F.lit("")


def product_card(df: DataFrame) -> Column:
    """The nine-field card; an empty benefits text falls back to the features."""
    fields = []
    for name in CARD_FIELDS:
        if name == "price_eur":
            value = (F.col(name) if name in df.columns else F.lit(None)).cast("double")
        elif name == "benefits":
            value = F.coalesce(non_empty(_field(df, name)), _field(df, "features"))
        else:
            value = _field(df, name)
        fields.append(value.alias(name))
    return F.struct(*fields)


def lean_card(card: Column) -> Column:
    """The card with its long texts cut."""
    return F.struct(
        *[
            (shorten(card[c], LEAN_LIMITS[c]) if c in LEAN_LIMITS else card[c]).alias(c)
            for c in CARD_FIELDS
        ]
    )


def source_label(product_name: Column, row_id: Column) -> Column:
    return F.coalesce(non_empty(product_name), F.concat(F.lit("row "), row_id.cast("string")))


def as_records(df: DataFrame) -> DataFrame:
    """Each row with all its columns as one JSON record."""
    return df.withColumn("record", json_text(F.struct(*[F.col(quoted(c)) for c in df.columns])))


def unusable_catalogs(tenants: DataFrame, catalog: DataFrame) -> DataFrame:
    """Tenants whose catalog is empty or has no product name at all."""
    filled = catalog.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("product_name").alias("n_named")
    )
    counted = tenants.select("tenant_id").join(filled, "tenant_id", "left").na.fill(0)
    reason = F.when(F.col("n_rows") == 0, "empty").otherwise("no product_name")
    return counted.where("n_rows = 0 OR n_named = 0").withColumn("reason", reason)
