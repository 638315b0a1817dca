"""Pattern documents, price wording and few-shot pairs as tables."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize, strip
from .catalog import tenant_of_file

PRICE_KINDS = ("under", "between", "currency")
TENANT_TYPE = "map<string,struct<api_key:string,max_requests_per_day:int>>"


def read_documents(spark: SparkSession, path: str, tenant_level: int = 1) -> DataFrame:
    """Configuration files, YAML or JSON, as ``(tenant_id, path, document)`` with JSON documents.

    The tenant is the folder ``tenant_level`` steps above the file. A file that does not parse has
    a null document. Files are small; each is read by one task.
    """
    files = spark.read.text(path, wholetext=True).select(
        "value", F.url_decode("_metadata.file_path").alias("path")
    )

    @F.pandas_udf("string")
    def as_json(texts: pd.Series) -> pd.Series:
        try:
            import yaml
        except ImportError:  # JSON only
            parse, errors = json.loads, ValueError
        else:
            parse, errors = yaml.safe_load, yaml.YAMLError

        def convert(text: str) -> str | None:
            try:
                return json.dumps(parse(text), ensure_ascii=False, default=str)
            except errors:
                return None

        return texts.map(convert)

    folder = F.regexp_replace("path", "/[^/]*" * (tenant_level - 1) + "$", "") if tenant_level > 1 else F.col("path")
    return files.select(tenant_of_file(folder).alias("tenant_id"), "path", as_json("value").alias("document"))


def tenants_of(document: DataFrame) -> DataFrame:
    """Registry rows ``(client_id, api_key, max_requests_per_day)`` of a tenants document."""
    entries = document.select(F.explode(F.from_json("document", TENANT_TYPE)).alias("client_id", "t"))
    return entries.select("client_id", "t.*")


def few_shot_of(documents: DataFrame) -> DataFrame:
    """Example pairs ``(tenant_id, position, user, assistant)`` of few-shot documents."""
    pairs = F.from_json("document", "array<struct<user:string,assistant:string>>")
    return documents.select("tenant_id", F.posexplode(pairs).alias("position", "p")).select(
        "tenant_id", "position", "p.*"
    )


def price_terms_of(documents: DataFrame) -> DataFrame:
    """Term rows ``(tenant_id, ordinal, kind, term)`` of price documents, in document order."""
    languages = first_section(documents, "map<string,map<string,map<string,array<string>>>>")
    kinds = languages.select("tenant_id", F.posexplode("section").alias("at", "language", "kinds"))
    terms = kinds.select("tenant_id", "at", F.explode("kinds").alias("kind", "terms"))
    rows = terms.select("tenant_id", "at", "kind", F.posexplode("terms").alias("position", "term"))
    return rows.select("tenant_id", F.struct("at", "position").alias("ordinal"), "kind", "term")


def price_wording_of(documents: DataFrame) -> DataFrame:
    """Price terms ``(tenant_id, under, between, currency)`` of the tenants that have a price document of their own.

    A kind without terms is an empty list. Documents that are no JSON object are left out (``unusable_documents``).
    """
    merged = union_price_terms(price_terms_of(documents))
    kind = lambda name: F.first(F.when(F.col("kind") == name, F.col("terms")), ignorenulls=True).alias(name)
    by_kind = merged.groupBy("tenant_id").agg(*map(kind, PRICE_KINDS))
    own = documents.where(F.json_object_keys("document").isNotNull()).select("tenant_id").distinct()
    none = F.array().cast("array<string>")
    return own.join(by_kind, "tenant_id", "left").select("tenant_id", *[F.coalesce(k, none).alias(k) for k in PRICE_KINDS])


def medical_terms_of(documents: DataFrame) -> DataFrame:
    """Medical terms ``(tenant_id, medical_terms)`` of the tenants that have a document of their own: all lists of its first section."""
    lists = first_section(documents).select("tenant_id", F.flatten(F.map_values("section")).alias("terms"))
    return lists.select("tenant_id", F.coalesce("terms", F.array().cast("array<string>")).alias("medical_terms"))


def first_section(
    documents: DataFrame, kind: str = "map<string,map<string,array<string>>>"
) -> DataFrame:
    """The first top-level section of each pattern document ``(tenant_id, document)`` (JSON)."""
    key = F.get(F.json_object_keys("document"), F.lit(0))
    sections = F.from_json("document", kind)
    return documents.where(key.isNotNull()).select(
        "tenant_id", F.try_element_at(sections, key).alias("section")
    )


def unusable_documents(documents: DataFrame) -> DataFrame:
    """Documents that are not a JSON object or have no section."""
    keys = F.json_object_keys("document")
    return documents.where(keys.isNull() | (F.size(keys) == 0)).select("tenant_id")


def explode_patterns(documents: DataFrame) -> DataFrame:
    """Keyword rows ``(tenant_id, ordinal, canonical, position, keyword)`` in document order."""
    names = first_section(documents).select(
        "tenant_id", F.posexplode("section").alias("ordinal", "canonical", "keywords")
    )
    return names.select(
        "tenant_id",
        "ordinal",
        "canonical",
        F.posexplode("keywords").alias("position", "keyword"),
    )


def union_price_terms(terms: DataFrame) -> DataFrame:
    """Terms of all languages by kind, from ``(tenant_id, ordinal, kind, term)`` rows."""
    ordered = F.sort_array(F.collect_list(F.struct("ordinal", "term")))
    return terms.groupBy("tenant_id", "kind").agg(
        F.transform(ordered, lambda t: t["term"]).alias("terms")
    )


def valid_few_shot(pairs: DataFrame) -> DataFrame:
    """Example pairs whose two texts are both more than blanks."""
    user_ok = F.length(normalize(F.col("user"))) > 0
    reply_ok = F.length(strip(F.coalesce("assistant", F.lit("")))) > 0
    return pairs.where(user_ok & reply_ok)
