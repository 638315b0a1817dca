"""Catalog files: reading, header mapping, writing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import (
    COLUMN_ALIASES,
    CORPUS_FIELDS,
    NA_TOKENS,
    REQUIRED_COLUMNS,
    SCHEMA_MAP,
)
from ..session import materialized, tell_case_apart
from .records import read_records

CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}
# .../<tenant>/products_catalog.csv, .../tenant_id=<tenant>/part-0.csv
TENANT_OF_PATH = r"/(?:tenant_id=)?([^/]+)/[^/]+$"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def missing_as_null(df: DataFrame) -> DataFrame:
    """Turn the cells a CSV reader takes for missing into nulls."""
    return df.select(
        *[
            F.when(~F.col(quoted(c)).isin(NA_TOKENS), F.col(quoted(c))).alias(c)
            if isinstance(df.schema[c].dataType, T.StringType)
            else F.col(quoted(c))
            for c in df.columns
        ]
    )


def header_names(spark: SparkSession, header: str) -> list[str]:
    """Column names of a header record, as the CSV reader gives them."""
    return spark.read.options(**CSV_OPTIONS).csv(spark.sparkContext.parallelize([header], 1)).columns


def cells(record: Column, names: Sequence[str]) -> Column:
    """The cells of a record as a struct of strings named by position."""
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    return F.from_csv(record, schema, {k: v for k, v in CSV_OPTIONS.items() if k != "header"})


def read_catalog_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Catalog CSV files of one header as strings; quoted cells may hold line breaks and doubled quotes."""
    records = read_records(spark, path)
    first = records.where("number = 0").agg(F.min_by("record", "path")).head()[0]
    if first is None:
        raise FileNotFoundError(f"no catalog rows under {path}")
    names = header_names(spark, first)
    parsed = records.where("number > 0").select(cells(F.col("record"), names).alias("c"))
    return missing_as_null(parsed.select(*[F.col(f"c.c{i}").alias(n) for i, n in enumerate(names)]))


def tenant_of_file(path: Column) -> Column:
    return F.url_decode(F.regexp_extract(path, TENANT_OF_PATH, 1))


def read_all_tenants(
    spark: SparkSession, root: str, canonical: Mapping[str, Sequence[str]] = SCHEMA_MAP
) -> DataFrame:
    """Every tenant's catalog as one relation: canonical columns, plus tenant and row position.

    A large file is read by many tasks. One plan reads all files: each record is cut into cells, and a cell's column follows
    from the header of its file. The distinct headers, not the files, are known to the driver. Columns a
    tenant lacks are null; a folder without a file has no rows. A ``row_id`` of the file's own replaces the position.
    """
    records = read_records(spark, root, recursiveFileLookup="true", pathGlobFilter="*.csv")
    headers = records.where("number = 0").select("path", F.col("record").alias("header"))
    headers = materialized(headers, "headers")
    shapes = sorted(r["header"] for r in headers.select("header").distinct().collect())
    if not shapes:
        raise FileNotFoundError(f"no catalog files under {root}")
    found = {header: header_names(spark, header) for header in shapes}
    mapped = {header: canonical_names(names, canonical) for header, names in found.items()}
    places: dict[str, dict[str, int]] = {}
    for header in shapes:
        for at, name in enumerate(mapped[header]):
            places.setdefault(name, {})[header] = at
    widest = max(found.values(), key=len)

    rows = records.where("number > 0").join(headers, "path")
    rows = rows.withColumn("c", cells(F.col("record"), widest))
    rows = rows.withColumn("cells", F.array(*[F.col(f"c.c{i}") for i in range(len(widest))]))

    def value(name: str) -> Column:
        at = F.lit(None).cast("int")
        for header, place in places[name].items():
            at = F.when(F.col("header") == header, place).otherwise(at)
        cell = F.get("cells", at)
        return F.when(~cell.isin(NA_TOKENS), cell).alias(name)

    position = F.col("number") - 1
    if "row_id" in places:
        position = F.coalesce(value("row_id").cast("long"), position)
    own = [value(name) for name in places if name not in ("row_id", "tenant_id")]
    return rows.select(*own, tenant_of_file(F.col("path")).alias("tenant_id"), position.alias("row_id"))


def union_catalogs(parts: Sequence[DataFrame]) -> DataFrame:
    """All catalogs as one relation; columns a part lacks are null."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def canonical_names(
    names: Sequence[str], canonical: Mapping[str, Sequence[str]] = SCHEMA_MAP
) -> list[str]:
    """``names`` with the best source header of each canonical field that is not there yet renamed to it."""
    renames = {}
    for field, headers in canonical.items():
        source = next((h for h in headers if h in names), None)
        if field not in names and source is not None:
            renames[source] = field
    return [renames.get(n, n) for n in names]


def apply_schema_map(df: DataFrame, canonical: Mapping[str, Sequence[str]] = SCHEMA_MAP) -> DataFrame:
    """Rename the best source header of each canonical field the catalog does not have yet.

    Headers are told apart by case: a catalog may have both ``Brand`` and ``brand``.
    """
    return tell_case_apart(df.toDF(*canonical_names(df.columns, canonical)))


def map_logical_columns(
    df: DataFrame, aliases: Mapping[str, Sequence[str]] = COLUMN_ALIASES
) -> dict[str, str]:
    """Logical name -> header, ignoring case and surrounding blanks of the headers."""
    by_lower = {c.lower().strip(): c for c in df.columns}
    found = {}
    for logical, names in aliases.items():
        header = next((by_lower[n.lower()] for n in names if n.lower() in by_lower), None)
        if header is not None:
            found[logical] = header
    return found


def select_logical(df: DataFrame, keep: Sequence[str] = ("tenant_id", "row_id")) -> DataFrame:
    """The validator's view of a catalog: logical columns plus the row's identity."""
    mapping = map_logical_columns(df)
    missing = [c for c in REQUIRED_COLUMNS if c not in mapping]
    if missing:
        raise ValueError(f"required columns missing: {missing}; present: {df.columns}")
    columns = [F.col(c) for c in keep if c in df.columns]
    return df.select(*columns, *[F.col(quoted(h)).alias(name) for name, h in mapping.items()])


def infer_text_columns(df: DataFrame) -> list[str]:
    """Known text columns by name, else every string column."""
    by_lower = {c.lower(): c for c in df.columns}
    known = [by_lower[c] for c in CORPUS_FIELDS if c in by_lower]
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return known or strings


def write_catalog_csv(df: DataFrame, path: str, by_tenant: bool = True) -> None:
    writer = df.write.options(**{**CSV_OPTIONS, "quoteAll": "true"}).mode("errorifexists")
    (writer.partitionBy("tenant_id") if by_tenant else writer).csv(path)
