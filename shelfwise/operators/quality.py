"""Catalog quality: one pass of counts per tenant, duplicates, unknown categories, a report.

Input is the validator's view of catalogs: ``tenant_id, row_id, product, price, category`` and
``description``. A single product name may fill a third of a catalog, so names are counted before
anything is shuffled by name, and no list of rows is built per name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import (
    DUPLICATE_EXAMPLES,
    MAX_NULL_RATIO,
    MIN_DESCRIPTION_CHARS,
    REPORT_ERRORS,
    REPORT_WARNINGS,
    REQUIRED_COLUMNS,
)
from ..functions.price import extract_price_number
from ..functions.text import render
from ..session import materialized


def null_ratio(catalog: DataFrame, columns: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    """Share of missing values per tenant and required column."""
    shares = catalog.groupBy("tenant_id").agg(
        *[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]
    )
    long = shares.unpivot("tenant_id", list(columns), "column", "null_ratio")
    return long.withColumn("too_many", F.col("null_ratio") > MAX_NULL_RATIO)


def _name_counts(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("tenant_id", "product").agg(F.count(F.lit(1)).alias("n"))


def duplicate_products(catalog: DataFrame) -> DataFrame:
    """Every row whose product name occurs more than once in its catalog (missing names too)."""
    repeated = _name_counts(catalog).where("n > 1")
    repeated = repeated.select(
        F.col("tenant_id").alias("_tenant"), F.col("product").alias("_product"), "n"
    )
    same = (F.col("tenant_id") == F.col("_tenant")) & F.col("product").eqNullSafe(F.col("_product"))
    return catalog.join(repeated, same).drop("_tenant", "_product")


def sample_duplicates(catalog: DataFrame, examples: int = DUPLICATE_EXAMPLES) -> DataFrame:
    """The first duplicate rows of each catalog, in row order."""
    order = Window.partitionBy("tenant_id").orderBy("row_id")
    found = duplicate_products(catalog).select("tenant_id", "row_id", "product")
    return found.withColumn("position", F.row_number().over(order)).where(
        F.col("position") <= examples
    )


def duplicate_counts(catalog: DataFrame) -> DataFrame:
    return (
        _name_counts(catalog).where("n > 1").groupBy("tenant_id").agg(F.sum("n").alias("duplicates"))
    )


def unknown_categories(catalog: DataFrame, valid: DataFrame) -> DataFrame:
    """Categories in use that are no pattern category. Without any reference there is no check."""
    used = catalog.select("tenant_id", "category").where("category IS NOT NULL").distinct()
    judged = used.join(valid.select("tenant_id").distinct(), "tenant_id", "left_semi")
    return judged.join(valid.select("tenant_id", "category"), ["tenant_id", "category"], "left_anti")


def category_difference(catalog: DataFrame, valid: DataFrame) -> DataFrame:
    """Set difference of two category columns."""
    return catalog.where("category IS NOT NULL").select("category").subtract(valid.select("category"))


def short_descriptions(catalog: DataFrame) -> DataFrame:
    length = F.length(F.coalesce(F.col("description").cast("string"), F.lit("")))
    return catalog.groupBy("tenant_id").agg(
        F.count_if(length < MIN_DESCRIPTION_CHARS).alias("short_descriptions")
    )


def _listed(values: Column) -> Column:
    return F.concat(F.lit("['"), F.array_join(values, "', '"), F.lit("']"))


COUNTS = ["rows", "price_ok", "price_bad", "price_neg", "price_zero", "duplicates"]


def catalog_quality_report(catalog: DataFrame, valid: DataFrame) -> DataFrame:
    """Counts per catalog and its report lines, a row per line: severity (error, warning), line, detail.

    A catalog without lines has one row with nulls; it passes when it has no errors. Every unknown category is a line of its
    own (detail: the category), so a report may be of any length.
    """
    price = extract_price_number(F.col("price"))
    missing = {c: F.avg(F.col(c).isNull().cast("double")) for c in REQUIRED_COLUMNS}
    counts = catalog.withColumn("_price", price).groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("_price").alias("price_ok"),
        F.count_if(F.col("_price").isNull()).alias("price_bad"),
        F.count_if(F.col("_price") < 0).alias("price_neg"),
        F.count_if(F.col("_price") == 0).alias("price_zero"),
        F.count_if(
            F.length(F.coalesce(F.col("description"), F.lit(""))) < MIN_DESCRIPTION_CHARS
        ).alias("short"),
        *[share.alias(f"missing_{c}") for c, share in missing.items()],
    )
    examples = sample_duplicates(catalog).groupBy("tenant_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("position", "product"))),
            lambda e: F.coalesce(e["product"], F.lit("nan")),
        ).alias("examples")
    )
    judged = valid.select("tenant_id").distinct().withColumn("judged", F.lit(True))
    whole = counts
    for part in (duplicate_counts(catalog), examples, judged):
        whole = whole.join(part, "tenant_id", "left")
    # Read twice, a row per catalog.
    whole = materialized(whole.na.fill(0, ["duplicates"]).na.fill(False, ["judged"]), "catalog-counts")

    c = F.col

    def line(test: Column, template: str, **values: Column) -> Column:
        texts = {name: value.cast("string") for name, value in values.items()}
        return F.when(test, render(template, texts))

    def percent(share: Column) -> Column:
        return F.format_string("%.1f", share * 100)

    say, warn = REPORT_ERRORS, REPORT_WARNINGS
    errors = [
        line(
            c(f"missing_{name}") > MAX_NULL_RATIO, say["missing"],
            COLUMN=F.lit(name), PERCENT=percent(c(f"missing_{name}")),
        )
        for name in REQUIRED_COLUMNS
    ]
    errors += [
        line(c("price_bad") > 0, say["bad_price"], N=c("price_bad")),
        line(c("price_neg") > 0, say["negative_price"], N=c("price_neg")),
        line(c("duplicates") > 0, say["duplicates"], N=c("duplicates"), NAMES=_listed(c("examples"))),
    ]
    warnings = [
        line(c("price_zero") > 0, warn["zero_price"], N=c("price_zero")),
        line(~c("judged"), warn["not_judged"]),
        line(
            c("short") > 0, warn["short_descriptions"],
            N=c("short"), LIMIT=F.lit(MIN_DESCRIPTION_CHARS),
        ),
    ]
    none = F.lit(None).cast("string")
    said = [F.struct(F.lit(kind).alias("severity"), x.alias("line")) for kind, lines in (("error", errors), ("warning", warnings)) for x in lines]
    said = F.filter(F.array(*said), lambda x: x["line"].isNotNull())
    fixed = whole.select("tenant_id", *COUNTS, F.explode(said).alias("s")).select("tenant_id", *COUNTS, "s.severity", "s.line", none.alias("detail"))
    unknown = unknown_categories(catalog, valid).join(whole.select("tenant_id", *COUNTS), "tenant_id")
    named = render(warn["unknown_categories"], {"NAMES": _listed(F.array("category"))})
    unknown = unknown.select("tenant_id", *COUNTS, F.lit("warning").alias("severity"), named.alias("line"), F.col("category").alias("detail"))
    lines = fixed.unionByName(unknown)
    clean = whole.join(lines.select("tenant_id").distinct(), "tenant_id", "left_anti")
    return lines.unionByName(clean.select("tenant_id", *COUNTS, *[none.alias(n) for n in ("severity", "line", "detail")]))
