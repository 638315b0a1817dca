"""Catalog queries: files, header mapping, text, prices, cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed_values import CORPUS_FIELDS, TEXT_FIELDS
from ..functions.text import json_text, unaccent
from ..operators import catalog as cat
from ..session import shared_dir
from ..sources import catalog as src
from . import bindings as b
from .bindings import duck, sql_strip, sql_text, sql_unaccent
from .registry import query

PRICE = "'price ' || printf('%.2f', price_eur) || '€'"


def digest(column: str):
    return F.md5(F.col(column)).alias(f"{column}_md5")


@query(
    "scan_catalog_csv",
    duck("""
    SELECT row_id, product_name AS "Product", CAST(price_eur AS VARCHAR) AS price,
           md5(features) AS features_md5, length(features) AS n_chars
    FROM (SELECT * REPLACE (concat(product_name, ' "', size, '"') AS product_name) FROM catalog_text)"""),
)
def scan_catalog_csv(spark, d):
    rows = b.catalog_text(spark, d).select(
        "row_id",
        F.concat("product_name", F.lit(' "'), "size", F.lit('"')).alias("Product"),
        F.col("price_eur").alias("Price (€)"),
        F.col("features").alias("Features"),
    )
    path = shared_dir(spark, "catalog-csv")
    src.write_catalog_csv(rows, path, by_tenant=False)
    back = src.read_catalog_csv(spark, path)
    return back.select(
        F.col("row_id").cast("long").alias("row_id"),
        "Product",
        F.col("Price (€)").alias("price"),
        F.md5("Features").alias("features_md5"),
        F.length("Features").cast("long").alias("n_chars"),
    )


@query(
    "scan_all_tenants",
    duck("""
    SELECT tenant_id, row_id, product_name, price_eur,
           CASE WHEN tenant_id IN ('t0', 't1') THEN brand END AS brand,
           CASE WHEN tenant_id IN ('t0', 't1') THEN NULL ELSE category END AS category
    FROM catalog"""),
)
def scan_all_tenants(spark, d):
    """Two header shapes: one group of tenants exports brands, the other categories."""
    rows = b.catalog(spark, d)
    branded = F.col("tenant_id").isin("t0", "t1")
    root = shared_dir(spark, "tenant-catalogs")
    src.write_catalog_csv(
        rows.where(branded).select(
            "tenant_id", "row_id", F.col("product_name").alias("Product"),
            F.col("price_eur").alias("Price (€)"), F.col("brand").alias("Brand"),
        ),
        f"{root}/branded",
    )
    src.write_catalog_csv(
        rows.where(~branded).select(
            "tenant_id", "row_id", F.col("product_name").alias("Name"),
            F.col("price_eur").alias("Price"), F.col("category").alias("Category"),
        ),
        f"{root}/sorted",
    )
    whole = cat.coerce_price(src.read_all_tenants(spark, root))
    return whole.select("tenant_id", "row_id", "product_name", "price_eur", "brand", "category")


@query(
    "union_tenant_catalogs",
    duck("""
    SELECT tenant_id, row_id, product_name, brand, NULL AS category FROM catalog WHERE tenant_id = 't0'
    UNION ALL
    SELECT tenant_id, row_id, product_name, NULL, category FROM catalog WHERE tenant_id <> 't0'"""),
)
def union_tenant_catalogs(spark, d):
    rows = b.catalog(spark, d)
    first = rows.where("tenant_id = 't0'").select("tenant_id", "row_id", "product_name", "brand")
    others = rows.where("tenant_id <> 't0'").select("tenant_id", "row_id", "product_name", "category")
    return src.union_catalogs([first, others])


@query(
    "apply_schema_map",
    """SELECT p_partkey AS row_id, p_name AS product_name, p_type AS category, p_brand AS "Brand",
              upper(p_brand) AS brand, p_retailprice AS price_eur, p_size AS shelf
       FROM part""",
)
def apply_schema_map(spark, d):
    raw = b.table(spark, d, "part").select(
        F.col("p_partkey").alias("row_id"),
        F.col("p_name").alias("Product"),
        F.col("p_type").alias("Category"),
        F.col("p_brand").alias("Brand"),
        F.upper("p_brand").alias("brand"),
        F.col("p_retailprice").alias("Price (€)"),
        F.col("p_size").alias("shelf"),
    )
    return src.apply_schema_map(raw)


@query(
    "map_logical_columns",
    """SELECT p_partkey AS row_id, p_name AS product, CAST(p_retailprice AS VARCHAR) AS price,
              p_type AS category, p_brand AS description FROM part""",
)
def map_logical_columns(spark, d):
    raw = b.table(spark, d, "part").select(
        F.col("p_partkey").alias("row_id"),
        F.col("p_brand").alias("Details"),
        F.col("p_name").alias(" Nombre "),
        F.col("p_retailprice").cast("string").alias("PVP"),
        F.col("p_type").alias("CATEGORY_NAME"),
        F.col("p_size").alias("size"),
    )
    return src.select_logical(raw)


@query(
    "infer_text_columns",
    """SELECT p_partkey AS row_id, p_name AS "Name", p_type AS "CATEGORY", p_brand AS "Brand"
       FROM part""",
)
def infer_text_columns(spark, d):
    raw = b.table(spark, d, "part").select(
        F.col("p_partkey").alias("row_id"),
        F.col("p_brand").alias("Brand"),
        F.col("p_name").alias("Name"),
        F.col("p_type").alias("CATEGORY"),
        F.col("p_size").cast("string").alias("size"),
    )
    return raw.select("row_id", *src.infer_text_columns(raw))


@query(
    "normalize_catalog_text",
    duck(f"""
    SELECT row_id, product_name, brand, category, size, skin_types, md5(features) AS features_md5
    FROM (SELECT row_id, {sql_strip("concat('  Crème ', product_name, ' ')").replace("'  Crème '", "'Creme '")} AS product_name,
                 brand, category, size, coalesce(skin_types, '') AS skin_types,
                 {sql_strip(sql_unaccent("coalesce(features, '')"))} AS features FROM catalog_text)"""),
)
def normalize_catalog_text(spark, d):
    rows = b.catalog_text(spark, d).withColumn(
        "product_name", F.concat(F.lit("  Crème "), "product_name", F.lit(" "))
    )
    out = cat.normalize_catalog_text(rows, TEXT_FIELDS)
    return out.select(
        "row_id", "product_name", "brand", "category", "size", "skin_types", digest("features")
    )


@query(
    "coerce_price",
    """SELECT p_partkey AS row_id, TRY_CAST(t AS DOUBLE) AS price_eur
       FROM (SELECT p_partkey, CASE WHEN p_brand = 'Brand#2' THEN '12,50'
                                    WHEN p_brand = 'Brand#3' THEN 'ask'
                                    WHEN p_brand = 'Brand#4' THEN NULL
                                    ELSE CAST(p_retailprice AS VARCHAR) END AS t FROM part)""",
)
def coerce_price(spark, d):
    brand = F.col("p_brand")
    text = (
        F.when(brand == "Brand#2", "12,50")
        .when(brand == "Brand#3", "ask")
        .when(brand != "Brand#4", F.col("p_retailprice").cast("string"))
    )
    raw = b.table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), text.alias("price_eur"))
    return cat.coerce_price(raw)


def retrieval_text_sql(features: str) -> str:
    return (
        f"concat_ws(' | ', nullif(product_name, ''), nullif(brand, ''), nullif(category, ''), "
        f"nullif({features}, ''), nullif(skin_types, ''), {PRICE})"
    )


@query(
    "build_retrieval_text",
    duck(f"""
    SELECT row_id, md5({retrieval_text_sql('features')}) AS retrieval_text_md5,
           length({retrieval_text_sql('features')}) AS n_chars
    FROM (SELECT * REPLACE (CASE WHEN brand = 'Brand#2' THEN '' ELSE brand END AS brand,
                            CASE WHEN brand = 'Brand#3' THEN NULL ELSE price_eur END AS price_eur)
          FROM catalog_text)"""),
)
def build_retrieval_text(spark, d):
    rows = b.catalog_text(spark, d).withColumns(
        {
            "price_eur": F.when(F.col("brand") != "Brand#3", F.col("price_eur")),
            "brand": F.when(F.col("brand") == "Brand#2", "").otherwise(F.col("brand")),
        }
    )
    out = cat.build_retrieval_text(rows)
    return out.select(
        "row_id", digest("retrieval_text"), F.length("retrieval_text").cast("long").alias("n_chars")
    )


@query(
    "make_corpus",
    duck("""
    SELECT row_id, concat(coalesce(product_name, ''), ' - ', coalesce(skin_types, ''), ' - ',
                          coalesce(brand, '')) AS corpus FROM catalog_text"""),
)
def make_corpus(spark, d):
    rows = b.catalog_text(spark, d).select(
        "row_id", "brand", F.col("product_name").alias("name"), F.col("skin_types").alias("description")
    )
    assert src.infer_text_columns(rows) == [c for c in CORPUS_FIELDS if c in rows.columns]
    return rows.select("row_id", cat.make_corpus(rows).alias("corpus"))


CARD_SQL = """
    SELECT row_id, product_name, brand, category, {benefits}, '' AS key_ingredients,
           coalesce(skin_types, '') AS skin_types, {price} AS price_eur,
           {short}, '' AS contraindications
    FROM catalog_text"""


def _card_rows(spark, d):
    """Benefits are known for some brands only, so the rest fall back to the features."""
    return b.catalog_text(spark, d).withColumns(
        {
            "benefits": F.when(F.col("brand").isin("Brand#2", "Brand#3"), F.concat("brand", F.lit(" fits"))),
            "price_eur": F.when(F.col("category") != "promo", F.col("price_eur")),
            "short_description": F.col("features"),
        }
    )


BENEFITS = "coalesce(CASE WHEN brand IN ('Brand#2', 'Brand#3') THEN concat(brand, ' fits') END, features, '')"
CARD_PRICE = "CASE WHEN category <> 'promo' THEN price_eur END"


@query(
    "product_card",
    duck(CARD_SQL.format(
        benefits=f"md5({BENEFITS}) AS benefits_md5",
        price=CARD_PRICE,
        short="md5(coalesce(features, '')) AS short_description_md5",
    )),
)
def product_card(spark, d):
    rows = _card_rows(spark, d)
    flat = rows.select("row_id", cat.product_card(rows).alias("card")).select("row_id", "card.*")
    return (
        flat.withColumns({"benefits_md5": F.md5("benefits"), "short_description_md5": F.md5("short_description")})
        .drop("benefits", "short_description")
    )


def lean_sql(expr: str, limit: int) -> str:
    return f"CASE WHEN length({expr}) > {limit} THEN concat(substr({expr}, 1, {limit}), '…') ELSE {expr} END"


@query(
    "lean_card",
    duck(CARD_SQL.format(
        benefits=f"{lean_sql(BENEFITS, 280)} AS benefits",
        price=CARD_PRICE,
        short=f"{lean_sql(chr(99) + 'oalesce(features, ' + chr(39) * 2 + ')', 280)} AS short_description",
    )),
)
def lean_card(spark, d):
    rows = _card_rows(spark, d)
    card = rows.select("row_id", cat.product_card(rows).alias("card"))
    return card.select("row_id", cat.lean_card(F.col("card")).alias("card")).select("row_id", "card.*")


@query(
    "source_label",
    duck("""
    SELECT row_id, CASE WHEN brand = 'Brand#2' THEN concat('row ', row_id) ELSE product_name END AS label
    FROM catalog"""),
)
def source_label(spark, d):
    name = F.when(F.col("brand") == "Brand#2", "").otherwise(F.col("product_name"))
    rows = b.catalog(spark, d).withColumn("product_name", name)
    return rows.select("row_id", cat.source_label(F.col("product_name"), F.col("row_id")).alias("label"))


@query(
    "unusable_catalogs",
    """
    SELECT tenant_id, CAST(count(o) AS BIGINT) AS n_rows, CAST(count(named) AS BIGINT) AS n_named,
           CASE WHEN count(o) = 0 THEN 'empty' ELSE 'no product_name' END AS reason
    FROM (SELECT c_custkey AS tenant_id, o_orderkey AS o,
                 CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS named
          FROM customer LEFT JOIN orders ON o_custkey = c_custkey)
    GROUP BY tenant_id HAVING count(named) = 0""",
)
def unusable_catalogs(spark, d):
    """Customers as tenants, their orders as catalog rows; only filled orders carry a name."""
    tenants = b.table(spark, d, "customer").select(F.col("c_custkey").alias("tenant_id"))
    rows = b.table(spark, d, "orders").select(
        F.col("o_custkey").alias("tenant_id"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("product_name"),
    )
    return cat.unusable_catalogs(tenants, rows)


@query(
    "catalog_as_records",
    duck("""
    SELECT row_id, concat('{"tenant_id":"', tenant_id, '","row_id":', row_id, ',"product_name":"', product_name,
      '","category":', CASE WHEN category = 'promo' THEN 'null' ELSE concat('"', category, '"') END, '}') AS record
    FROM catalog"""),
)
def catalog_as_records(spark, d):
    rows = b.catalog(spark, d).select(
        "tenant_id", "row_id", "product_name",
        F.when(F.col("category") != "promo", F.col("category")).alias("category"),
    )
    return cat.as_records(rows).select("row_id", "record")


@query(
    "unaccent_text",
    f"""
    SELECT 'doc' AS kind, doc_id AS id, md5({sql_unaccent('text')}) AS text_md5 FROM documents
    UNION ALL
    SELECT 'turn', conv_id * 1000 + turn, md5({sql_unaccent('text')}) FROM conversations""",
)
def unaccent_text(spark, d):
    docs = b.table(spark, d, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "text")
    turns = b.table(spark, d, "conversations").select(
        F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"
    )
    return docs.union(turns).select("kind", "id", F.md5(unaccent(F.col("text"))).alias("text_md5"))


@query(
    "extract_price_number",
    f"""
    SELECT p_partkey AS row_id,
      round(TRY_CAST(replace(nullif(regexp_extract(replace(t, ' ', ''),
            {sql_text('([0-9]+(?:[.,][0-9]{1,2})?)')}, 1), ''), ',', '.') AS DOUBLE), 2) AS price
    FROM (SELECT p_partkey, CASE p_type
            WHEN 'ECONOMY' THEN concat('€', p_partkey, ',5', p_size % 10)
            WHEN 'SMALL' THEN concat('- ', p_partkey, ' . 50 EUR')
            WHEN 'LARGE' THEN 'on request' WHEN 'PROMO' THEN NULL
            ELSE CAST(p_retailprice AS VARCHAR) END AS t FROM part)""",
)
def extract_price_number(spark, d):
    from ..functions.price import extract_price_number as extract

    kind, key = F.col("p_type"), F.col("p_partkey").cast("string")
    text = (
        F.when(kind == "ECONOMY", F.concat(F.lit("€"), key, F.lit(",5"), (F.col("p_size") % 10).cast("string")))
        .when(kind == "SMALL", F.concat(F.lit("- "), key, F.lit(" . 50 EUR")))
        .when(kind == "LARGE", "on request")
        .when(kind != "PROMO", F.col("p_retailprice").cast("string"))
    )
    return b.table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), extract(text).alias("price"))


@query(
    "json_unescaped",
    """SELECT conv_id, turn, concat('{"role":"', role, '","note":null,"text":', to_json(text), '}') AS line
       FROM conversations""",
)
def json_unescaped(spark, d):
    rows = b.table(spark, d, "conversations")
    value = F.struct("role", F.lit(None).cast("string").alias("note"), "text")
    return rows.select("conv_id", "turn", json_text(value).alias("line"))
