"""Catalog quality, index and tenancy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed_values import CATALOG_FILE, REQUIRED_PATTERNS, REQUIRED_PROMPTS
from ..operators import index as ix
from ..operators import quality as q
from ..operators import tenancy as ten
from ..operators.catalog import build_retrieval_text
from ..session import dealt, materialized, shared_dir
from ..sources import store as st
from . import bindings as b
from .bindings import DIM, duck, sql_hash_raw, sql_normalized, sql_text
from .catalog import PRICE
from .registry import query

# Catalogs with defects: one tenant per brand; some lack prices, categories or descriptions.
DIRTY = (
    "dirty",
    """
    SELECT p_brand AS tenant_id, p_partkey AS row_id, p_name AS product,
           CASE WHEN p_brand = 'Brand#3' AND p_size < 10 THEN NULL
                WHEN p_size = 11 THEN '0,00' WHEN p_size = 12 THEN 'on request'
                ELSE concat('€ ', CAST(p_retailprice AS VARCHAR)) END AS price,
           CASE WHEN p_brand = 'Brand#4' AND p_size < 20 THEN NULL ELSE lower(p_type) END AS category,
           CASE WHEN p_size < 5 THEN 'short' WHEN p_size < 8 THEN NULL
                ELSE concat(p_name, ' in size ', p_size) END AS description
    FROM part""",
)
# Known categories: not all in use, and none at all for one tenant.
VALID = (
    "valid_categories",
    """SELECT DISTINCT p_brand AS tenant_id, lower(p_type) AS category FROM part
       WHERE p_type NOT IN ('PROMO', 'SMALL') AND p_brand <> 'Brand#7'""",
)


def dirty(spark, d):
    size, brand = F.col("p_size"), F.col("p_brand")
    price = (
        F.when((brand == "Brand#3") & (size < 10), F.lit(None))
        .when(size == 11, "0,00")
        .when(size == 12, "on request")
        .otherwise(F.concat(F.lit("€ "), F.col("p_retailprice").cast("string")))
    )
    text = F.concat("p_name", F.lit(" in size "), size.cast("string"))
    return b.table(spark, d, "part").select(
        brand.alias("tenant_id"),
        F.col("p_partkey").alias("row_id"),
        F.col("p_name").alias("product"),
        price.alias("price"),
        F.when(~((brand == "Brand#4") & (size < 20)), F.lower("p_type")).alias("category"),
        F.when(size < 5, "short").when(size >= 8, text).alias("description"),
    )


def valid_categories(spark, d):
    return (
        b.table(spark, d, "part")
        .where("p_type NOT IN ('PROMO', 'SMALL') AND p_brand <> 'Brand#7'")
        .select(F.col("p_brand").alias("tenant_id"), F.lower("p_type").alias("category"))
        .distinct()
    )


@query(
    "null_ratio",
    duck("""
    SELECT tenant_id, "column", round(r, 6) AS null_ratio, r > 0.05 AS too_many FROM (
      SELECT tenant_id, 'product' AS "column", avg(CASE WHEN product IS NULL THEN 1.0 ELSE 0.0 END) AS r FROM dirty GROUP BY 1
      UNION ALL SELECT tenant_id, 'price', avg(CASE WHEN price IS NULL THEN 1.0 ELSE 0.0 END) FROM dirty GROUP BY 1
      UNION ALL SELECT tenant_id, 'category', avg(CASE WHEN category IS NULL THEN 1.0 ELSE 0.0 END) FROM dirty GROUP BY 1)""",
    DIRTY),
)
def null_ratio(spark, d):
    return q.null_ratio(dirty(spark, d)).withColumn("null_ratio", F.round("null_ratio", 6))


DUPLICATES = ("dup", "SELECT *, count(*) OVER (PARTITION BY tenant_id, product) AS n FROM dirty")


@query("duplicate_products", duck("SELECT tenant_id, row_id, product, n FROM dup WHERE n > 1", DIRTY, DUPLICATES))
def duplicate_products(spark, d):
    return q.duplicate_products(dirty(spark, d)).select("tenant_id", "row_id", "product", "n")


SAMPLED = (
    "sampled",
    """SELECT tenant_id, row_id, product, row_number() OVER (PARTITION BY tenant_id ORDER BY row_id) AS position
       FROM dup WHERE n > 1 QUALIFY position <= 10""",
)


@query("sample_duplicates", duck("SELECT * FROM sampled", DIRTY, DUPLICATES, SAMPLED))
def sample_duplicates(spark, d):
    return q.sample_duplicates(dirty(spark, d))


@query(
    "short_descriptions",
    duck("""
    SELECT tenant_id, count(*) FILTER (WHERE length(coalesce(description, '')) < 10) AS short_descriptions
    FROM dirty GROUP BY 1""", DIRTY),
)
def short_descriptions(spark, d):
    return q.short_descriptions(dirty(spark, d))


UNKNOWN = (
    "unknown_in_use",
    """SELECT DISTINCT tenant_id, category FROM dirty c
       WHERE category IS NOT NULL
         AND tenant_id IN (SELECT tenant_id FROM valid_categories)
         AND NOT EXISTS (SELECT 1 FROM valid_categories v
                         WHERE v.tenant_id = c.tenant_id AND v.category = c.category)""",
)


@query("unknown_categories", duck("SELECT tenant_id, category FROM unknown_in_use", DIRTY, VALID, UNKNOWN))
def unknown_categories(spark, d):
    return q.unknown_categories(dirty(spark, d), valid_categories(spark, d))


@query(
    "category_difference",
    duck("""SELECT DISTINCT category FROM dirty WHERE category IS NOT NULL
            EXCEPT SELECT category FROM valid_categories""", DIRTY, VALID),
)
def category_difference(spark, d):
    return q.category_difference(dirty(spark, d), valid_categories(spark, d))


PRICED = (
    "priced",
    f"""SELECT *, round(TRY_CAST(replace(nullif(regexp_extract(replace(price, ' ', ''),
          {sql_text('([0-9]+(?:[.,][0-9]{1,2})?)')}, 1), ''), ',', '.') AS DOUBLE), 2) AS p FROM dirty""",
)


COUNTED = (
    "counted",
    """
    SELECT c.*, coalesce(duplicates, 0) AS duplicates, examples,
           c.tenant_id IN (SELECT tenant_id FROM valid_categories) AS judged
    FROM (SELECT tenant_id, count(*) AS rows, count(p) AS price_ok, count(*) - count(p) AS price_bad,
                 count(*) FILTER (WHERE p < 0) AS price_neg, count(*) FILTER (WHERE p = 0) AS price_zero,
                 avg(CASE WHEN product IS NULL THEN 1.0 ELSE 0.0 END) AS null_product,
                 avg(CASE WHEN price IS NULL THEN 1.0 ELSE 0.0 END) AS null_price,
                 avg(CASE WHEN category IS NULL THEN 1.0 ELSE 0.0 END) AS null_category,
                 count(*) FILTER (WHERE length(coalesce(description, '')) < 10) AS short
          FROM priced GROUP BY 1) c
    LEFT JOIN (SELECT tenant_id, count(*) AS duplicates FROM dup WHERE n > 1 GROUP BY 1) USING (tenant_id)
    LEFT JOIN (SELECT tenant_id, string_agg(product, ''', ''' ORDER BY position) AS examples FROM sampled GROUP BY 1) USING (tenant_id)""",
)
REPORT_LINES = (
    "report_lines",
    """
    SELECT tenant_id, 'error' AS severity, concat('Columna ''product'' tiene ', printf('%.1f', null_product * 100), '% valores nulos (> 5%)') AS line, NULL AS detail
      FROM counted WHERE null_product > 0.05
    UNION ALL SELECT tenant_id, 'error', concat('Columna ''price'' tiene ', printf('%.1f', null_price * 100), '% valores nulos (> 5%)'), NULL
      FROM counted WHERE null_price > 0.05
    UNION ALL SELECT tenant_id, 'error', concat('Columna ''category'' tiene ', printf('%.1f', null_category * 100), '% valores nulos (> 5%)'), NULL
      FROM counted WHERE null_category > 0.05
    UNION ALL SELECT tenant_id, 'error', concat(price_bad, ' filas con precio inválido'), NULL FROM counted WHERE price_bad > 0
    UNION ALL SELECT tenant_id, 'error', concat(price_neg, ' filas con precio negativo'), NULL FROM counted WHERE price_neg > 0
    UNION ALL SELECT tenant_id, 'error', concat(duplicates, ' productos duplicados (ejemplos: [''', examples, '''])'), NULL FROM counted WHERE duplicates > 0
    UNION ALL SELECT tenant_id, 'warning', concat(price_zero, ' filas con precio 0.00'), NULL FROM counted WHERE price_zero > 0
    UNION ALL SELECT tenant_id, 'warning', concat('categorías desconocidas: [''', category, ''']'), category FROM unknown_in_use
    UNION ALL SELECT tenant_id, 'warning', 'No se validaron categorías (falta data/patterns/category_patterns.yaml o ''categories'')', NULL
      FROM counted WHERE NOT judged
    UNION ALL SELECT tenant_id, 'warning', concat(short, ' descripciones con menos de 10 caracteres'), NULL FROM counted WHERE short > 0""",
)


@query(
    "catalog_quality_report",
    duck("""
    SELECT c.tenant_id, rows, price_ok, price_bad, price_neg, price_zero, duplicates, severity, line, detail
    FROM counted c LEFT JOIN report_lines USING (tenant_id)""",
    DIRTY, VALID, DUPLICATES, SAMPLED, UNKNOWN, PRICED, COUNTED, REPORT_LINES),
)
def catalog_quality_report(spark, d):
    return q.catalog_quality_report(dirty(spark, d), valid_categories(spark, d))


# --- index -----------------------------------------------------------------------------------

MODEL = "test-model"
TEXT = f"concat_ws(' | ', nullif(product_name, ''), nullif(brand, ''), nullif(category, ''), {PRICE})"
SIGNED = (
    "signed",
    f"""
    SELECT tenant_id, sha256(concat(sha256(string_agg(node, chr(10) ORDER BY upper)), '|{MODEL}|retriever_v1_tree')) AS signature
    FROM (SELECT tenant_id, block // 4096 AS upper, sha256(string_agg(node, chr(10) ORDER BY block)) AS node
          FROM (SELECT tenant_id, row_id // 4096 AS block, sha256(string_agg(sha256({TEXT}), chr(10) ORDER BY row_id)) AS node
                FROM catalog GROUP BY 1, 2) GROUP BY 1, 2)
    GROUP BY 1""",
)
# A store made earlier: complete for most tenants, out of date for one, absent for another.
STORED = (
    "stored",
    """SELECT c.tenant_id, row_id, vec,
              CASE WHEN tenant_id = 't1' THEN 'older' ELSE signature END AS signature
       FROM catalog_vec c JOIN signed USING (tenant_id) WHERE tenant_id <> 't2'""",
)


def texts(spark, d):
    return build_retrieval_text(b.catalog(spark, d))


def signatures(spark, d):
    return ix.catalog_signature(texts(spark, d), MODEL)


def stored(spark, d, signed=None):
    older = F.when(F.col("tenant_id") == "t1", "older").otherwise(F.col("signature"))
    rows = b.catalog_vec(spark, d).where("tenant_id <> 't2'").select("tenant_id", "row_id", "vec")
    return rows.join(signed or signatures(spark, d), "tenant_id").withColumn("signature", older)


def meta(spark, d, store=None):
    """Metadata of the store; one tenant's count is off by one."""
    off = F.when(F.col("tenant_id") == "t3", F.col("count") + 1).otherwise(F.col("count"))
    return ix.index_meta(store or stored(spark, d), MODEL).withColumn("count", off)


@query("catalog_signature", duck("SELECT tenant_id, signature FROM signed", SIGNED))
def catalog_signature(spark, d):
    return signatures(spark, d)


@query(
    "write_embedding_store",
    duck(f"""
    SELECT s.tenant_id, s.row_id, s.signature, round(CAST(s.vec[1] AS DOUBLE) / n, 5) AS first,
           'text-embedding-3-large' AS embedding_model, {DIM} AS dim, m.count
    FROM (SELECT *, sqrt(list_sum(list_transform(CAST(vec AS DOUBLE[]), lambda x: x * x))) AS n FROM stored) s
    JOIN (SELECT tenant_id, count(*) AS count FROM stored GROUP BY 1) m USING (tenant_id)""", SIGNED, STORED),
)
def write_embedding_store(spark, d):
    path = shared_dir(spark, "embedding-store")
    st.write_embedding_store(stored(spark, d), path)
    vectors = st.read_store(spark, path).drop("dim")
    about = st.read_store(spark, path, "meta").drop("signature")
    return vectors.join(about, "tenant_id").select(
        "tenant_id", "row_id", "signature",
        F.round(F.col("vec")[0].cast("double"), 5).alias("first"),
        "embedding_model", "dim", "count",
    )


@query(
    "read_embedding_store",
    duck("SELECT s.tenant_id, s.row_id, len(s.vec) AS dim FROM stored s JOIN signed USING (tenant_id, signature)", SIGNED, STORED),
)
def read_embedding_store(spark, d):
    path = shared_dir(spark, "embedding-store")
    st.write_embedding_store(stored(spark, d), path)
    found = st.read_embedding_store(spark, path, signatures(spark, d))
    return found.select("tenant_id", "row_id", F.size("vec").cast("long").alias("dim"))


@query(
    "index_stats",
    duck("""
    SELECT tenant_id, count(*) AS count, max(len(vec)) AS dim, CAST(sum(len(vec)) * 4 AS BIGINT) AS bytes
    FROM catalog_vec GROUP BY 1"""),
)
def index_stats(spark, d):
    return ix.index_stats(b.catalog_vec(spark, d))


@query(
    "index_meta_mismatch",
    duck(f"""
    SELECT tenant_id, count(*) AS count, count(*) + 1 AS meta_count, {DIM} AS dim FROM stored
    WHERE tenant_id = 't3' GROUP BY 1""", SIGNED, STORED),
)
def index_meta_mismatch(spark, d):
    bad = ix.index_meta_mismatch(stored(spark, d), meta(spark, d))
    return bad.select("tenant_id", "count", "meta_count", "dim")


@query(
    "index_readiness",
    duck("""
    SELECT tenant_id, n.count AS count,
      concat_ws('; ', CASE WHEN tenant_id = 't4' THEN 'not registered' END,
        CASE WHEN c.tenant_id IS NULL THEN 'assistant: catalog unusable' END,
        CASE WHEN c.tenant_id IS NOT NULL AND n.count IS NULL THEN 'index: not found' END,
        CASE WHEN tenant_id = 't3' THEN 'index: metadata mismatch' END) AS errors,
      tenant_id IN ('t0', 't1') AS ok
    FROM (SELECT DISTINCT tenant_id FROM catalog UNION ALL SELECT 't9') w
    LEFT JOIN (SELECT DISTINCT tenant_id FROM catalog) c USING (tenant_id)
    LEFT JOIN (SELECT tenant_id, count(*) AS count FROM stored GROUP BY 1) n USING (tenant_id)""",
    SIGNED, STORED),
)
def index_readiness(spark, d):
    catalogs = b.catalog(spark, d)
    known = catalogs.select("tenant_id").distinct()
    extra = spark.createDataFrame([("t9",)], "tenant_id string")
    registry = known.union(extra).where("tenant_id <> 't4'")
    out = ix.index_readiness(
        known.union(extra), registry, catalogs, stored(spark, d), meta(spark, d)
    )
    return out.select("tenant_id", "count", F.array_join("errors", "; ").alias("errors"), "ok")


def rebuilt(fresh: str) -> str:
    """``fresh``: which stored rows are up to date."""
    return f"""
    SELECT tenant_id, row_id, signature, true AS reused,
           CAST(NULL AS DOUBLE) AS first FROM stored JOIN signed USING (tenant_id, signature) WHERE {fresh}
    UNION ALL
    SELECT tenant_id, row_id, signature, false,
           round(CAST(CAST(({sql_normalized('raw')})[1] AS FLOAT) AS DOUBLE), 5)
    FROM (SELECT c.tenant_id, c.row_id, s.signature, {sql_hash_raw(TEXT, DIM)} AS raw
          FROM catalog c JOIN signed s USING (tenant_id)
          WHERE c.tenant_id NOT IN (SELECT tenant_id FROM stored JOIN signed USING (tenant_id, signature) WHERE {fresh}))"""


# The metadata say that one tenant's index has another number of rows than its catalog.
@query("embedding_cache_join", duck(rebuilt("tenant_id <> 't3'"), SIGNED, STORED))
def embedding_cache_join(spark, d):
    signed = materialized(signatures(spark, d), "signatures")
    store = stored(spark, d, signed)
    out = ix.embedding_cache_join(texts(spark, d), signed, store, meta(spark, d, store), dim=DIM)
    first = F.when(~F.col("reused"), F.round(F.col("vec")[0].cast("double"), 5))
    return out.select("tenant_id", "row_id", "signature", "reused", first.alias("first"))


@query("rebuild_embeddings", duck(rebuilt("true").replace("true AS reused,", "").replace("false,", ""), SIGNED, STORED))
def rebuild_embeddings(spark, d):
    """One job over all tenants that touches only out-of-date indexes; then the store is read."""
    path = shared_dir(spark, "rebuilt")
    st.write_embedding_store(stored(spark, d), path, MODEL)
    catalog = texts(spark, d)
    wanted = st.rebuild_embeddings(catalog, path, MODEL, dim=DIM)
    back = st.read_embedding_store(spark, path, wanted)
    fresh = F.col("tenant_id").isin("t1", "t2")
    return back.select(
        "tenant_id", "row_id", "signature",
        F.when(fresh, F.round(F.col("vec")[0].cast("double"), 5)).alias("first"),
    )


def shape(texts_: list[str]) -> list[list[float]]:
    """A stand-in model: length and number of blanks."""
    return [[float(len(t)), float(t.count(" "))] for t in texts_]


@query(
    "embed_texts",
    duck(f"""
    SELECT row_id, round(CAST(CAST(({sql_normalized('raw')})[1] AS FLOAT) AS DOUBLE), 6) AS hashed,
           CAST(length(t) AS DOUBLE) AS chars, CAST(length(t) - length(replace(t, ' ', '')) AS DOUBLE) AS blanks
    FROM (SELECT row_id, {TEXT} AS t, {sql_hash_raw(TEXT, 384)} AS raw FROM catalog)"""),
)
def embed_texts(spark, d):
    rows = texts(spark, d).select("row_id", "retrieval_text")
    hashed = ix.embed(rows, "retrieval_text").withColumnRenamed("vec", "hashed")
    both = ix.embed(hashed, "retrieval_text", shape)
    return both.select(
        "row_id",
        F.round(F.col("hashed")[0].cast("double"), 6).alias("hashed"),
        F.col("vec")[0].cast("double").alias("chars"),
        F.col("vec")[1].cast("double").alias("blanks"),
    )


# --- tenancy ---------------------------------------------------------------------------------

# Customers as tenants; which files they have follows from their attributes.
FILES = [("prompts", f) for f in REQUIRED_PROMPTS] + [("patterns", f) for f in REQUIRED_PATTERNS] + [("", CATALOG_FILE)]
# What a customer's files, profile and assets are told by.
FILE_FACTS = "c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal"
HAS_FILE = """
    CASE WHEN file = 'products_catalog.csv' THEN c_acctbal >= 0
         WHEN folder = 'prompts' THEN c_mktsegment <> 'FURNITURE'
              AND NOT (file = 'compose_prompt.txt' AND c_mktsegment = 'BUILDING')
         WHEN file = 'price_patterns.yaml' THEN c_nationkey < 5
         ELSE c_nationkey < 10 END"""
INVENTORY = (
    "inventory",
    f"""
    SELECT concat('u', c_custkey) AS tenant_id, folder, file FROM customer,
      (SELECT unnest([{', '.join(f"'{a}'" for a, _ in FILES)}]) AS folder,
              unnest([{', '.join(f"'{f}'" for _, f in FILES)}]) AS file) f
    WHERE {HAS_FILE}""",
)


def inventory(spark, d):
    files = F.array(*[F.struct(F.lit(a).alias("folder"), F.lit(f).alias("file")) for a, f in FILES])
    customers = dealt(b.table(spark, d, "customer").select(*FILE_FACTS), "c_custkey")
    rows = customers.select("*", F.explode(files).alias("f")).select("*", "f.*")
    name = F.concat(F.lit("u"), F.col("c_custkey").cast("string"))
    return rows.where(F.expr(HAS_FILE)).select(name.alias("tenant_id"), "folder", "file")


def clients(spark, d):
    name = F.concat(F.lit("u"), F.col("c_custkey").cast("string"))
    return dealt(b.table(spark, d, "customer").select(*FILE_FACTS), "c_custkey").withColumn("tenant_id", name)


@query(
    "missing_tenant_assets",
    duck(f"""
    SELECT t.tenant_id, r.folder, r.file FROM (SELECT concat('u', c_custkey) AS tenant_id, c_mktsegment, c_nationkey FROM customer) t,
      (SELECT unnest([{', '.join(f"'{a}'" for a, _ in FILES)}]) AS folder,
              unnest([{', '.join(f"'{f}'" for _, f in FILES)}]) AS file) r
    WHERE NOT (r.folder = 'prompts' AND c_mktsegment = 'FURNITURE')
      AND NOT (r.folder = 'patterns' AND c_nationkey >= 10)
      AND NOT EXISTS (SELECT 1 FROM inventory i WHERE i.tenant_id = t.tenant_id AND i.folder = r.folder AND i.file = r.file)
    UNION ALL SELECT concat('u', c_custkey), 'prompts', '' FROM customer WHERE c_mktsegment = 'FURNITURE'
    UNION ALL SELECT concat('u', c_custkey), 'profile', 'locale' FROM customer WHERE c_nationkey = 3""", INVENTORY),
)
def missing_tenant_assets(spark, d):
    tenants = clients(spark, d)
    keys = tenants.select(
        "tenant_id", "c_nationkey", F.explode(F.array(F.lit("id"), F.lit("name"), F.lit("locale"))).alias("key")
    ).where("NOT (key = 'locale' AND c_nationkey = 3)")
    return ten.missing_tenant_assets(tenants, inventory(spark, d), keys)


# Each region's base profile, overridden per customer.
OVERRIDES_SQL = """
    SELECT concat('u', c_custkey) AS tenant_id, 'top_k' AS key_path, CAST(c_custkey % 9 AS VARCHAR) AS value
      FROM customer WHERE c_mktsegment = 'AUTOMOBILE'
    UNION ALL SELECT concat('u', c_custkey), 'models', 'none' FROM customer WHERE c_mktsegment = 'BUILDING'
    UNION ALL SELECT concat('u', c_custkey), 'temperature.night', NULL FROM customer WHERE c_nationkey < 5
    UNION ALL SELECT concat('u', c_custkey), 'models.chat', concat('chat-', c_nationkey) FROM customer
      WHERE c_mktsegment = 'FURNITURE'"""
DEFAULTS_SQL = """
    SELECT r_name AS base, unnest(['top_k', 'temperature', 'models.embedding', 'models.chat', 'paths.prompts.system']) AS key_path,
           unnest(['5', '0.6', concat('embed-', r_regionkey), 'chat', concat(lower(r_name), '/system.txt')]) AS value
    FROM region"""


@query(
    "layered_override_resolve",
    f"""
    WITH o AS ({OVERRIDES_SQL}), b AS ({DEFAULTS_SQL}),
    t AS (SELECT concat('u', c_custkey) AS tenant_id, r_name AS base FROM customer
          JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT tenant_id, key_path, value, 'override' AS layer FROM o
    UNION ALL
    SELECT t.tenant_id, b.key_path, b.value, 'base' FROM t JOIN b USING (base)
    WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.tenant_id = t.tenant_id AND (o.key_path = b.key_path
          OR starts_with(b.key_path, o.key_path || '.') OR starts_with(o.key_path, b.key_path || '.')))""",
)
def layered_override_resolve(spark, d):
    t = b.table
    tenants = (
        clients(spark, d)
        .join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("tenant_id", F.col("r_name").alias("base"))
    )
    leaf = lambda path, value: F.struct(F.lit(path).alias("key_path"), value.cast("string").alias("value"))
    leaves = F.array(
        leaf("top_k", F.lit("5")),
        leaf("temperature", F.lit("0.6")),
        leaf("models.embedding", F.concat(F.lit("embed-"), F.col("r_regionkey").cast("string"))),
        leaf("models.chat", F.lit("chat")),
        leaf("paths.prompts.system", F.concat(F.lower("r_name"), F.lit("/system.txt"))),
    )
    defaults = t(spark, d, "region").select(F.col("r_name").alias("base"), F.explode(leaves).alias("l")).select("base", "l.*")
    segment = F.col("c_mktsegment")
    own = F.array_compact(
        F.array(
            F.when(segment == "AUTOMOBILE", leaf("top_k", F.col("c_custkey") % 9)),
            F.when(segment == "BUILDING", leaf("models", F.lit("none"))),
            F.when(F.col("c_nationkey") < 5, leaf("temperature.night", F.lit(None))),
            F.when(segment == "FURNITURE", leaf("models.chat", F.concat(F.lit("chat-"), F.col("c_nationkey").cast("string")))),
        )
    )
    overrides = clients(spark, d).select("tenant_id", F.explode(own).alias("l")).select("tenant_id", "l.*")
    return ten.layered_override_resolve(tenants, defaults, overrides)


@query(
    "asset_fallback_resolve",
    duck("""
    SELECT tenant_id, key, CASE
        WHEN key = 'data_csv' THEN CASE WHEN c_acctbal >= 0 THEN concat(tenant_id, '/products_catalog.csv') END
        WHEN key = 'category_patterns' THEN CASE WHEN c_nationkey < 10 THEN concat(tenant_id, '/patterns/category_patterns.yaml')
             WHEN c_mktsegment = 'BUILDING' AND c_nationkey < 15 THEN concat('shared/', c_nationkey, '/category_patterns.yaml')
             ELSE 'global/category_patterns.yaml' END
        ELSE CASE WHEN c_mktsegment = 'BUILDING' THEN CASE WHEN c_nationkey < 15 THEN concat('shared/', c_nationkey, '/system_prompt.txt')
                       ELSE 'global/system_prompt.txt' END
             WHEN c_mktsegment = 'FURNITURE' THEN 'global/system_prompt.txt'
             ELSE concat(tenant_id, '/prompts/system_prompt.txt') END END AS path,
      CASE WHEN key = 'data_csv' AND c_acctbal < 0 THEN 'catalog not found' END AS error
    FROM (SELECT *, concat('u', c_custkey) AS tenant_id, unnest(['data_csv', 'category_patterns', 'system_prompt']) AS key FROM customer)"""),
)
def asset_fallback_resolve(spark, d):
    """Tenant files from the inventory; shared files exist for some nations only."""
    name, nation = F.col("tenant_id"), F.col("c_nationkey").cast("string")
    shared = lambda f: F.when(
        F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("shared/"), nation, F.lit("/" + f))
    )

    def asset(key, kind, own, override, fallback):
        return F.struct(
            F.lit(key).alias("key"), F.lit(kind).alias("kind"),
            F.concat(name, F.lit("/" + own)).alias("tenant_path"),
            override.cast("string").alias("override_path"), F.lit(fallback).cast("string").alias("global_path"),
        )

    assets = F.array(
        asset("data_csv", "catalog", CATALOG_FILE, F.lit(None), None),
        asset("category_patterns", "pattern", "patterns/category_patterns.yaml", shared("category_patterns.yaml"), "global/category_patterns.yaml"),
        asset("system_prompt", "prompt", "prompts/system_prompt.txt", shared("system_prompt.txt"), "global/system_prompt.txt"),
    )
    wanted = clients(spark, d).select("tenant_id", F.explode(assets).alias("a")).select("tenant_id", "a.*")
    own = inventory(spark, d).select(
        F.concat_ws("/", "tenant_id", F.nullif("folder", F.lit("")), "file").alias("path")
    )
    nations = b.table(spark, d, "nation").where("n_nationkey < 15").select(
        F.explode(
            F.array(
                *[F.concat(F.lit("shared/"), F.col("n_nationkey").cast("string"), F.lit("/" + f))
                  for f in ("category_patterns.yaml", "system_prompt.txt")]
            )
        ).alias("path")
    )
    return ten.asset_fallback_resolve(wanted, own.union(nations))
