"""How the generic tables play the roles of catalogs, messages and request logs.

Each binding exists twice: as a DataFrame and, for the checks, as a SQL view of the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import TRANSLITERATIONS
from ..functions.price import DEFAULT_TERMS
from ..functions.text import ACCENTED, PLAIN
from ..functions.vector import hash_embedding
from ..operators.candidates import with_intent

DIM = 64
TOP_K = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- SQL fragments -------------------------------------------------------------------------


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_unaccent(expr: str) -> str:
    wide = expr
    for source, target in TRANSLITERATIONS.items():
        wide = f"replace({wide}, {sql_text(source)}, {sql_text(target)})"
    return f"translate({wide}, {sql_text(ACCENTED)}, {sql_text(PLAIN)})"


BLANK_SET = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(28) || chr(29) || chr(30) || chr(31)"


def sql_strip(expr: str) -> str:
    return f"trim({expr}, {BLANK_SET})"


def sql_number(text: str, pattern: str, group: int) -> str:
    found = f"nullif(regexp_extract({text}, {sql_text(pattern)}, {group}), '')"
    return f"cast(replace({found}, ',', '.') AS DOUBLE)"


def sql_between(text: str) -> tuple[str, str]:
    p = DEFAULT_TERMS.between_regex()
    a, b = sql_number(text, p, 1), sql_number(text, p, 2)
    return f"least({a}, {b})", f"greatest({a}, {b})"


def sql_under(text: str) -> str:
    return sql_number(text, DEFAULT_TERMS.under_regex(), 1)


def sql_currency(text: str) -> str:
    p = DEFAULT_TERMS.currency_regex()
    return f"coalesce({sql_number(text, p, 1)}, {sql_number(text, p, 2)})"


def sql_price(text: str) -> tuple[str, str]:
    """(lo, hi) with the precedence of the three grammars."""
    lo, hi = sql_between(text)
    under, cur = sql_under(text), sql_currency(text)
    return (
        f"CASE WHEN {hi} IS NOT NULL THEN {lo} WHEN {under} IS NOT NULL THEN CAST(0 AS DOUBLE) ELSE {cur} END",
        f"coalesce({hi}, {under}, {cur})",
    )


def sql_hash_raw(text: str, dim: int) -> str:
    digit = "(instr('0123456789abcdef', substr({h}, {p}, 1)) - 1)"
    hi = digit.format(h="h", p="(i % 32) * 2 + 1")
    lo = digit.format(h="h", p="(i % 32) * 2 + 2")
    return (
        f"(SELECT list_transform(range(0, {dim}), lambda i: ({hi} * 16 + {lo} - 127.5) / 127.5) "
        f"FROM (SELECT sha256({text}) AS h))"
    )


def sql_normalized(raw: str, epsilon: str = "0.0") -> str:
    norm = f"(sqrt(list_sum(list_transform({raw}, lambda y: y * y))) + {epsilon})"
    return f"list_transform({raw}, lambda x: x / {norm})"


VIEWS: dict[str, str] = {
    "catalog": """
        SELECT concat('t', p_partkey % 5) AS tenant_id, p_partkey AS row_id,
               p_name AS product_name, p_brand AS brand, lower(p_type) AS category,
               CAST(p_size AS VARCHAR) AS size, p_retailprice AS price_eur
        FROM part""",
    "catalog_text": """
        SELECT c.*, d.text AS features, d.lang AS skin_types
        FROM catalog c LEFT JOIN documents d ON c.row_id = d.doc_id""",
    "catalog_vec": f"""
        SELECT * EXCLUDE (raw, given), coalesce(given, CAST({sql_normalized('raw')} AS FLOAT[])) AS vec
        FROM (SELECT c.*, e.embedding AS given, {sql_hash_raw('c.product_name', DIM)} AS raw
              FROM catalog c LEFT JOIN embeddings e ON c.row_id = e.vec_id)""",
    "message_text": """
        SELECT p_partkey AS msg_id, concat('t', p_partkey % 5) AS tenant_id,
               CASE p_partkey % 3
                 WHEN 0 THEN concat('looking for a ', lower(p_type), ' item under ',
                                    CAST(CAST(floor(p_retailprice) AS BIGINT) + 2 AS VARCHAR))
                 WHEN 1 THEN concat('budget ', CAST(CAST(floor(p_retailprice) AS BIGINT) + 3 AS VARCHAR),
                                    ' to ', CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR))
                 ELSE concat('€', CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR))
               END AS message
        FROM part""",
    "patterns": """
        SELECT tenant_id, row_number() OVER (PARTITION BY tenant_id ORDER BY category) - 1 AS ordinal,
               category AS canonical, category AS keyword
        FROM (SELECT DISTINCT tenant_id, category FROM catalog)""",
    "intent": f"""
        SELECT m.*, {sql_price('message')[0]} AS lo, {sql_price('message')[1]} AS hi,
               list_filter(p.names, lambda c: contains(lower({sql_unaccent('m.message')}), c)) AS hints
        FROM message_text m
        LEFT JOIN (SELECT tenant_id, list(canonical ORDER BY ordinal) AS names
                   FROM patterns GROUP BY tenant_id) p USING (tenant_id)""",
    "messages": f"""
        SELECT i.*, CAST({sql_normalized('raw')} AS FLOAT[]) AS vec
        FROM (SELECT *, {sql_hash_raw('message', DIM)} AS raw FROM intent) i""",
    "sims": """
        SELECT m.tenant_id, m.msg_id, c.row_id, c.product_name, c.price_eur, c.category,
               m.lo, m.hi, m.hints,
               round(list_cosine_similarity(CAST(m.vec AS DOUBLE[]), CAST(c.vec AS DOUBLE[])), 9) AS sim,
               (m.lo IS NULL OR coalesce(c.price_eur BETWEEN m.lo AND m.hi, false))
                 AND (len(m.hints) = 0 OR coalesce(list_contains(m.hints, c.category), false)) AS ok
        FROM messages m JOIN catalog_vec c USING (tenant_id)""",
    "prefiltered": f"""
        SELECT tenant_id, msg_id, row_id, sim,
               row_number() OVER (PARTITION BY msg_id ORDER BY sim DESC, row_id) AS rank
        FROM (SELECT *, bool_or(ok) OVER (PARTITION BY msg_id) AS any_ok FROM sims)
        WHERE ok OR NOT any_ok
        QUALIFY rank <= {TOP_K}""",
    "chats": """
        SELECT conv_id, turn, concat('c', conv_id % 3) AS tenant_id,
               concat(text, CASE (conv_id + turn) % 7
                              WHEN 0 THEN ' I have eczema'
                              WHEN 1 THEN ' for Dry and sensitive skin'
                              WHEN 2 THEN ' an SPF Lotión or a gel?'
                              WHEN 3 THEN ' combo skin, severe acne'
                              WHEN 4 THEN ' a nice serum, menos de 12,50 €'
                              WHEN 5 THEN ' eczemas?' ELSE '' END) AS message
        FROM conversations WHERE role = 'user'""",
    "tenants": """
        SELECT concat('u', c_custkey) AS client_id, concat('k', c_custkey) AS api_key,
               CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE 2 + c_custkey % 4 END
                 AS max_requests_per_day
        FROM customer WHERE c_mktsegment <> 'MACHINERY'""",
    "requests": """
        SELECT event_id AS rid,
               CASE WHEN json_extract_string(props, '$.k') = '7' THEN NULL
                    ELSE concat('u', user_id) END AS client_id,
               CASE json_extract_string(props, '$.k')
                    WHEN '3' THEN NULL WHEN '4' THEN 'wrong' ELSE concat('k', user_id) END AS x_api_key,
               ts,
               CASE WHEN event_type IN ('click', 'purchase') THEN 'POST' ELSE 'GET' END AS method,
               CASE WHEN event_type IN ('click', 'purchase') THEN '/answer' ELSE '/greet' END AS path,
               CASE WHEN event_type = 'error' THEN 500
                    WHEN event_type = 'purchase' AND value > 150 THEN 429 ELSE 200 END AS status,
               CAST(floor(value * 10) AS INTEGER) AS latency_ms
        FROM events""",
    "usage": """
        SELECT concat('u', user_id) AS client_id, CAST(ts AS DATE) AS day,
               CAST(floor(value) AS BIGINT) AS chat_prompt,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS chat_completion,
               CAST(floor(value / 4) AS BIGINT) AS embedding
        FROM events""",
}


def duck(body: str, *extra: tuple[str, str]) -> str:
    """``body`` with the views it names, directly or through other views, as a WITH clause."""
    known = {**VIEWS, **dict(extra)}
    needed: list[str] = []

    def add(sql: str) -> None:
        for name in known:
            if name not in needed and re.search(rf"\b{name}\b", sql) and known[name] is not sql:
                add(known[name])
                if name not in needed:
                    needed.append(name)

    add(body)
    if not needed:
        return body
    clauses = ",\n".join(f"{n} AS ({known[n]})" for n in needed)
    return f"WITH {clauses}\n{body}"


# --- DataFrames ----------------------------------------------------------------------------


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("t"), (F.col("p_partkey") % 5).cast("string")).alias("tenant_id"),
        F.col("p_partkey").alias("row_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("brand"),
        F.lower("p_type").alias("category"),
        F.col("p_size").cast("string").alias("size"),
        F.col("p_retailprice").alias("price_eur"),
    )


def catalog_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog with a long, accented, multi-line text column where there is one."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("text").alias("features"), F.col("lang").alias("skin_types")
    )
    return catalog(spark, sf_dir).join(docs, "row_id", "left")


def catalog_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every product with its vector; one without gets the hash embedding of its name."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec")
    )
    whole = catalog(spark, sf_dir).join(vectors, "row_id", "left")
    return whole.withColumn("vec", F.coalesce("vec", hash_embedding(F.col("product_name"), DIM)))


def message_text_of(part: DataFrame) -> DataFrame:
    n = F.floor("p_retailprice")
    kind = F.col("p_partkey") % 3
    number = lambda x: x.cast("string")
    under = F.concat(F.lit("looking for a "), F.lower("p_type"), F.lit(" item under "), number(n + 2))
    between = F.concat(F.lit("budget "), number(n + 3), F.lit(" to "), number(n))
    exact = F.concat(F.lit("€"), number(n))
    return part.select(
        F.col("p_partkey").alias("msg_id"),
        F.concat(F.lit("t"), (F.col("p_partkey") % 5).cast("string")).alias("tenant_id"),
        F.when(kind == 0, under).when(kind == 1, between).otherwise(exact).alias("message"),
    )


def message_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return message_text_of(table(spark, sf_dir, "part"))


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenant's categories, alphabetical, each its own keyword."""
    names = catalog(spark, sf_dir).select("tenant_id", "category").distinct()
    per_tenant = names.groupBy("tenant_id").agg(F.sort_array(F.collect_set("category")).alias("c"))
    return per_tenant.select("tenant_id", F.posexplode("c").alias("ordinal", "canonical")).withColumn(
        "keyword", F.col("canonical")
    )


def intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_intent(message_text(spark, sf_dir), patterns(spark, sf_dir))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intent(spark, sf_dir).withColumn("vec", hash_embedding(F.col("message"), DIM))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = (F.col("conv_id") + F.col("turn")) % 7
    tail = (
        F.when(turn == 0, " I have eczema")
        .when(turn == 1, " for Dry and sensitive skin")
        .when(turn == 2, " an SPF Lotión or a gel?")
        .when(turn == 3, " combo skin, severe acne")
        .when(turn == 4, " a nice serum, menos de 12,50 €")
        .when(turn == 5, " eczemas?")
        .otherwise("")
    )
    return (
        table(spark, sf_dir, "conversations")
        .where("role = 'user'")
        .select(
            "conv_id", "turn",
            F.concat(F.lit("c"), (F.col("conv_id") % 3).cast("string")).alias("tenant_id"),
            F.concat(F.col("text"), tail).alias("message"),
        )
    )


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return (
        table(spark, sf_dir, "customer")
        .where("c_mktsegment <> 'MACHINERY'")
        .select(
            F.concat(F.lit("u"), key.cast("string")).alias("client_id"),
            F.concat(F.lit("k"), key.cast("string")).alias("api_key"),
            F.when(F.col("c_mktsegment") != "BUILDING", 2 + key % 4).alias("max_requests_per_day"),
        )
    )


def requests_of(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    user = F.col("user_id").cast("string")
    asks = F.col("event_type").isin("click", "purchase")
    over = (F.col("event_type") == "purchase") & (F.col("value") > 150)
    return events.select(
        F.col("event_id").alias("rid"),
        F.when(k != "7", F.concat(F.lit("u"), user)).alias("client_id"),
        F.when(k == "3", F.lit(None)).when(k == "4", "wrong").otherwise(
            F.concat(F.lit("k"), user)
        ).alias("x_api_key"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(asks, "POST").otherwise("GET").alias("method"),
        F.when(asks, "/answer").otherwise("/greet").alias("path"),
        F.when(F.col("event_type") == "error", 500).when(over, 429).otherwise(200).alias("status"),
        F.floor(F.col("value") * 10).cast("int").alias("latency_ms"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_of(table(spark, sf_dir, "events"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("client_id"),
        F.to_date(F.col("ts").cast("timestamp")).alias("day"),
        F.floor("value").alias("chat_prompt"),
        F.get_json_object("props", "$.k").cast("long").alias("chat_completion"),
        F.floor(F.col("value") / 4).alias("embedding"),
    )


