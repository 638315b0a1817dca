"""Evaluation queries: every message is a case with known expectations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compose as com
from ..operators import evaluation as ev
from ..session import materialized, shared_dir
from ..sources import logs
from . import bindings as b
from .bindings import duck
from .compose import ranked
from .registry import query

# Expected: the product behind the message and its size twin; promotions should find nothing.
CASES = (
    "cases",
    """
    SELECT p_partkey AS case_id, CASE WHEN p_type = 'PROMO' THEN [] ELSE [p_name, concat(p_name, ' XL')] END AS expected,
           p_type = 'PROMO' AS expect_no_match, round(p_size * CAST(7.25 AS DOUBLE), 1) AS retrieve_ms,
           round(p_retailprice * 3.5, 1) AS answer_ms, coalesce(r.names, []) AS retrieved
    FROM part LEFT JOIN (
      SELECT msg_id, list(product_name ORDER BY rank) AS names
      FROM prefiltered JOIN catalog USING (tenant_id, row_id) GROUP BY 1) r ON r.msg_id = p_partkey""",
)
SCORED = (
    "scored",
    """
    SELECT *, CASE WHEN len(expected) > 0 THEN CASE WHEN len(retrieved) > 0
                THEN round(len(list_distinct(list_intersect(retrieved, expected))) / len(retrieved), 3) ELSE 0.0 END END AS precision_at_k,
           CASE WHEN len(expected) > 0 THEN round(len(list_distinct(list_intersect(retrieved, expected))) / len(expected), 3) END AS recall,
           CASE WHEN expect_no_match THEN len(retrieved) = 0 END AS correctly_rejected
    FROM cases""",
)


def cases(spark, d):
    names = com.cards_and_sources(ranked(spark, d), b.catalog(spark, d)).select(
        F.col("msg_id").alias("case_id"), F.col("sources").alias("retrieved_products")
    )
    none = F.array().cast("array<string>")
    promo = F.col("p_type") == "PROMO"
    made = b.table(spark, d, "part").select(
        F.col("p_partkey").alias("case_id"),
        F.when(promo, none).otherwise(F.array("p_name", F.concat("p_name", F.lit(" XL")))).alias("expected_products"),
        promo.alias("expect_no_match"),
        F.round(F.col("p_size") * 7.25, 1).alias("retrieve_ms"),
        F.round(F.col("p_retailprice") * 3.5, 1).alias("answer_ms"),
    )
    joined = made.join(names, "case_id", "left")
    got = F.coalesce("retrieved_products", none)
    return joined.withColumns({"retrieved_products": got, "sources": got})


@query(
    "precision_recall_at_k",
    duck("SELECT case_id, precision_at_k, recall FROM scored", CASES, SCORED),
)
def precision_recall_at_k(spark, d):
    return ev.score_cases(cases(spark, d)).select("case_id", "precision_at_k", "recall")


@query(
    "expected_hits",
    duck("SELECT case_id, unnest(list_distinct(list_intersect(retrieved, expected))) AS hit FROM cases", CASES),
)
def expected_hits(spark, d):
    hits = ev.expected_hits(F.col("retrieved_products"), F.col("expected_products"))
    return cases(spark, d).select("case_id", F.explode(hits).alias("hit"))


@query(
    "no_match_rejection",
    duck("""
    SELECT count(*) FILTER (WHERE expect_no_match) AS cases, count(*) FILTER (WHERE correctly_rejected) AS correctly_rejected
    FROM scored""", CASES, SCORED),
)
def no_match_rejection(spark, d):
    return ev.no_match_rejection(cases(spark, d))


def percentile_sql(column: str, p: int) -> str:
    return f"""(SELECT {column} FROM (SELECT {column}, row_number() OVER (ORDER BY {column}) AS r, count(*) OVER () AS n FROM cases)
                WHERE r = round_even({p} / 100.0 * (n - 1), 0) + 1)"""


SUMMARY_SQL = f"""
    SELECT count(*) AS cases_total, round(avg(precision_at_k), 3) AS mean_precision_at_k, round(avg(recall), 3) AS mean_recall,
           count(recall) AS cases_scored, count(*) FILTER (WHERE expect_no_match) AS no_match_cases,
           count(*) FILTER (WHERE correctly_rejected) AS correctly_rejected,
           count(*) FILTER (WHERE len(retrieved) > 4) AS cases_with_possible_hallucination,
           CAST(sum(len(expected)) AS BIGINT) AS embedding_tokens,
           CAST(sum(coalesce(length(array_to_string(retrieved, '')), 0)) AS BIGINT) AS chat_prompt_tokens,
           CAST(sum(len(retrieved) * 3) AS BIGINT) AS chat_completion_tokens,
           round(CAST(sum(len(expected)) / 1000000.0 * 0.02 + sum(coalesce(length(array_to_string(retrieved, '')), 0)) / 1000000.0 * 0.15
             + sum(len(retrieved) * 3) / 1000000.0 * 0.60 AS DOUBLE), 5) AS estimated_cost_usd,
           {percentile_sql('retrieve_ms', 50)} AS retrieve_p50, {percentile_sql('retrieve_ms', 95)} AS retrieve_p95,
           {percentile_sql('answer_ms', 50)} AS answer_p50, {percentile_sql('answer_ms', 95)} AS answer_p95
    FROM scored"""


def results(spark, d):
    scored = ev.reject_cases(ev.score_cases(cases(spark, d)))
    said = F.array_join("sources", "")
    # Counts, percentiles and the report all read them; retrieval runs once.
    made = scored.withColumns(
        {
            "n_hallucinations": F.greatest(F.size("sources") - 4, F.lit(0)),
            "embedding": F.size("expected_products"),
            "chat_prompt": F.length(said),
            "chat_completion": F.size("sources") * 3,
        }
    )
    return materialized(made, "eval-results")


@query("eval_summary", duck(SUMMARY_SQL, CASES, SCORED))
def eval_summary(spark, d):
    return ev.eval_summary(results(spark, d))


@query(
    "write_eval_report",
    duck(f"SELECT cases_total, mean_recall, 'all' AS tenant_id, cases_total AS cases_written FROM ({SUMMARY_SQL})", CASES, SCORED),
)
def write_eval_report(spark, d):
    path = shared_dir(spark, "eval-report")
    rows = results(spark, d)
    logs.write_eval_report(ev.eval_summary(rows), rows, path, tenant_id="all", top_k=b.TOP_K)
    head = spark.read.json(f"{path}/summary").select("cases_total", "mean_recall", "tenant_id")
    written = spark.read.json(f"{path}/cases").agg(F.count("case_id").alias("cases_written"))
    return head.select("*", F.lit(1).alias("one")).join(written.select("*", F.lit(1).alias("one")), "one").drop("one")


# Answers name their own product, a neighbour's and, in part, a third; only the first is cited.
ANSWERS = (
    "answers",
    """
    SELECT p.p_partkey AS msg_id, concat('t', p.p_partkey % 5) AS tenant_id,
           concat('Take the ', upper(p.p_name), ' or the ', coalesce(n.p_name, ''), '. Not ', coalesce(substr(n.p_brand, 1, 4), ''), p.p_type) AS answer,
           [p.p_name] AS sources
    FROM part p LEFT JOIN part n ON n.p_partkey = p.p_partkey + 1""",
)


def answers(spark, d):
    part = b.table(spark, d, "part")
    near = part.select(
        (F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("n_name"), F.col("p_brand").alias("n_brand")
    )
    text = F.concat(
        F.lit("Take the "), F.upper("p_name"), F.lit(" or the "), F.coalesce("n_name", F.lit("")), F.lit(". Not "),
        F.coalesce(F.substring("n_brand", 1, 4), F.lit("")), "p_type",
    )
    return part.join(near, "p_partkey", "left").select(
        F.col("p_partkey").alias("msg_id"),
        F.concat(F.lit("t"), (F.col("p_partkey") % 5).cast("string")).alias("tenant_id"),
        text.alias("answer"),
        F.array("p_name").alias("sources"),
    )


@query(
    "grounding_violations",
    duck("""
    SELECT a.tenant_id, a.msg_id, c.product_name, n_rows
    FROM answers a JOIN (SELECT tenant_id, product_name, count(*) AS n_rows FROM catalog GROUP BY 1, 2) c
      ON c.tenant_id = a.tenant_id AND contains(lower(a.answer), lower(c.product_name))
    WHERE NOT list_contains(list_transform(a.sources, lambda s: lower(s)), lower(c.product_name))""", ANSWERS),
)
def grounding_violations(spark, d):
    return ev.grounding_violations(answers(spark, d), b.catalog(spark, d))
