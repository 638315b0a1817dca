"""Message intent queries: price, hints, skin type, medical flag, pattern tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..fixed_values import CATEGORY_PATTERNS, MEDICAL_TERMS, SKIN_TYPES
from ..functions import keywords as kw
from ..functions import price as pr
from ..operators.keywords import with_names
from ..sources import patterns as pat
from . import bindings as b
from .bindings import (
    duck,
    sql_between,
    sql_currency,
    sql_price,
    sql_strip,
    sql_text,
    sql_unaccent,
    sql_under,
)
from .registry import query

# Messages with prices from the catalog, and users' own words.
TEXTS_SQL = """(SELECT 'm' AS kind, msg_id AS id, message FROM message_text
                UNION ALL SELECT 'c', conv_id * 1000 + turn, message FROM chats
                UNION ALL SELECT 'd', doc_id, text FROM documents)"""


def texts(spark, d):
    made = b.message_text(spark, d).select(F.lit("m").alias("kind"), F.col("msg_id").alias("id"), "message")
    said = b.chats(spark, d).select(
        F.lit("c").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "message"
    )
    docs = b.table(spark, d, "documents").select(
        F.lit("d").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("message")
    )
    return made.union(said).union(docs)


def price_query(name, lo, hi, parse):
    sql = duck(f"SELECT kind, id, CASE WHEN {hi} IS NOT NULL THEN {lo} END AS lo, {hi} AS hi FROM {TEXTS_SQL}")

    @query(name, sql)
    def run(spark, d):
        parsed = texts(spark, d).select("kind", "id", parse(F.col("message")).alias("p"))
        return parsed.select("kind", "id", F.col("p.lo").alias("lo"), F.col("p.hi").alias("hi"))

    return run


price_query("parse_price_between", *sql_between("message"), pr.parse_between)
price_query("parse_price_under", "CAST(0 AS DOUBLE)", sql_under("message"), pr.parse_under)
price_query("parse_price_currency", sql_currency("message"), sql_currency("message"), pr.parse_currency)
price_query("parse_price_range", *sql_price("message"), pr.parse_price_range)


def hit_sql(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {sql_text(w)})" for w in words) + ")"


LOW = f"lower({sql_unaccent('message')})"
HINTS = ", ".join(f"CASE WHEN {hit_sql('low', w)} THEN {sql_text(n)} END" for n, w in CATEGORY_PATTERNS.items())
SKIN = ", ".join(f"CASE WHEN {hit_sql('low', w)} THEN {sql_text(n)} END" for n, w in SKIN_TYPES.items())


@query(
    "category_hints",
    duck(f"SELECT kind, id, concat_ws(',', {HINTS}) AS hints FROM (SELECT *, {LOW} AS low FROM {TEXTS_SQL})"),
)
def category_hints(spark, d):
    hints = F.array_join(kw.category_hints(F.col("message")), ",")
    return texts(spark, d).select("kind", "id", hints.alias("hints"))


@query(
    "skin_type",
    duck(f"SELECT kind, id, coalesce({SKIN}) AS skin_type FROM (SELECT *, {LOW} AS low FROM {TEXTS_SQL})"),
)
def skin_type(spark, d):
    return texts(spark, d).select("kind", "id", kw.skin_type(F.col("message")).alias("skin_type"))


@query(
    "flag_medical_terms",
    duck(f"""
    SELECT kind, id, regexp_matches(message,
      {sql_text('(?i)' + chr(92) + 'b(' + '|'.join(re.escape(t) for t in MEDICAL_TERMS) + ')' + chr(92) + 'b')}) AS medical
    FROM {TEXTS_SQL}"""),
)
def flag_medical_terms(spark, d):
    return texts(spark, d).select("kind", "id", kw.mentions_medical(F.col("message")).alias("medical"))


@query(
    "first_pattern_match",
    duck("""
    SELECT m.msg_id, arg_min(p.canonical, p.ordinal) AS first_match
    FROM message_text m LEFT JOIN patterns p
      ON p.tenant_id = m.tenant_id AND contains(m.message, p.keyword) GROUP BY 1"""),
)
def first_pattern_match(spark, d):
    """Each tenant's own patterns; a message takes the first name with a hit."""
    hinted = with_names(b.message_text(spark, d), b.patterns(spark, d))
    return hinted.select("msg_id", F.try_element_at("hints", F.lit(1)).alias("first_match"))


# One pattern document per brand: its product types, each with the product names as keywords.
DOCUMENTS = (
    "documents_json",
    """
    SELECT p_brand AS tenant_id, p_type AS canonical, list(DISTINCT p_name ORDER BY p_name) AS words,
           row_number() OVER (PARTITION BY p_brand ORDER BY p_type) - 1 AS ordinal
    FROM part GROUP BY p_brand, p_type""",
)


def pattern_documents(spark, d):
    types = b.table(spark, d, "part").groupBy("p_brand", "p_type").agg(
        F.sort_array(F.collect_set("p_name")).alias("words")
    )
    entry = F.sort_array(F.collect_list(F.struct("p_type", "words")))
    section = F.map_from_entries(
        F.transform(entry, lambda e: F.struct(e["p_type"].alias("key"), e["words"].alias("value")))
    )
    body = F.struct(
        section.alias("categories"),
        F.create_map(F.lit("ignored"), F.array(F.lit("never read"))).alias("other"),
    )
    return types.groupBy(F.col("p_brand").alias("tenant_id")).agg(F.to_json(body).alias("document"))


@query(
    "explode_patterns",
    duck("""
    SELECT tenant_id, ordinal, canonical, CAST(unnest(range(0, len(words))) AS BIGINT) AS position,
           unnest(words) AS keyword FROM documents_json""", DOCUMENTS),
)
def explode_patterns(spark, d):
    rows = pat.explode_patterns(pattern_documents(spark, d))
    return rows.withColumns({c: F.col(c).cast("long") for c in ("ordinal", "position")})


@query(
    "union_price_terms",
    """
    SELECT lang AS tenant_id, kind, string_agg(term, ',' ORDER BY ordinal, term) AS terms
    FROM (SELECT DISTINCT lang, source AS kind, length(source) AS ordinal,
                 concat(source, '-', CAST(n_chars % 50 AS VARCHAR)) AS term FROM documents)
    GROUP BY 1, 2""",
)
def union_price_terms(spark, d):
    """Documents as term files: one language per tenant, one kind per source."""
    rows = b.table(spark, d, "documents").select(
        F.col("lang").alias("tenant_id"),
        F.col("source").alias("kind"),
        F.length("source").alias("ordinal"),
        F.concat("source", F.lit("-"), (F.col("n_chars") % 50).cast("string")).alias("term"),
    ).distinct()
    out = pat.union_price_terms(rows)
    return out.select("tenant_id", "kind", F.array_join("terms", ",").alias("terms"))


@query(
    "valid_few_shot",
    f"""
    SELECT conv_id, turn, md5("user") AS user_md5, md5(assistant) AS assistant_md5 FROM (
      SELECT u.conv_id, u.turn, u.text AS "user",
             CASE WHEN a.turn % 5 = 1 THEN '  ' ELSE a.text END AS assistant
      FROM conversations u JOIN conversations a
        ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
      WHERE u.role = 'user')
    WHERE length({sql_strip(sql_unaccent('"user"'))}) > 0 AND length({sql_strip('assistant')}) > 0""",
)
def valid_few_shot(spark, d):
    return pat.valid_few_shot(turn_pairs(spark, d)).select(
        "conv_id", "turn", F.md5("user").alias("user_md5"), F.md5("assistant").alias("assistant_md5")
    )


def turn_pairs(spark, d):
    """A user turn with the assistant turn that follows it; some replies are blank."""
    turns = b.table(spark, d, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("user"))
    said = turns.where("role = 'assistant'").select(
        "conv_id",
        (F.col("turn") - 1).alias("turn"),
        F.when(F.col("turn") % 5 == 1, "  ").otherwise(F.col("text")).alias("assistant"),
    )
    return asked.join(said, ["conv_id", "turn"])
