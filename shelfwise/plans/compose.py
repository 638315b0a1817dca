"""Prompt and answer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed_values import APOLOGY, GREETING_FALLBACK, SAFETY_LINE
from ..functions.clock import time_of_day
from ..functions.text import few_shot_text as few_shot
from ..functions.text import render
from ..operators import compose as com
from ..operators import retrieval as ret
from ..sources.patterns import valid_few_shot
from . import bindings as b
from .bindings import TOP_K, duck, sql_strip, sql_text, sql_unaccent
from .intent import turn_pairs
from .registry import query

SYSTEM = "Recommend only products from the cards."
COMPOSE = "Cards:\n{CARDS_JSON}\nCustomer: \"{USER_MESSAGE}\"\nRules: {{be brief}}\n{EXTRA_SAFETY}"
GREETING = "Welcome to {STORE_NAME}, this {TIME_OF_DAY}."
NO_MATCH = "Nothing in our catalog fits."


def ranked(spark, d):
    messages = b.messages(spark, d)
    hits = ret.retrieve_prefilter(messages, b.catalog_vec(spark, d), TOP_K)
    return hits.join(messages.select("msg_id", "tenant_id"), "msg_id")


def served(spark, d):
    return com.cards_and_sources(ranked(spark, d), b.catalog(spark, d))


CARD_JSON = """concat('{"product_name":"', c.product_name, '","brand":"', c.brand, '","category":"', c.category,
  '","benefits":"","key_ingredients":"","skin_types":"","price_eur":', printf('%.1f', c.price_eur),
  ',"short_description":"","contraindications":""}')"""
SERVED = (
    "served",
    f"""
    SELECT p.msg_id, concat('[', string_agg({CARD_JSON}, ',' ORDER BY p.rank), ']') AS cards_json,
           string_agg(c.product_name, '|' ORDER BY p.rank) AS sources
    FROM prefiltered p JOIN catalog c USING (tenant_id, row_id) GROUP BY 1""",
)


@query("cards_json", duck("SELECT msg_id, cards_json FROM served", SERVED))
def cards_json(spark, d):
    return served(spark, d).select("msg_id", "cards_json")


@query("sources_list", duck("SELECT msg_id, sources FROM served", SERVED))
def sources_list(spark, d):
    return served(spark, d).select("msg_id", F.array_join("sources", "|").alias("sources"))


# Odd messages mention a condition, so that both prompt forms occur.
SAID = "concat(m.message, CASE WHEN m.msg_id % 2 = 1 THEN ', I have rosacea' ELSE '' END)"


def said(spark, d):
    tail = F.when(F.col("msg_id") % 2 == 1, ", I have rosacea").otherwise("")
    return b.message_text(spark, d).withColumn("message", F.concat("message", tail))


@query(
    "prompt_rows",
    duck(f"""
    SELECT m.msg_id, CASE WHEN s.msg_id IS NOT NULL THEN 'system' END AS role,
           CASE WHEN s.msg_id IS NOT NULL THEN {sql_text(SYSTEM)} END AS system,
           CASE WHEN s.msg_id IS NOT NULL THEN
             concat('Cards:', chr(10), s.cards_json, chr(10), 'Customer: "', {SAID}, '"', chr(10),
                    'Rules: {{be brief}}', chr(10),
                    CASE WHEN m.msg_id % 2 = 1 THEN {sql_text(SAFETY_LINE)} ELSE '' END) END AS prompt
    FROM message_text m LEFT JOIN served s USING (msg_id)""", SERVED),
)
def prompt_rows(spark, d):
    """Messages that nothing was found for have no chat and stay, with nulls."""
    rows = com.prompt_rows(said(spark, d), served(spark, d), SYSTEM, COMPOSE)
    chat = F.col("chat")
    return rows.select(
        "msg_id",
        chat[0]["role"].alias("role"),
        chat[0]["content"].alias("system"),
        chat[1]["content"].alias("prompt"),
    )


def parrot(turns: list[dict[str, str]]) -> str:
    """A stand-in model: fails on medical prompts, else counts characters."""
    prompt = turns[-1]["content"]
    if "dermatologist" in prompt:
        raise RuntimeError("refused")
    return f"  {len(prompt)} characters read "


@query(
    "generate_answers",
    duck(f"""
    SELECT m.msg_id, CASE WHEN m.msg_id % 2 = 1 THEN '' ELSE
           concat(length(concat('Cards:', chr(10), s.cards_json, chr(10), 'Customer: "', {SAID}, '"', chr(10),
                  'Rules: {{be brief}}', chr(10))), ' characters read') END AS text
    FROM message_text m JOIN served s USING (msg_id)""", SERVED),
)
def generate_answers(spark, d):
    rows = com.prompt_rows(said(spark, d), served(spark, d), SYSTEM, COMPOSE)
    return com.generate_answers(rows.select("msg_id", "chat"), parrot).select("msg_id", "text")


OVERFETCHED = (
    "overfetched",
    """
    SELECT msg_id, product_name, row_number() OVER (PARTITION BY msg_id ORDER BY r) AS n
    FROM (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY sim DESC, row_id) AS r,
                 bool_or(ok) OVER (PARTITION BY msg_id) AS any_ok FROM sims)
    WHERE r <= 30 AND (ok OR NOT any_ok)""",
)


@query(
    "answers_with_fallback",
    duck(f"""
    SELECT m.msg_id, CASE WHEN s.msg_id IS NULL THEN {sql_text(NO_MATCH)}
                          WHEN m.msg_id % 2 = 1 THEN {sql_text(APOLOGY)}
                          ELSE concat('see ', s.sources) END AS answer,
           coalesce(s.sources, '') AS sources
    FROM message_text m
    LEFT JOIN (SELECT msg_id, string_agg(product_name, '|' ORDER BY n) AS sources
               FROM overfetched WHERE n <= {TOP_K} GROUP BY 1) s USING (msg_id)""", OVERFETCHED),
)
def answers_with_fallback(spark, d):
    """Replies by the overfetching retrieval, which can come back empty-handed."""
    messages = b.messages(spark, d)
    hits = ret.retrieve_overfetch(messages, b.catalog_vec(spark, d), TOP_K)
    tagged = hits.join(messages.select("msg_id", "tenant_id"), "msg_id")
    found = com.cards_and_sources(tagged, b.catalog(spark, d)).select("msg_id", "sources")
    rows = b.message_text(spark, d).join(found, "msg_id", "left").withColumn(
        "sources", F.coalesce("sources", F.array().cast("array<string>"))
    )
    text = F.when(F.col("msg_id") % 2 == 1, "  ").otherwise(
        F.concat(F.lit("see "), F.array_join("sources", "|"))
    )
    out = com.answers_with_fallback(rows.withColumn("text", text), NO_MATCH)
    return out.select("msg_id", "answer", F.array_join("sources", "|").alias("sources"))


TIME = "CASE WHEN hour(ts) BETWEEN 5 AND 11 THEN 'morning' WHEN hour(ts) BETWEEN 12 AND 17 THEN 'afternoon' WHEN hour(ts) BETWEEN 18 AND 22 THEN 'evening' ELSE 'late' END"


@query("time_of_day", f"SELECT event_id, {TIME} AS time_of_day FROM events")
def time_of_day_query(spark, d):
    ts = F.col("ts").cast("timestamp")
    return b.table(spark, d, "events").select("event_id", time_of_day(ts).alias("time_of_day"))


def fallback_sql() -> str:
    text = sql_text(GREETING_FALLBACK)
    return f"replace(replace({text}, '{{TIME_OF_DAY}}', t), '{{STORE_NAME}}', store)"


@query(
    "render_template",
    f"""
    SELECT id, kind, text FROM (
      SELECT event_id AS id, 'greeting' AS kind, concat('Welcome to ', store, ', this ', t, '.') AS text
      FROM (SELECT *, concat('Store {{X}} ', user_id) AS store, {TIME} AS t FROM events)
      UNION ALL
      SELECT event_id, 'fallback', {fallback_sql()}
      FROM (SELECT *, concat('Store {{X}} ', user_id) AS store, {TIME} AS t FROM events)
      UNION ALL
      SELECT conv_id * 1000 + turn, 'compose', concat('{{', text, '}}: ', role, ' {{EXTRA_SAFETY}}') FROM conversations)""",
)
def render_template(spark, d):
    visits = b.table(spark, d, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("Store {X} "), F.col("user_id").cast("string")).alias("store_name"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    greeted = com.greeting_rows(visits, GREETING, SYSTEM)
    values = {"TEXT": F.col("text"), "ROLE": F.concat("role", F.lit(" {EXTRA_SAFETY}"))}
    composed = b.table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.lit("compose").alias("kind"),
        render("{{{TEXT}}}: {ROLE}", values).alias("text"),
    )
    return (
        greeted.select("id", F.lit("greeting").alias("kind"), F.col("chat")[1]["content"].alias("text"))
        .union(greeted.select("id", F.lit("fallback").alias("kind"), F.col("fallback").alias("text")))
        .union(composed)
    )


@query(
    "few_shot_text",
    f"""
    SELECT conv_id, string_agg(concat('User: ', "user", chr(10), 'Assistant: ', {sql_strip('assistant')}, chr(10)),
                               chr(10) ORDER BY turn) || chr(10) AS examples
    FROM (SELECT u.conv_id, u.turn, u.text AS "user", CASE WHEN a.turn % 5 = 1 THEN '  ' ELSE a.text END AS assistant
          FROM conversations u JOIN conversations a
            ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')
    WHERE length({sql_strip(sql_unaccent('"user"'))}) > 0 AND length({sql_strip('assistant')}) > 0
    GROUP BY 1""",
)
def few_shot_text(spark, d):
    """Each conversation's turn pairs as one example file."""
    pairs = F.sort_array(F.collect_list(F.struct("turn", "user", "assistant")))
    files = valid_few_shot(turn_pairs(spark, d)).groupBy("conv_id").agg(pairs.alias("pairs"))
    return files.select("conv_id", few_shot(F.col("pairs")).alias("examples"))


@query(
    "tenant_leak_check",
    duck("""
    SELECT msg_id, row_id, tenant_id FROM (
      SELECT msg_id, row_id, CASE WHEN rank = 1 AND msg_id % 3 = 1
               THEN concat('t', (msg_id + 1) % 5) ELSE tenant_id END AS tenant_id FROM prefiltered) p
    WHERE NOT EXISTS (SELECT 1 FROM catalog c WHERE c.tenant_id = p.tenant_id AND c.row_id = p.row_id)"""),
)
def tenant_leak_check(spark, d):
    """Retrieval results with some first hits handed to another tenant: exactly those are found."""
    other = F.concat(F.lit("t"), ((F.col("msg_id") + 1) % 5).cast("string"))
    swapped = (F.col("rank") == 1) & (F.col("msg_id") % 3 == 1)
    results = ranked(spark, d).withColumn(
        "tenant_id", F.when(swapped, other).otherwise(F.col("tenant_id"))
    )
    leaks = com.tenant_leaks(results, b.catalog(spark, d))
    return leaks.select("msg_id", "row_id", "tenant_id")
