"""Queries by each tenant's own configuration: price wording, number of hits, prompts and medical terms."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..fixed_values import DEFAULT_TOP_K, MEDICAL_TERMS, SAFETY_LINE
from ..operators import compose as com
from ..operators import retrieval as ret
from ..operators.candidates import with_price_range
from ..operators.tenancy import layered_override_resolve, tenant_settings
from ..sources.patterns import medical_terms_of, price_wording_of
from . import bindings as b
from .bindings import duck, sql_price, sql_text
from .registry import query


def by_tenant(tenants, files):
    """Configuration documents ``(tenant_id, document)`` of the tenants in ``files``; the others have none."""
    document = F.lit(None).cast("string")
    for tenant, content in files.items():
        document = F.when(F.col("tenant_id") == tenant, json.dumps(content, ensure_ascii=False)).otherwise(document)
    return tenants.withColumn("document", document).where("document IS NOT NULL")


# t0 has no file, t4 one without terms.
PRICE_FILES = {
    "t1": {"price_patterns": {"en": {"under": ["item under"]}, "de": {"between": ["bis", "to"]}}},
    "t2": {"price_patterns": {"en": {"under": ["UNDER"], "between": [], "currency": ["€", "$"]}}},
    "t3": {"price_patterns": {"en": {"between": [" t.", " to "], "currency": ["€"]}}},
    "t4": {"price_patterns": {"en": {"under": [""], "between": []}}},
}
AMOUNT = r"([0-9]+(?:[.,][0-9]+)?)"


def amount(pattern: str) -> str:
    return f"cast(replace(nullif(regexp_extract(message, '{pattern}', 1), ''), ',', '.') AS DOUBLE)"


FIRST, SECOND = amount(rf"(?i){AMOUNT}\s*to"), amount(rf"(?i)[0-9]\s*to\s*{AMOUNT}")
UNDER, EURO = amount(rf"(?i)under\s*[€$]?\s*{AMOUNT}"), amount(rf"€\s*{AMOUNT}")
RANGES = {
    "t0": sql_price("message"),
    "t1": (f"CASE WHEN {SECOND} IS NOT NULL THEN least({FIRST}, {SECOND}) WHEN {UNDER} IS NOT NULL THEN 0.0::DOUBLE END",
           f"coalesce(greatest({FIRST}, {SECOND}), {UNDER})"),
    "t2": (f"CASE WHEN {UNDER} IS NOT NULL THEN 0.0::DOUBLE ELSE {EURO} END", f"coalesce({UNDER}, {EURO})"),
    "t3": (f"CASE WHEN {SECOND} IS NOT NULL THEN least({FIRST}, {SECOND}) ELSE {EURO} END", f"coalesce(greatest({FIRST}, {SECOND}), {EURO})"),
}


def case_of_tenant(side: int) -> str:
    return "CASE tenant_id " + " ".join(f"WHEN {sql_text(t)} THEN {r[side]}" for t, r in RANGES.items()) + " END"


@query(
    "tenant_price_terms",
    duck(f"SELECT tenant_id, msg_id, {case_of_tenant(0)} AS lo, {case_of_tenant(1)} AS hi FROM message_text"),
)
def tenant_price_terms(spark, d):
    """Price limits by the wording of each tenant's own file; tenants without a file have the shared wording."""
    tenants = b.catalog(spark, d).select("tenant_id").distinct()
    wording = price_wording_of(by_tenant(tenants, PRICE_FILES))
    return with_price_range(b.message_text(spark, d), wording).select("tenant_id", "msg_id", "lo", "hi")


# Profiles: every tenant extends 'base', some override keys of it.
SYSTEM, COMPOSE = "Be brief.", "{CARDS_JSON} for {USER_MESSAGE}{EXTRA_SAFETY}"
DEFAULTS = [("top_k", "3"), ("texts.system", SYSTEM), ("texts.compose", COMPOSE)]
OVERRIDES = [
    ("t1", "top_k", "1"),
    ("t2", "top_k", "5"),
    ("t3", "top_k", "many"),
    ("c1", "texts.system", "Speak Spanish."),
    ("c1", "texts.compose", "{{{USER_MESSAGE}}} {EXTRA_SAFETY} # {CARDS_JSON}"),
    ("c2", "texts.compose", "{USER_MESSAGE} without cards"),
]


def settings(spark, tenants, names):
    defaults = spark.createDataFrame([("base", *leaf) for leaf in DEFAULTS], "base string, key_path string, value string")
    overrides = spark.createDataFrame(OVERRIDES, "tenant_id string, key_path string, value string")
    extended = tenants.withColumn("base", F.lit("base"))
    leaves = layered_override_resolve(extended, defaults, overrides.join(tenants, "tenant_id", "left_semi"))
    return tenant_settings(tenants, leaves, names)


@query(
    "retrieve_tenant_k",
    duck(f"""
    SELECT msg_id, rank, row_id, round(sim, 6) AS sim FROM prefiltered
    WHERE rank <= CASE tenant_id WHEN 't1' THEN 1 WHEN 't2' THEN 5 WHEN 't3' THEN {DEFAULT_TOP_K} ELSE 3 END"""),
)
def retrieve_tenant_k(spark, d):
    """As many products as each tenant's profile asks for; what is no number means the default."""
    tenants = b.catalog(spark, d).select("tenant_id").distinct()
    asked = settings(spark, tenants, {"top_k": "top_k"}).withColumn("top_k", F.col("top_k").try_cast("int"))
    messages = b.messages(spark, d).join(asked, "tenant_id")
    hits = ret.retrieve_prefilter(messages, b.catalog_vec(spark, d), "top_k")
    return hits.select("msg_id", "rank", "row_id", F.round("sim", 6).alias("sim"))


MEDICAL_FILES = {"c1": {"medical_terms": {"en": ["spf", "a.b"], "es": ["SKIN"]}}, "c2": {"medical_terms": {"en": []}}}
SHARED_WORDS = "|".join(MEDICAL_TERMS)


@query(
    "tenant_prompts",
    duck(f"""
    SELECT conv_id, turn, CASE WHEN found AND tenant_id = 'c1' THEN 'Speak Spanish.' WHEN found AND tenant_id = 'c0' THEN {sql_text(SYSTEM)} END AS system,
           CASE WHEN NOT found THEN NULL
                WHEN tenant_id = 'c0' THEN concat('["', turn, '"] for ', message, CASE
                  WHEN regexp_matches(message, {sql_text('(?i)' + chr(92) + 'b(' + SHARED_WORDS + ')' + chr(92) + 'b')}) THEN {sql_text(SAFETY_LINE)} ELSE '' END)
                WHEN tenant_id = 'c1' THEN concat('{{', message, '}} ', CASE
                  WHEN regexp_matches(message, '(?i){chr(92)}b(spf|a[.]b|skin){chr(92)}b') THEN {sql_text(SAFETY_LINE)} ELSE '' END, ' # ["', turn, '"]') END AS prompt
    FROM (SELECT *, turn % 3 <> 1 AS found FROM chats)"""),
)
def tenant_prompts(spark, d):
    """Prompts by each tenant's own texts and medical terms; a template that lacks a placeholder makes no prompt."""
    chats = b.chats(spark, d).withColumn("msg_id", F.struct("conv_id", "turn"))
    tenants = chats.select("tenant_id").distinct()
    texts = settings(spark, tenants, {"system": "texts.system", "compose": "texts.compose"})
    texts = texts.join(medical_terms_of(by_tenant(tenants, MEDICAL_FILES)), "tenant_id", "left")
    shared = F.array(*map(F.lit, MEDICAL_TERMS))
    asked = chats.join(texts.withColumn("medical_terms", F.coalesce("medical_terms", shared)), "tenant_id")
    label = F.col("turn").cast("string")
    served = chats.where("turn % 3 <> 1").select("msg_id", F.to_json(F.array(label)).alias("cards_json"), F.array(label).alias("sources"))
    rows = com.prompt_rows(asked, served, F.col("system"), F.col("compose"), medical_terms=F.col("medical_terms"))
    return rows.select("conv_id", "turn", F.col("chat")[0]["content"].alias("system"), F.get("chat", F.lit(1))["content"].alias("prompt"))
