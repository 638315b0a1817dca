"""From ranked products to prompts and answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import APOLOGY, GREETING_FALLBACK, SAFETY_LINE
from ..functions.clock import time_of_day
from ..functions.keywords import mentions_medical
from ..functions.text import json_text, non_empty, render, strip
from .catalog import lean_card, product_card, source_label

COMPOSE_FIELDS = ("CARDS_JSON", "USER_MESSAGE", "EXTRA_SAFETY")
CHAT_TYPE = "array<struct<role:string,content:string>>"
ATTEMPTS = 2


def with_cards(ranked: DataFrame, catalog: DataFrame) -> DataFrame:
    """Ranked hits ``(tenant_id, msg_id, rank, row_id)`` with lean card and source label."""
    cards = catalog.select(
        "tenant_id",
        "row_id",
        lean_card(product_card(catalog)).alias("card"),
        source_label(F.col("product_name"), F.col("row_id")).alias("label"),
    )
    return ranked.join(cards, ["tenant_id", "row_id"])


def _in_rank_order(field: str) -> Column:
    entries = F.array_sort(F.collect_list(F.struct("rank", field)))
    return F.transform(entries, lambda e: e[field])


def cards_and_sources(ranked: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per message: its cards as one JSON array and the list of its sources.

    A message has at most k hits, so the lists are bounded by k.
    """
    return (
        with_cards(ranked, catalog)
        .groupBy("msg_id")
        .agg(_in_rank_order("card").alias("cards"), _in_rank_order("label").alias("sources"))
        .select("msg_id", json_text(F.col("cards")).alias("cards_json"), "sources")
    )


def text_column(text: Column | str) -> Column:
    return text if isinstance(text, Column) else F.lit(text)


def chat(system: Column | str, user: Column) -> Column:
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(turn("system", text_column(system)), turn("user", user))


def prompt_rows(
    messages: DataFrame,
    served: DataFrame,
    system_prompt: Column | str,
    compose_template: Column | str,
    few_shot: Column | str = "",
    medical_terms: Column | Sequence[str] | None = None,
) -> DataFrame:
    """Chat input per message; ``chat`` is null for a message nothing was found for.

    ``served`` is the output of ``cards_and_sources``. ``few_shot`` is the dialogue text that goes
    before the composed prompt. Texts and terms are the same for all, or columns of ``messages`` that hold those
    of each message's tenant; without a usable template ``chat`` is null, too.
    """
    text = F.col("message")
    medical = mentions_medical(text) if medical_terms is None else mentions_medical(text, medical_terms)
    values = {
        "CARDS_JSON": F.col("cards_json"),
        "USER_MESSAGE": text,
        "EXTRA_SAFETY": F.when(medical, SAFETY_LINE).otherwise(""),
    }
    composed = render(compose_template, values, required=COMPOSE_FIELDS)
    asked = F.concat(text_column(few_shot), composed)
    prompt = F.when(asked.isNotNull(), chat(system_prompt, asked))
    none = F.array().cast("array<string>")
    return (
        messages.join(served, "msg_id", "left")
        .withColumn("sources", F.coalesce("sources", none))
        .withColumn("chat", F.when(F.size("sources") > 0, prompt))
    )


def generate_answers(
    prompts: DataFrame, reply: Callable[[list[dict[str, str]]], str], attempts: int = ATTEMPTS
) -> DataFrame:
    """Call the user's ``reply`` function on each chat; failing twice gives an empty text."""
    schema = T.StructType([*prompts.schema.fields, T.StructField("text", T.StringType())])

    def one(turns) -> str | None:
        if turns is None:
            return None
        messages = [{"role": t["role"], "content": t["content"]} for t in turns]
        for _ in range(attempts):
            try:
                return (reply(messages) or "").strip()
            except Exception:  # noqa: BLE001, S112 - any failure of the plugged-in service
                continue
        return ""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(text=[one(turns) for turns in part["chat"]])

    return prompts.mapInPandas(batches, schema)


def answers_with_fallback(answered: DataFrame, no_match_text: Column | str) -> DataFrame:
    """The reply, an apology when there is none, or the no-match text without sources."""
    said = F.coalesce(non_empty(strip(F.col("text"))), F.lit(APOLOGY))
    return answered.withColumn(
        "answer", F.when(F.size("sources") == 0, text_column(no_match_text)).otherwise(said)
    )


def greeting_rows(visits: DataFrame, template: Column | str, system_prompt: Column | str) -> DataFrame:
    """Greeting chat and fallback text per visit ``(store_name, ts)``."""
    values = {"STORE_NAME": F.col("store_name"), "TIME_OF_DAY": time_of_day(F.col("ts"))}
    return visits.withColumns(
        {
            "chat": chat(system_prompt, render(template, values)),
            "fallback": render(GREETING_FALLBACK, values),
        }
    )


def tenant_leaks(results: DataFrame, catalog: DataFrame) -> DataFrame:
    """Result rows whose product is not in the catalog of the request's tenant."""
    keys = ["tenant_id", "row_id"]
    return results.join(catalog.select(*keys), keys, "left_anti")
