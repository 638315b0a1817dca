"""What each tenant configures for itself, against the functions that take one configuration for all."""

import json
import re

import pytest
from pyspark.sql import functions as F

from shelfwise.fixed_values import SAFETY_LINE
from shelfwise.functions import text as tx
from shelfwise.functions.keywords import mentions_medical
from shelfwise.functions.price import DEFAULT_TERMS, PriceTerms, parse_price_range
from shelfwise.operators import compose as com
from shelfwise.operators import retrieval as ret
from shelfwise.operators.candidates import with_price_range
from shelfwise.sources import patterns as pat

OWN = {
    "a": PriceTerms(["under", "c++ <", r"\Q\E"], ["to", "."], ["€", "$"]),
    "b": PriceTerms([], ["-"], []),
    "c": PriceTerms([], [], []),
    "d": PriceTerms(["bis"], [], ["(eur)"]),
}
TEXTS = [
    "under 30", "under € 30", r"\q\e 7", "C++ < 12,5", "5 to 3", "5.6 to 3", "1 - 2", "9 (EUR)", "bis (eur) 9", "€4", "4 $", "none", "", None, "bis 9 to 2", "under x",
]


def test_price_wording_by_tenant(spark):
    rows = [(t, i, x) for t in [*OWN, "other", None] for i, x in enumerate(TEXTS)]
    messages = spark.createDataFrame(rows, "tenant_id string, msg_id int, message string")
    documents = [(t, json.dumps({"p": {"x": {"under": w.under, "between": w.between[:1]}, "y": {"between": w.between[1:], "currency": w.currency}}})) for t, w in OWN.items()]
    documents += [("broken", None), ("broken", "[1]")]
    wording = pat.price_wording_of(spark.createDataFrame(documents, "tenant_id string, document string"))
    assert {r["tenant_id"]: (r["under"], r["between"], r["currency"]) for r in wording.collect()} == {t: (w.under, w.between, w.currency) for t, w in OWN.items()}
    got = {(r["tenant_id"], r["msg_id"]): (r["lo"], r["hi"]) for r in with_price_range(messages, wording).collect()}
    assert len(got) == len(rows)
    for tenant in [*OWN, "other", None]:
        one = messages.where(F.col("tenant_id").eqNullSafe(F.lit(tenant)))
        parsed = one.select("msg_id", parse_price_range(F.col("message"), OWN.get(tenant, DEFAULT_TERMS)).alias("p"))
        assert {r["msg_id"]: tuple(r["p"] or (None, None)) for r in parsed.collect()} == {i: got[tenant, i] for i in range(len(TEXTS))}
    assert got["a", 2] == (0.0, 7.0) and got["b", 0] == (None, None)


def test_templates_by_row(spark):
    templates = ["{A} and {B}", "{{{A}}} {B}{", "}}{A}{B}", "", "{A}", "{A}{B}{C}", "a } b {A}\n{B}", "{A} {b-} {B}"]
    rows = spark.createDataFrame([(t, "{B}", "{{x}}") for t in [*templates, None]], "t string, a string, b string")
    values = {"A": F.col("a"), "B": F.col("b")}
    loose = {r[0]: r[1] for r in rows.select("t", tx.render(F.col("t"), values)).collect()}
    strict = {r[0]: r[1] for r in rows.select("t", tx.render(F.col("t"), values, required=["A", "B"])).collect()}
    for t in templates:
        if "{C}" in t:
            assert loose[t] is None and strict[t] is None
            continue
        braces = {"{{": "{", "}}": "}", "{A}": "{B}", "{B}": "{{x}}"}
        want = re.sub(r"\{\{|\}\}|\{[AB]\}", lambda m: braces[m[0]], t)
        assert loose[t] == want
        assert strict[t] == (want if "{A}" in t and "{B}" in t else None)
    assert loose[None] is None


def test_medical_terms_by_row(spark):
    lists = [["eczema", "severe acne"], ["c++", ""], [], None, [""]]
    texts = ["ECZEMA.", "eczemas", "a severe acne", "c++", "xc++y", "", None]
    rows = spark.createDataFrame([(i, k, t) for i, t in enumerate(lists) for k, _ in enumerate(texts)], "i int, k int, terms array<string>")
    table = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {(r["i"], r["k"]): r["m"] for r in rows.join(table, "k").withColumn("m", mentions_medical(F.col("text"), F.col("terms"))).collect()}
    for i, terms in enumerate(lists):
        one = table.select("k", mentions_medical(F.col("text"), terms or []).alias("m"))
        assert {r["k"]: r["m"] for r in one.collect()} == {k: got[i, k] for k in range(len(texts))}


@pytest.mark.parametrize("retrieve", [ret.cosine_topk, ret.retrieve_prefilter, ret.retrieve_overfetch])
def test_own_k(spark, retrieve):
    wanted = {"a": 1, "b": 9, "c": 0, "d": None}
    products = spark.createDataFrame(
        [(t, i, "xyz"[i % 3], float(i), [float(i % 7), float(i % 5), 1.0]) for t in wanted for i in range(60)],
        "tenant_id string, row_id long, category string, price_eur double, vec array<float>",
    )
    messages = spark.createDataFrame(
        [(t, 10 * n + j, None if j else 5.0, None if j else 40.0, ["x"] if j == 2 else [], [1.0, float(j), -1.0], k) for n, (t, k) in enumerate(wanted.items()) for j in range(3)],
        "tenant_id string, msg_id long, lo double, hi double, hints array<string>, vec array<float>, own int",
    )
    got = sorted((r["msg_id"], r["rank"], r["row_id"], r["sim"]) for r in retrieve(messages, products, "own").collect())
    want = []
    for t, k in wanted.items():
        if k != 0:
            own = [F.col("tenant_id") == t]
            want += [(r["msg_id"], r["rank"], r["row_id"], r["sim"]) for r in retrieve(messages.where(*own), products, k or ret.DEFAULT_TOP_K).collect()]
    assert got == sorted(want) and got
    assert retrieve(messages.limit(0), products, "own").count() == 0


def test_texts_by_tenant(spark):
    rows = [(1, "hi eczema", "S1", "{CARDS_JSON}|{USER_MESSAGE}|{EXTRA_SAFETY}", "no1"), (2, "hi", None, "{USER_MESSAGE}", "no2"), (3, "hi", "S3", "{USER_MESSAGE}", "no3")]
    messages = spark.createDataFrame(rows, "msg_id long, message string, sys string, tpl string, none string")
    served = spark.createDataFrame([(1, "[1]", ["p"]), (2, "[2]", ["q"])], "msg_id long, cards_json string, sources array<string>")
    prompts = com.prompt_rows(messages, served, F.col("sys"), F.col("tpl"), medical_terms=F.array(F.lit("eczema")))
    chats = {r["msg_id"]: r["chat"] for r in prompts.collect()}
    assert chats[2] is None and chats[3] is None
    assert [t["content"] for t in chats[1]] == ["S1", "[1]|hi eczema|" + SAFETY_LINE]
    said = com.generate_answers(prompts, lambda turns: "reply")
    out = {r["msg_id"]: r["answer"] for r in com.answers_with_fallback(said, F.col("none")).collect()}
    assert out == {1: "reply", 2: com.APOLOGY, 3: "no3"}
