import json

import numpy as np

from shelfwise.fixed_values import APOLOGY, SAFETY_LINE
from shelfwise.operators import compose as com
from shelfwise.operators import evaluation as ev
from shelfwise.operators import quality as q


def test_scores(spark):
    rows = [
        ("a", ["x", "x", "y"], ["x", "z"], False, ["x"]), ("b", [], ["x"], False, []), ("c", ["x"], [], True, ["x"]), ("d", ["x"], [], True, []),
    ]
    cases = spark.createDataFrame(rows, "case_id string, retrieved_products array<string>, expected_products array<string>, expect_no_match boolean, sources array<string>")
    got = {r["case_id"]: (r["precision_at_k"], r["recall"]) for r in ev.score_cases(cases).collect()}
    assert got == {"a": (0.333, 0.5), "b": (0.0, 0.0), "c": (None, None), "d": (None, None)}
    assert tuple(ev.no_match_rejection(cases).first()) == (2, 1)


def test_summary(spark):
    schema = "precision_at_k double, recall double, expect_no_match boolean, correctly_rejected boolean, n_hallucinations int, retrieve_ms double, answer_ms double, embedding int, chat_prompt int, chat_completion int"
    rows = [(0.5, 1.0, False, None, 0, 10.0, 1.0, 100, 7000, 2000), (0.0, 0.0, False, None, 2, 20.0, 2.0, 164, 868, 416), (None, None, True, True, 0, 30.0, 3.0, 0, 0, 0)]
    out = ev.eval_summary(spark.createDataFrame(rows, schema)).first().asDict()
    assert (out["mean_precision_at_k"], out["mean_recall"], out["cases_scored"], out["cases_total"]) == (0.25, 0.5, 2, 3)
    assert (out["no_match_cases"], out["correctly_rejected"], out["cases_with_possible_hallucination"]) == (1, 1, 1)
    assert (out["retrieve_p50"], out["answer_p95"]) == (20.0, 3.0)
    assert (out["embedding_tokens"], out["chat_prompt_tokens"], out["chat_completion_tokens"]) == (264, 7868, 2416)
    assert out["estimated_cost_usd"] == round((264 * 0.02 + 7868 * 0.15 + 2416 * 0.6) / 1e6, 5)
    empty = ev.eval_summary(spark.createDataFrame([], schema)).first().asDict()
    assert empty["mean_recall"] is None and empty["retrieve_p50"] == 0.0 and empty["cases_total"] == 0 and empty["estimated_cost_usd"] == 0.0


def test_grounding_against_brute_force(spark):
    rng = np.random.default_rng(3)
    syllables = ["sun", "cream", "gel", "Sun ", "vital c ", "a", "serum 30ml", "éa", ""]
    name = lambda n: "".join(rng.choice(syllables, n))
    catalog = [("hot" if i % 3 else f"t{i % 2}", name(int(rng.integers(0, 5)))) for i in range(120)] + [("hot", None), ("quiet", "x")]
    answers = [("hot" if i % 3 else f"t{i % 2}", i, name(12).upper() if i % 2 else name(9), [name(2), name(1)]) for i in range(40)] + [("hot", 99, "", [])]
    c = spark.createDataFrame(catalog, "tenant_id string, product_name string")
    a = spark.createDataFrame(answers, "tenant_id string, msg_id long, answer string, sources array<string>")
    got = {(r["msg_id"], r["product_name"]): r["n_rows"] for r in ev.grounding_violations(a, c).collect()}
    expected = {}
    for tenant, i, text, sources in answers:
        for t, n in catalog:
            if t == tenant and n is not None and n.lower() in text.lower() and n.lower() not in {s.lower() for s in sources}:
                expected[i, n] = expected.get((i, n), 0) + 1
    assert got == expected and len(expected) > 100


def test_prompts_and_answers(spark):
    products = spark.createDataFrame([("t", 0, "", "B"), ("t", 1, "Two", "")], "tenant_id string, row_id long, product_name string, benefits string")
    ranked = spark.createDataFrame([("t", 1, 2, 0), ("t", 1, 1, 1)], "tenant_id string, msg_id long, rank int, row_id long")
    served = com.cards_and_sources(ranked, products)
    row = served.first()
    assert row["sources"] == ["Two", "row 0"]
    assert [c["product_name"] for c in json.loads(row["cards_json"])] == ["Two", ""] and json.loads(row["cards_json"])[0]["price_eur"] is None
    messages = spark.createDataFrame([(1, "eczema {EXTRA_SAFETY}"), (2, "hi")], "msg_id long, message string")
    template = "{CARDS_JSON}|{USER_MESSAGE}|{EXTRA_SAFETY}"
    prompts = com.prompt_rows(messages, served, "sys", template, few_shot="shots ")
    out = {r["msg_id"]: r for r in com.answers_with_fallback(com.generate_answers(prompts, lambda m: " " + m[-1]["content"][:5]), "nothing").collect()}
    assert out[1]["chat"][1]["content"].startswith("shots [{") and out[1]["chat"][1]["content"].endswith("|eczema {EXTRA_SAFETY}|" + SAFETY_LINE)
    assert out[1]["answer"] == "shots" and out[2]["answer"] == "nothing" and out[2]["sources"] == []

    def fail(_):
        raise RuntimeError

    tried = com.answers_with_fallback(com.generate_answers(prompts, fail), "nothing").where("msg_id = 1").first()
    assert tried["answer"] == APOLOGY and tried["sources"] == ["Two", "row 0"]


def test_reply_is_retried_once(spark, tmp_path):
    marker = tmp_path / "calls"

    def flaky(_):
        with marker.open("a") as f:
            f.write("x")
        if len(marker.read_text()) % 2:
            raise RuntimeError
        return "fine"

    chats = spark.createDataFrame([([{"role": "user", "content": "q"}],)], "chat array<struct<role:string,content:string>>")
    assert com.generate_answers(chats.coalesce(1), flaky).first()["text"] == "fine"


def test_quality_report(spark):
    rows = [("t", i, "same" if i < 12 else f"p{i}", "0,00" if i == 13 else (None if i == 14 else "9,5"), "odd" if i == 1 else "gel", "long enough text" if i else None) for i in range(15)]
    df = spark.createDataFrame(rows, "tenant_id string, row_id long, product string, price string, category string, description string")
    valid = spark.createDataFrame([("t", "gel")], "tenant_id string, category string")
    out = q.catalog_quality_report(df, valid).collect()
    for r in out:
        assert (r["rows"], r["price_ok"], r["price_bad"], r["price_zero"], r["price_neg"], r["duplicates"]) == (15, 14, 1, 1, 0, 12)
    assert sorted(r["line"] for r in out if r["severity"] == "error") == [
        "1 filas con precio inválido",
        "12 productos duplicados (ejemplos: ['" + "', '".join(["same"] * 10) + "'])",
        "Columna 'price' tiene 6.7% valores nulos (> 5%)",
    ]
    assert sorted((r["line"], r["detail"] or "") for r in out if r["severity"] == "warning") == [
        ("1 descripciones con menos de 10 caracteres", ""), ("1 filas con precio 0.00", ""), ("categorías desconocidas: ['odd']", "odd"),
    ]
    none = q.catalog_quality_report(df, valid.where("false")).collect()
    assert any("No se validaron" in r["line"] for r in none)


def test_report_names_every_unknown_category(spark):
    rows = [("t", i, f"p{i}", "9,5", f"odd{i}", "long enough text") for i in range(150)] + [("fine", 1, "p", "1", "gel", "long enough text")]
    df = spark.createDataFrame(rows, "tenant_id string, row_id long, product string, price string, category string, description string")
    valid = spark.createDataFrame([("t", "gel"), ("fine", "gel")], "tenant_id string, category string")
    out = q.catalog_quality_report(df, valid).collect()
    assert {r["detail"] for r in out if r["tenant_id"] == "t"} == {f"odd{i}" for i in range(150)}
    assert [(r["rows"], r["severity"], r["line"]) for r in out if r["tenant_id"] == "fine"] == [(1, None, None)]


def test_grounding_in_a_long_answer(spark):
    """Names at every kind of border of a long answer are found, and work stays linear in its length."""
    filler = "lorem ipsum "
    body = list(filler * 9000)
    for at in (0, 250, 16_380, 32_768, 99_000):
        body[at : at + 12] = "Golden Creme"
    names = ["golden creme", "creme", "lorem ipsum lorem", "absent name", "Cited"]
    answers = spark.createDataFrame([("t", 1, "".join(body) + " cited", ["CITED"]), ("t", 2, None, []), ("t", 3, "", [])],
                                    "tenant_id string, msg_id long, answer string, sources array<string>")
    catalog = spark.createDataFrame([("t", n) for n in names] + [("t", "creme"), ("u", "ipsum")], "tenant_id string, product_name string")
    got = {(r["msg_id"], r["product_name"], r["n_rows"]) for r in ev.grounding_violations(answers, catalog).collect()}
    assert got == {(1, "golden creme", 1), (1, "creme", 2), (1, "lorem ipsum lorem", 1)}
