import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.functions import clock, keywords, price, text, vector


@pytest.mark.parametrize(
    ("message", "expected"),
    [
        ("under 25", (0, 25)), ("below 19,5", (0, 19.5)), ("menos de 40", (0, 40)), ("< 15", (0, 15)),
        ("under € 30", (0, 30)), ("10 to 20", (10, 20)), ("10-20", (10, 20)), ("10 a 20", (10, 20)),
        ("20 to 10", (10, 20)), ("budget € 30", (30, 30)), ("EUR 22 max", (22, 22)), ("30 €", (30, 30)),
        ("30 €", (30, 30)), ("between 10 and 20", None), ("something nice", None), (None, None),
        ("from 12,50 to 20.75 under 5", (12.5, 20.75)),
    ],
)
def test_price_range(values, message, expected):
    got = values(price.parse_price_range, [message])[0]
    assert (tuple(got) if got else None) == expected


def test_empty_price_terms_switch_their_rule_off(values):
    terms = price.PriceTerms(under=[], between=["to"], currency=[])
    parse = lambda c: price.parse_price_range(c, terms)
    assert values(parse, ["under 30", "€30", "1 to 3"]) == [None, None, (1.0, 3.0)]


def test_catalog_price(values):
    cells = ["€12,50", "1 2.5", "-3", "ask", None, "12.345", "0,00"]
    assert values(price.extract_price_number, cells) == [12.5, 12.5, 3.0, None, None, 12.34, 0.0]


def test_category_hints_in_pattern_order_and_inside_words(values):
    patterns = {"moisturizer": ["lotion", "loción"], "cleanser": ["gel"], "serum": ["serum"]}
    fn = lambda c: keywords.category_hints(c, patterns)
    got = values(fn, ["I need a Locion or maybe a GEL", "gel, then LOCIÓN", "angel", "none"])
    assert got == [["moisturizer", "cleanser"], ["moisturizer", "cleanser"], ["cleanser"], []]


def test_skin_type_takes_first_pattern(values):
    patterns = {"dry": ["dry", "seca"], "combination": ["mixta", "combo"]}
    fn = lambda c: keywords.skin_type(c, patterns)
    assert values(fn, ["piel mixta, a veces combo", "combo or dry", "normal"]) == ["combination", "dry", None]


def test_medical_terms_are_whole_words(values):
    got = values(keywords.mentions_medical, ["My ECZEMA", "eczemas", "severe acne!", "severe  acne"])
    assert got == [True, False, True, False]
    assert values(lambda c: keywords.mentions_medical(c, []), ["eczema"]) == [False]


def test_normalize(values):
    inputs = [None, "  Crème  ", "Mª Pérez – 10 €…", "Straße", "\tplain\n", "Łódź œuvre"]
    expected = ["", "Creme", "Ma Perez - 10 EUR...", "Strasse", "plain", "Lodz oeuvre"]
    assert values(text.normalize, inputs) == expected


def test_render_does_not_expand_values_again(spark):
    value = text.render("{{{A}}} {B}", {"A": F.lit("{B}"), "B": F.lit("b")})
    assert spark.range(1).select(value).first()[0] == "{{B}} b"
    with pytest.raises(ValueError, match="CARDS"):
        text.render("{A}", {"A": F.lit("")}, required=["CARDS"])
    with pytest.raises(ValueError, match="no value"):
        text.render("{X}", {})


def test_shorten(values):
    assert values(lambda c: text.shorten(c, 3), ["abc", "abcd"]) == ["abc", "abc…"]


def test_json_keeps_nulls_and_accents(spark):
    line = spark.sql("select 'ñ' as a, cast(null as string) as b").select(text.json_text(F.struct("a", "b")))
    assert line.first()[0] == '{"a":"ñ","b":null}'
    assert json.loads(line.first()[0])["b"] is None


def test_time_of_day(spark):
    hours = spark.range(24).select(F.timestamp_seconds(F.col("id") * 3600).alias("t"))
    got = [r[0] for r in hours.select(clock.time_of_day(F.col("t"))).collect()]
    assert got == ["late"] * 5 + ["morning"] * 7 + ["afternoon"] * 6 + ["evening"] * 5 + ["late"]


@pytest.mark.parametrize("dim", [384, 64, 40])
def test_hash_embedding(values, dim):
    for given, got in zip(["hello", "ñandú"], values(lambda c: vector.hash_embedding(c, dim), ["hello", "ñandú"]), strict=True):
        digest = hashlib.sha256(given.encode()).digest()
        raw = (np.frombuffer((digest * 12)[:dim], dtype=np.uint8).astype("float64") - 127.5) / 127.5
        assert np.allclose(got, raw / np.linalg.norm(raw), atol=1e-6)


def test_normalised_and_cosine(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    rows = df.select(vector.l2_normalize(F.col("a")), vector.cosine_similarity(F.col("a"), F.col("b"))).collect()
    assert np.allclose(rows[0][0], [0.6, 0.8]) and rows[0][1] == pytest.approx(0.96)
    assert rows[1][0] == [0.0, 0.0] and rows[1][1] == 0.0
