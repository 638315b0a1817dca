import pytest
from pyspark.sql import functions as F

from shelfwise.operators import catalog as cat
from shelfwise.sources import catalog as src
from shelfwise.sources import patterns as pat


def columns(spark, *names):
    return spark.createDataFrame([tuple(names)], ", ".join(f"`{n}` string" for n in names))


def test_schema_map_renames_once_and_keeps_what_exists(spark):
    df = src.apply_schema_map(columns(spark, "Product", "Price (€)", "Brand", "other"))
    assert df.columns == ["product_name", "price_eur", "brand", "other"]
    assert src.apply_schema_map(df).columns == df.columns
    kept = src.apply_schema_map(columns(spark, "product_name", "Product"))
    assert kept.columns == ["product_name", "Product"]
    assert src.apply_schema_map(columns(spark, "Name", "Price")).columns == ["product_name", "price_eur"]


def test_logical_columns_ignore_case_and_blanks(spark):
    df = columns(spark, " NOMBRE ", "precio (€)", "Categoría", "x")
    assert src.map_logical_columns(df) == {"product": " NOMBRE ", "price": "precio (€)", "category": "Categoría"}
    with pytest.raises(ValueError, match="category"):
        src.select_logical(columns(spark, "name", "price"))


def test_text_columns(spark):
    assert src.infer_text_columns(columns(spark, "Tags", "x", "Name")) == ["Name", "Tags"]
    assert src.infer_text_columns(columns(spark, "x", "y")) == ["x", "y"]


def test_csv_with_line_breaks_quotes_and_missing_cells(spark, tmp_path):
    (tmp_path / "c.csv").write_text(
        'Product,Price (€),Features\n"A ""big"" one",49.90,"- first\n- second"\nNA,n/a,""\n', encoding="utf-8"
    )
    rows = [tuple(r) for r in src.read_catalog_csv(spark, str(tmp_path / "c.csv")).collect()]
    assert rows == [('A "big" one', "49.90", "- first\n- second"), (None, None, None)]


def test_all_tenants_with_their_own_headers(spark, tmp_path):
    for tenant, body in {
        "one": 'Product,Price (€)\nA,1.5\n"B\nB",2\n',
        "two": "Name,Brand\nC,X\n",
        "three": "Product,Price (€)\nD,oops\n",
        "empty": None,
    }.items():
        (tmp_path / tenant).mkdir()
        if body:
            (tmp_path / tenant / "products_catalog.csv").write_text(body, encoding="utf-8")
    whole = cat.coerce_price(src.read_all_tenants(spark, str(tmp_path)))
    got = sorted(tuple(r) for r in whole.select("tenant_id", "row_id", "product_name", "price_eur").collect())
    assert got == [("one", 0, "A", 1.5), ("one", 1, "B\nB", 2.0), ("three", 0, "D", None), ("two", 0, "C", None)]
    assert whole.where("tenant_id = 'two'").first()["brand"] == "X"


def test_load_catalog(spark):
    raw = spark.createDataFrame(
        [("  Crème ", "12.5", None, "Soft"), ("X", "n/a", "", None)], "Product string, Price string, Brand string, Features string"
    )
    rows = cat.load_catalog(raw).collect()
    assert [r["retrieval_text"] for r in rows] == ["Creme | Soft | price 12.50€", "X"]
    with pytest.raises(ValueError, match="product_name"):
        cat.load_catalog(columns(spark, "Price"))


def test_cards(spark):
    df = spark.createDataFrame(
        [("A", "", "F" * 300, 1.0), ("", "B" * 281, "F", None)], "product_name string, benefits string, features string, price_eur double"
    )
    first, second = (r[0] for r in df.select(cat.lean_card(cat.product_card(df))).collect())
    assert first["benefits"] == "F" * 280 + "…" and first["brand"] == "" and first["price_eur"] == 1.0
    assert second["benefits"] == "B" * 280 + "…" and second["price_eur"] is None
    labels = [r[0] for r in df.select(cat.source_label(F.col("product_name"), F.lit(7))).collect()]
    assert labels == ["A", "row 7"]


def test_corpus_keeps_empty_parts(spark):
    df = spark.createDataFrame([("A", None, "T")], "name string, brand string, tags string")
    assert df.select(cat.make_corpus(df)).first()[0] == "A -  - T"


def test_pattern_documents(spark):
    docs = spark.createDataFrame(
        [
            ("a", '{"categories": {"z": ["k2", "k1"], "b": ["q"]}, "more": {"never": ["x"]}}'),
            ("b", "{}"),
            ("c", "no json"),
        ],
        "tenant_id string, document string",
    )
    rows = sorted(tuple(r) for r in pat.explode_patterns(docs).collect())
    assert rows == [("a", 0, "z", 0, "k2"), ("a", 0, "z", 1, "k1"), ("a", 1, "b", 0, "q")]
    assert sorted(r[0] for r in pat.unusable_documents(docs).collect()) == ["b", "c"]


def test_configuration_files(spark, tmp_path):
    pytest.importorskip("yaml")
    for tenant, name, body in [
        ("one", "category_patterns.yaml", "categories:\n  z: [k2, 'ñ']\n  b: [q]\nother: {x: [y]}\n"),
        ("two", "category_patterns.yaml", '{"skin": {"dry": ["seca"]}}'),
        ("bad", "category_patterns.yaml", "a: [unclosed"),
        ("one", "price_patterns.yaml", "price_patterns:\n  en: {under: [below, '<'], currency: ['€']}\n  es: {under: [menos de]}\n"),
        ("one", "few_shot_prompt.yaml", "- {user: hi, assistant: hello}\n- {user: ' ', assistant: no}\n- {user: x}\n"),
        ("one", "tenants.yaml", "a: {api_key: k, max_requests_per_day: 5}\nb: {api_key: q}\n"),
    ]:
        (tmp_path / tenant / "patterns").mkdir(parents=True, exist_ok=True)
        (tmp_path / tenant / "patterns" / name).write_text(body, encoding="utf-8")
    read = lambda name: pat.read_documents(spark, f"{tmp_path}/*/patterns/{name}", tenant_level=2)
    docs = read("category_patterns.yaml")
    words = sorted((r["tenant_id"], r["ordinal"], r["canonical"], r["keyword"]) for r in pat.explode_patterns(docs).collect())
    assert words == [("one", 0, "z", "k2"), ("one", 0, "z", "ñ"), ("one", 1, "b", "q"), ("two", 0, "dry", "seca")]
    assert [r[0] for r in pat.unusable_documents(docs).collect()] == ["bad"]
    terms = {r["kind"]: r["terms"] for r in pat.union_price_terms(pat.price_terms_of(read("price_patterns.yaml"))).collect()}
    assert terms == {"under": ["below", "<", "menos de"], "currency": ["€"]}
    pairs = pat.valid_few_shot(pat.few_shot_of(read("few_shot_prompt.yaml"))).collect()
    assert [(r["user"], r["assistant"]) for r in pairs] == [("hi", "hello")]
    registry = sorted(tuple(r) for r in pat.tenants_of(read("tenants.yaml")).collect())
    assert registry == [("a", "k", 5), ("b", "q", None)]


def test_headers_that_differ_in_case_can_be_written(spark, tmp_path):
    """A catalog with Brand and brand keeps both, also in a file."""
    from shelfwise.session import prepare

    try:
        raw = spark.createDataFrame([("a", "b")], "Product string, Brand string").selectExpr("*", "upper(Brand) AS other")
        mapped = src.apply_schema_map(raw.toDF("Product", "Brand", "brand"))
        mapped.write.parquet(str(tmp_path / "out"))
        back = spark.read.parquet(str(tmp_path / "out"))
        assert back.columns == ["product_name", "Brand", "brand"]
        assert [tuple(r) for r in back.select("brand", "Brand", "product_name").collect()] == [("B", "b", "a")]
    finally:
        prepare(spark)
    assert spark.conf.get("spark.sql.caseSensitive") == "false"
