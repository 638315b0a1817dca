"""Retrieval evaluation: precision and recall, rejections, grounding, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import TOKEN_PRICES
from .requests import nearest_rank_percentile, token_cost

# Length of the name prefix that is looked up in an answer.
PREFIX = 8
# Lengths of the pieces that answers are cut into, first and second.
PIECES = (1 << 14, 256)


def expected_hits(retrieved: Column, expected: Column) -> Column:
    """Expected names that were retrieved, as a set."""
    return F.array_intersect(retrieved, expected)


def score_cases(cases: DataFrame) -> DataFrame:
    """Add ``precision_at_k`` and ``recall``; cases without expectations stay unscored.

    Hits are sets, but the denominators are list lengths. Both are rounded per case.
    """
    n_hits = F.size(expected_hits(F.col("retrieved_products"), F.col("expected_products")))
    n_got, n_want = F.size("retrieved_products"), F.size("expected_products")
    precision = F.when(n_got > 0, F.round(n_hits / n_got, 3)).otherwise(0.0)
    return cases.withColumns(
        {
            "precision_at_k": F.when(n_want > 0, precision),
            "recall": F.when(n_want > 0, F.round(n_hits / n_want, 3)),
        }
    )


def reject_cases(cases: DataFrame) -> DataFrame:
    """Add ``correctly_rejected`` to the cases that should find nothing."""
    return cases.withColumn("correctly_rejected", F.when(F.col("expect_no_match"), F.size("sources") == 0))


def _pieces(texts: DataFrame, step: int, overlap: Column) -> DataFrame:
    """Cut ``text`` every ``step`` characters, each piece with the ``overlap`` characters after it; ``offset`` says where."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(step))
    cut = texts.select("tenant_id", "msg_id", "offset", "text", F.explode(starts).alias("at"))
    piece = F.substr("text", F.col("at") + 1, F.lit(step) + overlap)
    return cut.select("tenant_id", "msg_id", (F.col("offset") + F.col("at")).alias("offset"), piece.alias("text")).distinct()


def grounding_violations(answers: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog names that occur in an answer but not among its sources.

    ``answers``: tenant_id, msg_id, answer, sources. ``catalog``: tenant_id, product_name. Both
    sides are compared in lower case, as substrings. Returns ``(tenant_id, msg_id, product_name,
    n_rows)`` where n_rows is the number of catalog rows of that name.

    No answer is compared with every name. Answers are cut into pieces that overlap by the longest name, so work
    is linear in their length. Places in a piece where the first characters of some name stand are found by equality;
    from each, one substring per name length with that prefix is looked up among the whole names, again by equality.
    """
    spelled = catalog.where(F.col("product_name").isNotNull()).groupBy("tenant_id", "product_name").agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    low = spelled.withColumn("name", F.lower("product_name"))
    names = low.select("tenant_id", "name").distinct()
    size = F.length("name")
    prefixes = (
        names.where(size > 0)
        .select(
            "tenant_id",
            F.substring("name", 1, PREFIX).alias("prefix"),
            size.alias("size"),
        )
        .groupBy("tenant_id", "prefix")
        .agg(F.collect_set("size").alias("sizes"))
    )
    longest = names.agg(F.coalesce(F.max(size), F.lit(0))).scalar()
    texts = answers.select("tenant_id", "msg_id", F.lit(0).cast("long").alias("offset"), F.lower("answer").alias("text"))
    # Finding a place in a text takes time in proportion to its offset, hence two steps.
    for step in PIECES:
        texts = _pieces(texts, step, longest)
    # Prefix lengths in use: the full one, and those of shorter names, which are their own prefix.
    widths = names.where(size > 0).agg(F.collect_set(F.least(size, F.lit(PREFIX))).alias("w")).scalar()
    starts = F.sequence(F.lit(1), F.least(F.greatest(F.length("text"), F.lit(1)), F.lit(PIECES[-1])))
    places = (
        texts.select("tenant_id", "msg_id", "offset", "text", F.explode(widths).alias("width"))
        .select("tenant_id", "msg_id", "offset", "text", "width", F.explode(starts).alias("at"))
        .select("tenant_id", "msg_id", "offset", "at", "width", F.expr("substring(text, at, width)").alias("prefix"))
        .where(F.length("prefix") == F.col("width"))
        .join(prefixes, ["tenant_id", "prefix"])
        .select("tenant_id", "msg_id", "offset", F.struct("at", "sizes").alias("place"))
        .groupBy("tenant_id", "msg_id", "offset")
        .agg(F.collect_list("place").alias("places"))
    )
    windows = (
        texts.join(places, ["tenant_id", "msg_id", "offset"])
        .select("tenant_id", "msg_id", "text", F.explode("places").alias("p"))
        .select("tenant_id", "msg_id", "text", F.col("p.at").alias("at"), F.explode("p.sizes").alias("size"))
        .select("tenant_id", "msg_id", F.expr("substring(text, at, size)").alias("name"))
        .distinct()
    )
    # An empty name occurs in every answer.
    empty = names.where(size == 0).join(answers.where("answer IS NOT NULL").select("tenant_id", "msg_id"), "tenant_id")
    found = windows.unionByName(empty.select("tenant_id", "msg_id", "name"))
    cited = answers.select(
        "tenant_id", "msg_id", F.explode(F.transform("sources", F.lower)).alias("name")
    )
    return (
        found.join(low, ["tenant_id", "name"])
        .join(cited, ["tenant_id", "msg_id", "name"], "left_anti")
        .select("tenant_id", "msg_id", "product_name", "n_rows")
    )


def no_match_rejection(cases: DataFrame, *by: str) -> DataFrame:
    return reject_cases(cases).groupBy(*by).agg(
        F.count_if("expect_no_match").alias("cases"),
        F.count_if("correctly_rejected").alias("correctly_rejected"),
    )


def eval_summary(results: DataFrame) -> DataFrame:
    """One row over all cases; means are null when nothing was scored, percentiles then 0.

    ``results``: precision_at_k, recall, expect_no_match, correctly_rejected, n_hallucinations,
    retrieve_ms, answer_ms and the tokens each case used: embedding, chat_prompt, chat_completion.
    """
    scored = F.col("recall").isNotNull()
    counts = results.agg(
        F.count(F.lit(1)).alias("cases_total"),
        F.round(F.avg("precision_at_k"), 3).alias("mean_precision_at_k"),
        F.round(F.avg("recall"), 3).alias("mean_recall"),
        F.count_if(scored).alias("cases_scored"),
        F.count_if("expect_no_match").alias("no_match_cases"),
        F.count_if("correctly_rejected").alias("correctly_rejected"),
        F.count_if(F.col("n_hallucinations") > 0).alias("cases_with_possible_hallucination"),
        *[F.coalesce(F.sum(kind), F.lit(0)).alias(f"{kind}_tokens") for kind in TOKEN_PRICES],
        F.round(F.coalesce(token_cost(), F.lit(0.0)), 5).alias("estimated_cost_usd"),
    )
    timed = results.select(
        F.explode(
            F.array(
                F.struct(F.lit("retrieve").alias("step"), F.col("retrieve_ms").alias("ms")),
                F.struct(F.lit("answer").alias("step"), F.col("answer_ms").alias("ms")),
            )
        ).alias("t")
    ).select("t.*")
    ranked = nearest_rank_percentile(timed, "ms", [50, 95], ["step"])

    def pick(step: str, percent: int) -> Column:
        is_it = (F.col("step") == step) & (F.col("percent") == percent)
        return F.coalesce(F.max(F.when(is_it, F.col("ms"))), F.lit(0.0)).alias(f"{step}_p{percent}")

    latency = ranked.agg(*[pick(s, p) for s in ("retrieve", "answer") for p in (50, 95)])
    # Two one-row aggregates side by side.
    one = F.lit(1).alias("_one")
    return counts.select("*", one).join(latency.select("*", one), "_one").drop("_one")
