"""Which products of a tenant a message's price range and category hints allow.

A tenant may hold a large share of all messages and of all products, so nothing here pairs the
two sides by tenant alone. Prices fall into a hierarchy of cells, 1, 4, 16, 64 ... cents wide. A price
range is the disjoint union of a few of them (about twice the levels it spans), and a product lies in
exactly one cell per level, so range conditions become equi-joins on (tenant, category, cell).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.price import DEFAULT_TERMS, PriceTerms, TermColumns, parse_price_range
from ..session import dealt, materialized
from .keywords import with_names

FANOUT = 4
LEVELS = 15
# Level marks of index rows that are not range cells.
EXACT, EVERYTHING = -1, LEVELS + 1
# Scopes of the index: "=" and a category, or all products of the tenant.
ANY_CATEGORY = "*"
# Where a product lies and a message looks.
PLACE = ["tenant_id", "scope", "level", "cell"]
# Products of a place that meet its messages at a time.
BLOCK = 1024
# Prices above share the last cell; they are told apart by the exact comparison.
MAX_PRICE = 1.0e7


def with_price_range(
    messages: DataFrame, terms: DataFrame | PriceTerms = DEFAULT_TERMS, shared: PriceTerms = DEFAULT_TERMS
) -> DataFrame:
    """Add ``lo`` and ``hi`` parsed from the message text.

    ``terms`` is one wording for all, or a table ``(tenant_id, under, between, currency)``; a tenant
    with a row has its own terms alone, others have ``shared``.
    """
    if isinstance(terms, DataFrame):
        own = {k: F.col(k).alias(f"_{k}") for k in ("under", "between", "currency")}
        table = materialized(terms.select("tenant_id", *own.values(), F.lit(True).alias("_own")), "price-terms")
        messages = messages.join(table, "tenant_id", "left")
        common = {k: F.array(*map(F.lit, getattr(shared, k))).cast("array<string>") for k in own}
        wording = TermColumns(**{k: F.when(F.col("_own"), F.col(f"_{k}")).otherwise(common[k]) for k in own})
        dropped = ["_own", *(f"_{k}" for k in own)]
    else:
        wording, dropped = terms, []
    priced = messages.withColumn("_price", parse_price_range(F.col("message"), wording))
    priced = priced.withColumns({"lo": F.col("_price.lo"), "hi": F.col("_price.hi")})
    return priced.drop("_price", *dropped)


def with_intent(
    messages: DataFrame, patterns: DataFrame, terms: DataFrame | PriceTerms = DEFAULT_TERMS
) -> DataFrame:
    """Add ``lo``, ``hi`` and ``hints`` parsed from the message text; ``terms`` as in ``with_price_range``."""
    return with_names(with_price_range(messages, terms), patterns)


def filter_price_range(catalog: DataFrame, lo: Column | float, hi: Column | float) -> DataFrame:
    return catalog.where(F.col("price_eur").between(lo, hi))


def filter_category_in(catalog: DataFrame, hints: Column) -> DataFrame:
    """Exact membership; no hints, or no category column, leave the catalog whole."""
    if "category" not in catalog.columns:
        return catalog
    return catalog.where((F.size(hints) == 0) | F.array_contains(hints, F.col("category")))


def matches(price: Column, category: Column, lo: Column, hi: Column, hints: Column) -> Column:
    """The candidate rule for one (message, product) pair."""
    price_ok = lo.isNull() | F.coalesce(price.between(lo, hi), F.lit(False))
    category_ok = (F.size(hints) == 0) | F.coalesce(
        F.array_contains(hints, category), F.lit(False)
    )
    return price_ok & category_ok


def _cell(price: Column) -> Column:
    """Rank-preserving integer price; the exact limits are checked on the doubles."""
    bounded = F.least(F.greatest(price, F.lit(0.0)), F.lit(MAX_PRICE))
    return F.when(price.isNotNull(), F.floor(bounded * 100).cast("long"))


def _width(level: Column) -> Column:
    return F.pow(F.lit(float(FANOUT)), level).cast("long")


def _run(a: Column, b: Column) -> Column:
    none = F.array().cast("array<bigint>")
    return F.when(a <= b, F.sequence(a, b)).otherwise(none)


def with_cover(df: DataFrame, first: str, last: str, exact: bool = False) -> DataFrame:
    """One row per cell of the disjoint cover of ``first..last``: adds ``level`` and ``cell``.

    A null range reads the one cell that holds everything. With ``exact`` the two outermost one-cent
    cells are left out of the cover and asked for as exact prices instead. All columns are plain
    expressions, so the expansion stays in generated code.
    """
    lo, hi = F.col(first), F.col(last)
    a, b = (lo + 1, hi - 1) if exact else (lo, hi)
    # No cell wider than the range lies inside it.
    top = F.floor(F.log(float(FANOUT), F.greatest(b - a + 1, F.lit(1)).cast("double"))) + 1
    levels = F.sequence(F.lit(0), F.least(top, F.lit(LEVELS)).cast("int"))
    if exact:
        levels = F.concat(levels, F.array(F.lit(EXACT)))
    levels = F.when(lo.isNull(), F.array(F.lit(EVERYTHING))).otherwise(levels)

    level = F.col("level")
    placed = df.withColumn("level", F.explode(levels)).withColumn("_w", _width(F.abs(level)))
    inside = placed.withColumns(
        {
            # First and last cell wholly inside, on this level and on the next.
            "_a": F.ceil(a / F.col("_w")).cast("long"),
            "_b": F.floor((b + 1) / F.col("_w")).cast("long") - 1,
            "_up": F.ceil(a / (F.col("_w") * FANOUT)).cast("long"),
            "_down": F.floor((b + 1) / (F.col("_w") * FANOUT)).cast("long") - 1,
        }
    )
    # What has a parent wholly inside is left to the parent.
    split = (F.col("_up") <= F.col("_down")) & (level < LEVELS)
    ends = F.concat(
        _run(F.col("_a"), F.col("_up") * FANOUT - 1), _run((F.col("_down") + 1) * FANOUT, F.col("_b"))
    )
    cells = (
        F.when(level == EVERYTHING, F.array(F.lit(0).cast("long")))
        .when(level == EXACT, F.array_distinct(F.array(lo, hi)))
        .when(split, ends)
        .otherwise(_run(F.col("_a"), F.col("_b")))
    )
    return inside.withColumn("cell", F.explode(cells)).drop("_w", "_a", "_b", "_up", "_down")


def with_product_cells(df: DataFrame, price: str, exact: bool = False) -> DataFrame:
    """One row per cell a product lies in: adds ``level`` and ``cell``."""
    levels = F.concat(F.sequence(F.lit(0), F.lit(LEVELS)), F.array(F.lit(EVERYTHING)))
    if exact:
        levels = F.concat(levels, F.array(F.lit(EXACT)))
    levels = F.when(F.col(price).isNull(), F.array(F.lit(EVERYTHING))).otherwise(levels)
    level, at = F.col("level"), _cell(F.col(price))
    cell = (
        F.when(level == EVERYTHING, F.lit(0).cast("long"))
        .when(level == EXACT, at)
        .otherwise(F.floor(at / _width(F.abs(level))).cast("long"))
    )
    return df.withColumn("level", F.explode(levels)).withColumn("cell", cell)


def category_scope(category: Column) -> Column:
    return F.concat(F.lit("="), category)


def product_scopes(category: Column) -> Column:
    """Where a product is found: under its category, if it has one, and among all products."""
    return F.array_compact(F.array(category_scope(category), F.lit(ANY_CATEGORY)))


def wanted_scopes(hints: Column) -> Column:
    """Where a message looks: in its hinted categories, or among all products."""
    named = F.transform(F.array_distinct(hints), category_scope)
    return F.when(F.size(hints) == 0, F.array(F.lit(ANY_CATEGORY))).otherwise(named)


def _asked(messages: DataFrame, exact: bool) -> DataFrame:
    """The (scope, cell) places every message reads."""
    scoped = messages.select(
        "tenant_id",
        "msg_id",
        "lo",
        "hi",
        _cell(F.col("lo")).alias("_first"),
        _cell(F.col("hi")).alias("_last"),
        F.explode(wanted_scopes(F.col("hints"))).alias("scope"),
    )
    return with_cover(scoped, "_first", "_last", exact).drop("_first", "_last")


def match_counts(messages: DataFrame, catalog: DataFrame) -> DataFrame:
    """Number of candidates per message, without forming (message, product) pairs.

    The catalog is first counted per (tenant, category, price) and rolled up into cells; a message
    then adds up the counts of its cells. Returns ``(tenant_id, msg_id, n_match)`` of the messages
    that have candidates.
    """
    per_price = (
        catalog.groupBy("tenant_id", "category", "price_eur")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("scope", F.explode(product_scopes(F.col("category"))))
        .groupBy("tenant_id", "scope", "price_eur")
        .agg(F.sum("n").alias("n"))
    )
    index = (
        with_product_cells(per_price, "price_eur", exact=True)
        .withColumn("price", F.when(F.col("level") == EXACT, F.col("price_eur")))
        .groupBy("tenant_id", "scope", "level", "cell", "price")
        .agg(F.sum("n").alias("n"))
    )
    asked = _asked(messages, exact=True)
    inside = (F.col("level") != EXACT) | F.col("price").between(F.col("lo"), F.col("hi"))
    return (
        asked.join(index, ["tenant_id", "scope", "level", "cell"])
        .where(inside)
        .groupBy("tenant_id", "msg_id")
        .agg(F.sum("n").alias("n_match"))
    )


def effective_filters(messages: DataFrame, catalog: DataFrame) -> DataFrame:
    """Filters to retrieve with: ``(tenant_id, msg_id, lo, hi, hints, n_match)``.

    A message that no product satisfies loses its filters, so that all products are candidates.
    """
    asked = messages.select("tenant_id", "msg_id", "lo", "hi", "hints")
    counted = asked.join(match_counts(messages, catalog), ["tenant_id", "msg_id"], "left")
    some = F.col("n_match") > 0
    return counted.select(
        "tenant_id",
        "msg_id",
        F.when(some, F.col("lo")).alias("lo"),
        F.when(some, F.col("hi")).alias("hi"),
        F.when(some, F.col("hints")).otherwise(F.array().cast("array<string>")).alias("hints"),
        F.coalesce("n_match", F.lit(0)).alias("n_match"),
    )


def candidates_or_all(messages: DataFrame, catalog: DataFrame) -> DataFrame:
    """Effective filters with the number of candidates they leave."""
    sizes = catalog.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_catalog"))
    sizes = materialized(sizes, "catalog-sizes")
    sized = effective_filters(messages, catalog).join(sizes, "tenant_id", "left")
    whole = F.coalesce("n_catalog", F.lit(0))
    left = F.when(F.col("n_match") > 0, F.col("n_match")).otherwise(whole)
    return sized.withColumns({"n_catalog": whole, "n_candidates": left})


def message_candidates(messages: DataFrame, catalog: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """All allowed (message, product) pairs, each produced by exactly one cell. Places of many products are cut into blocks, which
    meet their messages in different tasks. A block is one row with a list of its products, so a message meets it once, and pairs are
    made from the list after all shuffles and sorts.

    With ``among``, pairs ``(tenant_id, msg_id, row_id)``, those of them that are allowed: the rule is applied to them alone,
    and the others, which grow with messages times products, are not formed.
    """
    if among is not None:
        asked = messages.select("tenant_id", "msg_id", "lo", "hi", "hints")
        facts = catalog.select("tenant_id", "row_id", "price_eur", "category")
        allowed = matches(*[F.col(c) for c in ("price_eur", "category", "lo", "hi", "hints")])
        pairs = among.select("tenant_id", "msg_id", "row_id").join(asked, ["tenant_id", "msg_id"])
        return pairs.join(facts, ["tenant_id", "row_id"]).where(allowed).select("tenant_id", "msg_id", "row_id")
    # A product without a tenant is nobody's candidate.
    narrow = dealt(catalog.where("tenant_id IS NOT NULL").select("tenant_id", "row_id", "price_eur", "category"))
    scoped = narrow.select("tenant_id", "row_id", "price_eur", F.explode(product_scopes(F.col("category"))).alias("scope"))
    full = materialized(_full_cells(catalog), "full-cells")
    block = F.coalesce(F.pmod(F.hash("row_id"), F.col("blocks")), F.lit(0))
    products = with_product_cells(scoped, "price_eur").join(full, PLACE, "left").withColumn("block", block).drop("blocks")
    asked = _asked(dealt(messages.select("tenant_id", "msg_id", "lo", "hi", "hints")), exact=False)
    blocks = F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)
    asked = asked.join(full, PLACE, "left").withColumn("block", F.explode(blocks)).drop("blocks")
    # The planner does not see how rows multiply in cells and would send all cells of the catalog to every task. Tasks are dealt blocks by hash
    # and not put together by their size, which does not tell how many pairs they make.
    keys = [*PLACE, "block"]
    lists = dealt(products, *keys).groupBy(*keys).agg(F.collect_list(F.struct("price_eur", "row_id")).alias("products"))
    met = dealt(asked, *keys).join(lists.hint("merge"), keys)
    pairs = met.select("tenant_id", "msg_id", "lo", "hi", F.inline("products"))
    inside = F.col("lo").isNull() | F.col("price_eur").between(F.col("lo"), F.col("hi"))
    return pairs.where(inside).select("tenant_id", "msg_id", "row_id")


def _full_cells(catalog: DataFrame) -> DataFrame:
    """The places of more than ``BLOCK`` products, and into how many ``blocks`` they are cut, counted by price."""
    per_price = catalog.groupBy("tenant_id", "category", "price_eur").agg(F.count(F.lit(1)).alias("n"))
    scoped = per_price.select("tenant_id", "price_eur", "n", F.explode(product_scopes(F.col("category"))).alias("scope"))
    counts = with_product_cells(scoped, "price_eur").groupBy(*PLACE).agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") > BLOCK).select(*PLACE, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))


def ranked_semi_candidates(ranked: DataFrame, candidates: DataFrame) -> DataFrame:
    """Ranked hits that are candidates of their message."""
    keys = ["tenant_id", "msg_id", "row_id"]
    return ranked.join(candidates.select(*keys), keys, "left_semi")
