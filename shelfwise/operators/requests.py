"""Request log: authentication, daily quota, counters, latency, alerts.

``requests``: rid, client_id, x_api_key, ts, method, path, status, latency_ms. ``tenants``:
client_id, api_key, max_requests_per_day. One client may send a third of all requests, so counts
are combined before the shuffle and running numbers are made of per-slot counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import (
    AUTH_BAD_KEY,
    AUTH_NO_CLIENT,
    AUTH_UNKNOWN,
    DEFAULT_DAILY_LIMIT,
    LATENCY_BUCKETS,
    TOKEN_PRICES,
)
from ..functions.clock import utc_day
from ..session import materialized

# Length of the slots that a client's day is numbered in.
SLOT_SECONDS = 60


def requests_with_tenant(
    requests: DataFrame, tenants: DataFrame, default_limit: int = DEFAULT_DAILY_LIMIT
) -> DataFrame:
    """Every request with its tenant's key and daily limit."""
    known = tenants.select("client_id", "api_key", "max_requests_per_day", F.lit(True).alias("known"))
    limit = F.coalesce("max_requests_per_day", F.lit(default_limit)).alias("daily_limit")
    joined = requests.join(known, "client_id", "left")
    return joined.select(*requests.columns, "api_key", F.coalesce("known", F.lit(False)).alias("known"), limit)


def classify_request_auth(requests: DataFrame, tenants: DataFrame) -> DataFrame:
    """Add ``auth_status`` (null when the request passes) and ``auth_detail``."""
    joined = requests_with_tenant(requests, tenants)
    no_client = F.coalesce(F.col("client_id"), F.lit("")) == ""
    key = F.coalesce(F.col("x_api_key"), F.lit(""))
    bad_key = (key == "") | ~F.coalesce(key == F.col("api_key"), F.lit(False))
    detail = (
        F.when(no_client, AUTH_NO_CLIENT)
        .when(~F.col("known"), F.concat(F.lit(AUTH_UNKNOWN), "client_id"))
        .when(bad_key, AUTH_BAD_KEY)
    )
    status = F.when(no_client, 400).when(~F.col("known") | bad_key, 401)
    return joined.withColumns({"auth_status": status, "auth_detail": detail})


def authorised(requests: DataFrame, tenants: DataFrame) -> DataFrame:
    passed = classify_request_auth(requests, tenants).where("auth_status IS NULL")
    return passed.withColumn("day", utc_day(F.col("ts")))


def quota_running_usage(
    authorised_requests: DataFrame, slot_seconds: int = SLOT_SECONDS, counted: DataFrame | None = None
) -> DataFrame:
    """Number each client's requests within its UTC day and admit those within the limit.

    Order is (ts, rid). A day is cut into slots: slots are counted first, the counts of earlier
    slots are added up, and rows are numbered inside their slot only. So a busy client's day is
    spread over many tasks instead of being one sort. ``counted`` (client_id, day, total) are requests
    that came before all of these.
    """
    keys = ["client_id", "day", "slot"]
    slot = F.floor(F.unix_micros("ts") / (slot_seconds * 1_000_000))
    rows = authorised_requests.withColumn("slot", slot)
    earlier = Window.partitionBy("client_id", "day").orderBy("slot").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .drop("n")
    )
    if counted is not None:
        starts = starts.join(counted.select("client_id", "day", "total"), ["client_id", "day"], "left")
        starts = starts.withColumn("before", F.col("before") + F.coalesce("total", F.lit(0))).drop("total")
    inside = Window.partitionBy(*keys).orderBy("ts", "rid")
    numbered = rows.withColumn("at", F.row_number().over(inside)).join(starts, keys)
    used = F.col("before") + F.col("at")
    admitted = used <= F.col("daily_limit")
    return numbered.withColumns(
        {
            "used": F.when(admitted, used).otherwise(F.greatest("daily_limit", F.lit(0)).cast("long")),
            "remaining": F.greatest(F.col("daily_limit") - used, F.lit(0)),
            "admitted": admitted,
            "quota_status": F.when(~admitted, 429),
        }
    ).drop("slot", "before", "at")


def daily_usage(authorised_requests: DataFrame) -> DataFrame:
    """Admitted requests per client and UTC day."""
    return authorised_requests.groupBy("client_id", "day").agg(
        F.least(F.count(F.lit(1)), F.greatest(F.max("daily_limit"), F.lit(0)).cast("long")).alias("used")
    )


def access_log_row(requests: DataFrame) -> DataFrame:
    """The log record: epoch seconds, id, request, whole milliseconds and, if known, the quota."""
    has = lambda c: c in requests.columns
    rid = F.coalesce(F.col("rid").cast("string"), F.uuid()) if has("rid") else F.uuid()
    limit = F.col("rate_limit") if has("rate_limit") else F.lit(None).cast("int")
    left = F.col("rate_remaining") if has("rate_remaining") else F.lit(None).cast("int")
    quota = F.struct(
        limit.cast("int").alias("limit"), F.coalesce(left.cast("int"), F.lit(0)).alias("remaining")
    )
    return requests.select(
        (F.unix_micros("ts") / 1_000_000).alias("ts"),
        rid.alias("rid"),
        F.coalesce("client_id", F.lit("n/a")).alias("client_id"),
        "method",
        "path",
        F.col("status").cast("int").alias("status"),
        F.col("latency_ms").cast("int").alias("latency_ms"),
        F.when(limit.isNotNull(), quota).alias("rate_limit"),
    )


# --- counters and latency -------------------------------------------------------------------


def http_requests_total(requests: DataFrame, *also: Column | str) -> DataFrame:
    return requests.groupBy(*also, "method", "path", "status").agg(F.count(F.lit(1)).alias("total"))


def recommendations_total(requests: DataFrame, *also: Column | str) -> DataFrame:
    """Answers given, per client."""
    given = requests.where("path = '/answer' AND status = 200")
    return given.groupBy(*also, "client_id").agg(F.count(F.lit(1)).alias("total"))


def _bucket_counts(bounds: Sequence[float]) -> list[Column]:
    seconds = F.col("latency_ms") / 1000
    return [F.count_if(seconds <= F.lit(float(le))).alias(f"b{i}") for i, le in enumerate(bounds)]


def latency_counts(requests: DataFrame, *by: Column | str, bounds: Sequence[float] = LATENCY_BUCKETS) -> DataFrame:
    """Cumulative histogram per group, a column ``b0``, ``b1``, ... per bound."""
    return requests.groupBy(*by).agg(
        *_bucket_counts(bounds),
        (F.sum("latency_ms") / 1000).alias("sum"),
        F.count("latency_ms").alias("count"),
    )


def as_buckets(counted: DataFrame, bounds: Sequence[float] = LATENCY_BUCKETS) -> DataFrame:
    """The columns of ``latency_counts`` as one array ``buckets``."""
    entries = [
        F.struct(F.lit(float(le)).alias("le"), F.col(f"b{i}").alias("n"))
        for i, le in enumerate(bounds)
    ]
    return counted.withColumn("buckets", F.array(*entries)).drop(
        *[f"b{i}" for i in range(len(bounds))]
    )


def latency_buckets(
    requests: DataFrame, *by: Column | str, bounds: Sequence[float] = LATENCY_BUCKETS
) -> DataFrame:
    """Cumulative histogram as one array per group, counted in one pass."""
    return as_buckets(latency_counts(requests, *by, bounds=bounds), bounds)


def latency_histogram(requests: DataFrame, bounds: Sequence[float] = LATENCY_BUCKETS) -> DataFrame:
    """Bucket rows by method and path."""
    by = latency_buckets(requests, "method", "path", bounds=bounds)
    return by.select("method", "path", "sum", "count", F.explode("buckets").alias("b")).select(
        "method", "path", F.col("b.le").alias("le"), F.col("b.n").alias("n"), "sum", "count"
    )


def histogram_quantile(buckets: Column, q: float) -> Column:
    """Quantile of a cumulative histogram, linear inside a bucket.

    In the open last bucket it is the largest finite bound; an empty histogram has none.
    """
    size = F.size(buckets)
    total = buckets[size - 1]["n"]
    rank = F.lit(q) * total
    reached = F.transform(buckets, lambda b: b["n"] >= rank)
    at = F.array_position(reached, True).cast("int")
    this = F.try_element_at(buckets, at)
    last = F.when(at > 1, F.try_element_at(buckets, F.greatest(at - 1, F.lit(1))))
    start = F.coalesce(last["le"], F.lit(0.0))
    before = F.coalesce(last["n"], F.lit(0))
    inside = start + (this["le"] - start) * (rank - before) / (this["n"] - before)
    return F.when(total > 0, F.when(at == size, start).otherwise(inside))


def error_rate(requests: DataFrame, *by: Column | str) -> DataFrame:
    """Share of 5xx answers."""
    failed = F.count_if(F.col("status").between(500, 599))
    return requests.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"), (failed / F.count(F.lit(1))).alias("error_rate")
    )


# A bracket is looked at value by value once it holds at most this many rows, or after so many rounds; each
# leaves a few thousandths of the rows that are not equal to a bound.
BRACKET_ROWS = 100_000
MOST_ROUNDS = 5


def nearest_rank_percentile(
    df: DataFrame,
    value: str,
    percents: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = 1000,
    bracket_rows: int = BRACKET_ROWS,
) -> DataFrame:
    """Exact percentiles by nearest rank (half to even), without sorting a group.

    A sketch of the values gives two bounds around each wanted rank, so bounds follow the data. Counting the rows below
    and between them, exactly, tells where the rank lies; the bracket is drawn again from its own rows until few
    are left, and only those are ranked, counted per value. Null values are left out, NaN is the largest value, null is a group
    like any other.
    """
    group = [f"_g{i}" for i in range(len(by))] or ["_g0"]
    keys = [F.col(c).alias(g) for c, g in zip(by, group)] or [F.lit(0).alias("_g0")]
    v = F.col(value).cast("double")
    data = df.where(F.col(value).isNotNull()).select(*keys, F.when(~F.isnan(v), v).alias("_v"))

    def same(left: str) -> Column:
        return reduce(and_, [F.col(g).eqNullSafe(F.col(f"{left}{g}")) for g in group])

    def renamed(rows: DataFrame, prefix: str) -> DataFrame:
        return rows.withColumnsRenamed({g: f"{prefix}{g}" for g in group})

    # One row per group and percentile: small, and written, so that the planner sees its size.
    ranks = F.array(
        *[
            F.struct(F.lit(float(p)).alias("percent"), (F.bround(F.lit(p / 100.0) * (F.col("_n") - 1), 0) + 1).cast("long").alias("rank"))
            for p in percents
        ]
    )
    sizes = data.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.count("_v").alias("_known"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    sizes = sizes.withColumn("_r", F.explode(ranks)).select(*group, "_r.*", "_known", "lo", "hi")
    wanted = materialized(sizes.withColumn("inside", F.col("_known")), "value-ranks")
    is_nan = wanted.where(F.col("rank") > F.col("_known")).select(*group, "percent", F.lit(float("nan")).alias("_v"))
    brackets = wanted.where(F.col("rank") <= F.col("_known")).withColumn("below", F.lit(0).cast("long")).drop("_known")
    data = data.where(F.col("_v").isNotNull())

    def inside(brackets: DataFrame) -> DataFrame:
        return data.join(renamed(brackets, "_b"), same("_b") & F.col("_v").between(F.col("lo"), F.col("hi")))

    wide = (F.col("inside") > bracket_rows) & (F.col("lo") < F.col("hi"))
    for _ in range(MOST_ROUNDS):
        if brackets.where(wide).isEmpty():
            break
        share = (F.col("rank") - F.col("below")) / F.col("inside")
        near = F.array(*[F.least(F.greatest(F.round(share, 6) + step / accuracy, F.lit(0.0)), F.lit(1.0)) for step in (-2, 2)])
        # percentile_approx takes fixed shares only: a grid of them, of which each bracket picks its two.
        grid = [i / accuracy for i in range(accuracy + 1)]
        seen = inside(brackets.where(wide)).groupBy(*group, "percent").agg(F.percentile_approx("_v", grid, 10 * accuracy).alias("_grid"))
        picked = renamed(seen.withColumnRenamed("percent", "_percent"), "_s")
        drawn = brackets.where(wide).join(picked, same("_s") & (F.col("percent") == F.col("_percent")))
        at = lambda i, f: F.element_at("_grid", f(F.element_at(near, i) * accuracy).cast("int") + 1)
        drawn = drawn.select(*group, "percent", "rank", "below", "lo", "hi", "inside", at(1, F.floor).alias("a"), at(2, F.ceil).alias("b"))
        drawn = materialized(drawn, "value-bounds")
        rows = inside(drawn)
        counted = rows.groupBy(*group, "percent").agg(F.count_if(F.col("_v") < F.col("a")).alias("_less"), F.count_if(F.col("_v") <= F.col("b")).alias("_upto"))
        counted = renamed(counted.withColumnRenamed("percent", "_percent"), "_c")
        judged = drawn.join(counted, same("_c") & (F.col("percent") == F.col("_percent")))
        low, high = F.col("below") + F.col("_less"), F.col("below") + F.col("_upto")
        # The rank lies left of, inside or right of [a, b]; only the last two cases keep a as the lower bound.
        hit = (F.col("rank") > low) & (F.col("rank") <= high)
        left = F.col("rank") <= low
        drawn = judged.select(
            *group, "percent", "rank",
            F.when(hit | left, F.when(left, F.col("lo")).otherwise(F.col("a"))).otherwise(F.col("b")).alias("lo"),
            F.when(hit, F.col("b")).when(left, F.col("a")).otherwise(F.col("hi")).alias("hi"),
        )
        # Bounds are values that occur, so counts are taken again between the new ones.
        rows = data.join(renamed(drawn, "_b"), same("_b") & (F.col("_v") <= F.col("hi")))
        recount = rows.groupBy(*group, "percent").agg(F.count_if(F.col("_v") < F.col("lo")).alias("below"), F.count_if(F.col("_v") >= F.col("lo")).alias("inside"))
        recount = renamed(recount.withColumnRenamed("percent", "_percent"), "_c")
        drawn = drawn.join(recount, same("_c") & (F.col("percent") == F.col("_percent")))
        drawn = drawn.select(*group, "percent", "rank", "lo", "hi", "inside", "below")
        brackets = materialized(brackets.where(~wide).select(drawn.columns).union(drawn), "value-bounds")
    values = inside(brackets).groupBy(*group, "percent", "rank", "below", "_v").agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy(*group, "percent").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("below") + F.sum("_c").over(order)
    found = values.withColumn("_to", upto).where((F.col("rank") > F.col("_to") - F.col("_c")) & (F.col("rank") <= F.col("_to")))
    found = found.select(*group, "percent", "_v").union(is_nan)
    return found.select(*[F.col(g).alias(c) for c, g in zip(by, group)], "percent", F.col("_v").alias(value))


def token_cost() -> Column:
    """Price in USD of the summed token columns."""
    parts = [F.sum(kind) / 1_000_000 * price for kind, price in TOKEN_PRICES.items()]
    return sum(parts[1:], parts[0])


def token_usage_cost(usage: DataFrame, *by: Column | str) -> DataFrame:
    """Token sums and their price in USD."""
    sums = [F.sum(kind).alias(kind) for kind in TOKEN_PRICES]
    return usage.groupBy(*by).agg(*sums, token_cost().alias("estimated_cost_usd"))


# --- windowed rates and alerts -----------------------------------------------------------------


def window_of(length: str, step: str | None = None) -> Column:
    return F.window("ts", length, step)


def minute_requests(requests: DataFrame, *by: Column | str) -> DataFrame:
    """Requests per minute: what sliding windows are put together from, in streams as in batch."""
    return requests.groupBy(window_of("1 minute"), *by).agg(F.count(F.lit(1)).alias("n"))


def over_minutes(minutes: DataFrame, length: str, by: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Sums of minute counts over windows of ``length``, one per minute. Counts are copied to windows, log rows are not."""
    at = minutes.withColumn("ts", F.col("window.start")).drop("window")
    return at.groupBy(window_of(length, "1 minute"), *by).agg(*[F.sum(c).alias(c) for c in counts])


def request_rate(minutes: DataFrame, by: Sequence[str] = ("path",)) -> DataFrame:
    """Requests per second over the last five minutes, every minute, from minute counts."""
    return over_minutes(minutes, "5 minutes", by, ["n"]).withColumn("rate", F.col("n") / 300)


def sliding_request_rate(requests: DataFrame, by: Sequence[str] = ("path",)) -> DataFrame:
    """Requests per second over the last five minutes, every minute."""
    return request_rate(minute_requests(requests, *by), by)


def minute_answers(requests: DataFrame) -> DataFrame:
    return minute_requests(requests.where("path = '/answer'"), "client_id")


def answer_rate(minutes: DataFrame, limit: float = 5.0) -> DataFrame:
    return request_rate(minutes, ["client_id"]).withColumn("alert", F.col("rate") > limit)


def tenant_answer_rate(requests: DataFrame, limit: float = 5.0) -> DataFrame:
    """Answer rate per client over five minutes, with the alert on it."""
    return answer_rate(minute_answers(requests), limit)


def hourly_recommendations(requests: DataFrame) -> DataFrame:
    return recommendations_total(requests, window_of("1 hour"))


def minute_refusals(requests: DataFrame) -> DataFrame:
    return minute_requests(requests.where("status = 429"), "path")


def refusal_rate(minutes: DataFrame, limit: float = 1.0) -> DataFrame:
    rate = over_minutes(minutes, "10 minutes", ["path"], ["n"]).withColumn("rate", F.col("n") / 600)
    return rate.withColumn("alert", F.col("rate") > limit)


def rate_429_by_path(requests: DataFrame, limit: float = 1.0) -> DataFrame:
    """Rejected requests per second over ten minutes, with the alert on it."""
    return refusal_rate(minute_refusals(requests), limit)


def count_5xx_by_path(requests: DataFrame) -> DataFrame:
    failed = requests.where("status BETWEEN 500 AND 599")
    return failed.groupBy(window_of("1 hour"), "path").agg(F.count(F.lit(1)).alias("n"))


def held_for(evaluated: DataFrame, minutes: int) -> DataFrame:
    """Times at which a condition has held at every evaluation of the last ``minutes``.

    ``evaluated``: (at, value) of the minutely evaluations at which it holds. Each one is handed to
    the minutes it can support; a time supported by all of them fires. No run is ever sorted.
    """
    ahead = F.sequence(F.lit(0), F.lit(minutes))
    handed = evaluated.withColumn("ahead", F.explode(ahead)).withColumn(
        "at", F.timestamp_seconds(F.unix_timestamp("at") + F.col("ahead") * 60)
    )
    supported = handed.groupBy("at").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("ahead") == 0, F.col("value"))).alias("value")
    )
    return supported.where(F.col("n") == minutes + 1).select("at", "value")


def alert_high_error_rate(requests: DataFrame, limit: float = 0.05, minutes: int = 10) -> DataFrame:
    """5xx share of five minutes above the limit, evaluated every minute, held for ten."""
    failed = F.count_if(F.col("status").between(500, 599)).alias("failed")
    counted = requests.groupBy(window_of("1 minute")).agg(F.count(F.lit(1)).alias("n"), failed)
    rates = over_minutes(counted, "5 minutes", [], ["n", "failed"])
    rates = rates.select(F.col("window.end").alias("at"), (F.col("failed") / F.col("n")).alias("value"))
    return held_for(rates.where(F.col("value") > limit), minutes)


def alert_high_p95(
    requests: DataFrame, path: str = "/answer", limit: float = 0.8, minutes: int = 10
) -> DataFrame:
    """95th latency percentile of five minutes above the limit, held for ten."""
    counted = latency_counts(requests.where(F.col("path") == path), window_of("1 minute"))
    counts = [c for c in counted.columns if c not in ("window", "sum")]
    hist = as_buckets(over_minutes(counted, "5 minutes", [], counts))
    p95 = hist.select(
        F.col("window.end").alias("at"), histogram_quantile(F.col("buckets"), 0.95).alias("value")
    )
    return held_for(p95.where(F.col("value") > limit), minutes)


def alert_no_traffic(requests: DataFrame, limit: float = 0.01, minutes: int = 15) -> DataFrame:
    """Request rate of five minutes below the limit, held for fifteen; silent windows count as 0."""
    rates = sliding_request_rate(requests, []).select(F.col("window.end").alias("at"), "rate")
    first, last = F.date_trunc("minute", F.min("ts")), F.date_trunc("minute", F.max("ts"))
    minute = F.expr("interval 1 minute")
    grid = requests.agg((first + minute).alias("a"), (last + minute).alias("z")).select(
        F.explode(F.sequence("a", "z", minute)).alias("at")
    )
    value = F.coalesce("rate", F.lit(0.0))
    low = grid.join(rates, "at", "left").select("at", value.alias("value")).where(F.col("value") < limit)
    return held_for(low, minutes)
