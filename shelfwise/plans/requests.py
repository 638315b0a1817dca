"""Request log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed_values import LATENCY_BUCKETS, TOKEN_PRICES
from ..functions.clock import utc_day
from ..operators import requests as rq
from ..session import shared_dir
from ..sources import logs
from . import bindings as b
from .bindings import duck
from .registry import query

JUDGED = (
    "judged",
    """
    SELECT r.*, t.api_key, coalesce(t.max_requests_per_day, 1000) AS daily_limit,
      CASE WHEN r.client_id IS NULL THEN 400 WHEN t.client_id IS NULL THEN 401
           WHEN r.x_api_key IS NULL OR r.x_api_key <> t.api_key THEN 401 END AS auth_status,
      CASE WHEN r.client_id IS NULL THEN 'client_id is required'
           WHEN t.client_id IS NULL THEN concat('Unknown client_id: ', r.client_id)
           WHEN r.x_api_key IS NULL OR r.x_api_key <> t.api_key THEN 'Invalid API key' END AS auth_detail
    FROM requests r LEFT JOIN tenants t USING (client_id)""",
)
NUMBERED = (
    "numbered",
    """
    SELECT *, CAST(ts AS DATE) AS day,
           row_number() OVER (PARTITION BY client_id, CAST(ts AS DATE) ORDER BY ts, rid) AS n
    FROM judged WHERE auth_status IS NULL""",
)
USED = (
    "used_per_day",
    """SELECT client_id, day, count(*) FILTER (WHERE n <= daily_limit) AS used FROM numbered GROUP BY 1, 2""",
)
QUOTA_SQL = """
    SELECT rid, client_id, day, least(n, daily_limit) AS used, greatest(daily_limit - n, 0) AS remaining,
           n <= daily_limit AS admitted FROM numbered"""


def at(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


STAMP = "'%Y-%m-%d %H:%M:%S'"


@query(
    "classify_request_auth",
    duck("SELECT rid, auth_status, auth_detail FROM judged", JUDGED),
)
def classify_request_auth(spark, d):
    out = rq.classify_request_auth(b.requests(spark, d), b.tenants(spark, d))
    return out.select("rid", "auth_status", "auth_detail")


@query(
    "requests_with_tenant",
    duck("SELECT rid, client_id, api_key, daily_limit FROM judged", JUDGED),
)
def requests_with_tenant(spark, d):
    out = rq.requests_with_tenant(b.requests(spark, d), b.tenants(spark, d))
    return out.select("rid", "client_id", "api_key", F.col("daily_limit").cast("long").alias("daily_limit"))


def authorised(spark, d):
    return rq.authorised(b.requests(spark, d), b.tenants(spark, d))


@query("quota_running_usage", duck(QUOTA_SQL, JUDGED, NUMBERED))
def quota_running_usage(spark, d):
    out = rq.quota_running_usage(authorised(spark, d))
    return out.select("rid", "client_id", "day", "used", "remaining", "admitted")


@query("daily_usage", duck("SELECT client_id, day, used FROM used_per_day", JUDGED, NUMBERED, USED))
def daily_usage(spark, d):
    return rq.daily_usage(authorised(spark, d))


@query(
    "quota_state_upsert",
    duck("""
    SELECT client_id, day, CASE WHEN day >= DATE '2024-01-10' THEN used ELSE used + 100 END AS used
    FROM used_per_day
    UNION ALL
    SELECT DISTINCT 'gone', day, CAST(7 AS BIGINT) FROM used_per_day""", JUDGED, NUMBERED, USED),
)
def quota_state_upsert(spark, d):
    """A table with outdated counts and a client that is gone; later days are recomputed."""
    path = shared_dir(spark, "quota")
    usage = rq.daily_usage(authorised(spark, d))
    gone = usage.select(F.lit("gone").alias("client_id"), "day", F.lit(7).cast("long").alias("used")).distinct()
    logs.quota_state_upsert(usage.withColumn("used", F.col("used") + 100).unionByName(gone), path)
    logs.quota_state_upsert(usage.where("day >= DATE '2024-01-10'"), path)
    return logs.read_quota(spark, path)


@query("utc_day", "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events")
def utc_day_query(spark, d):
    ts = F.col("ts").cast("timestamp")
    return b.table(spark, d, "events").select("event_id", utc_day(ts).cast("string").alias("day"))


LOG_SQL = """
    SELECT rid, CAST(rid AS VARCHAR) AS log_rid, round(epoch_us(ts) / 1000000.0, 3) AS ts,
           coalesce(client_id, 'n/a') AS client_id, method, path, status, latency_ms,
           CASE WHEN status = 200 THEN 40 END AS quota_limit,
           CASE WHEN status = 200 THEN CASE WHEN path = '/greet' THEN 0 ELSE latency_ms % 40 END END AS quota_remaining
    FROM requests"""


def log_rows(spark, d):
    served = F.col("status") == 200
    rows = b.requests(spark, d).withColumns(
        {
            "rate_limit": F.when(served, 40),
            "rate_remaining": F.when(served & (F.col("path") == "/answer"), F.col("latency_ms") % 40),
        }
    )
    return rq.access_log_row(rows)


def flat_log(log):
    return log.select(
        F.col("rid").cast("long").alias("rid"),
        F.col("rid").alias("log_rid"),
        F.round("ts", 3).alias("ts"),
        "client_id", "method", "path", "status", "latency_ms",
        F.col("rate_limit.limit").alias("quota_limit"),
        F.col("rate_limit.remaining").alias("quota_remaining"),
    )


@query("access_log_row", duck(LOG_SQL))
def access_log_row(spark, d):
    return flat_log(log_rows(spark, d))


@query("write_access_log", duck(LOG_SQL + " WHERE client_id IS NOT NULL"))
def write_access_log(spark, d):
    path = shared_dir(spark, "access-log")
    log = log_rows(spark, d)
    answered = F.col("path") == "/answer"
    logs.write_access_log(log.where(answered), path)
    logs.write_access_log(log.where(~answered), path)
    return flat_log(logs.read_access_log(spark, path))


@query(
    "read_access_log",
    duck("""
    SELECT client_id, method, path, status, CASE WHEN client_id IS NULL THEN concat('broken line ', rid) END AS corrupt
    FROM requests"""),
)
def read_access_log(spark, d):
    """Log lines as text, some of them cut off; those are kept apart, not lost."""
    path = shared_dir(spark, "log-lines")
    rows = b.requests(spark, d)
    line = F.to_json(F.struct("client_id", "method", "path", "status"))
    broken = F.concat(F.lit("broken line "), F.col("rid").cast("string"))
    rows.select(F.when(F.col("client_id").isNull(), broken).otherwise(line).alias("value")).write.text(path)
    back = logs.read_access_log(spark, path)
    whole = F.col(logs.CORRUPT).isNull()
    kept = F.regexp_extract(logs.CORRUPT, r"broken line (\d+)", 1).cast("long")
    asked = rows.where("client_id IS NULL").select(
        F.col("rid").alias("_rid"), F.col("method").alias("_m"), F.col("path").alias("_p"), F.col("status").alias("_s")
    )
    joined = back.withColumn("_rid", F.when(~whole, kept)).join(asked, "_rid", "left")
    return joined.select(
        "client_id",
        F.coalesce("method", "_m").alias("method"),
        F.coalesce("path", "_p").alias("path"),
        F.coalesce("status", "_s").alias("status"),
        F.col(logs.CORRUPT).alias("corrupt"),
    )


@query(
    "http_requests_total",
    duck("SELECT method, path, status, count(*) AS total FROM requests GROUP BY ALL"),
)
def http_requests_total(spark, d):
    return rq.http_requests_total(b.requests(spark, d))


@query(
    "recommendations_total",
    duck("SELECT client_id, count(*) AS total FROM requests WHERE path = '/answer' AND status = 200 GROUP BY 1"),
)
def recommendations_total(spark, d):
    return rq.recommendations_total(b.requests(spark, d))


def bound_sql(le: float) -> str:
    return "CAST('Infinity' AS DOUBLE)" if le == float("inf") else f"CAST({le} AS DOUBLE)"


BOUNDS = "(SELECT unnest([" + ", ".join(map(bound_sql, LATENCY_BUCKETS)) + "]) AS le)"


@query(
    "latency_histogram",
    duck(f"""
    SELECT method, path, CAST(le AS VARCHAR) AS le, count(*) FILTER (WHERE latency_ms / 1000.0 <= le) AS n,
           round(sum(latency_ms) / 1000.0, 6) AS sum, count(*) AS count
    FROM requests, {BOUNDS} GROUP BY ALL""").replace("CAST(le AS VARCHAR) AS le", "CASE WHEN le = CAST('Infinity' AS DOUBLE) THEN -1 ELSE le END AS le"),
)
def latency_histogram(spark, d):
    out = rq.latency_histogram(b.requests(spark, d))
    # The open bucket is shown as -1: infinities do not survive every comparison.
    le = F.when(F.col("le") == float("inf"), -1.0).otherwise(F.col("le"))
    return out.withColumns({"le": le, "sum": F.round("sum", 6)})


def quantile_sql(group: str, source: str, q: float) -> str:
    """First bucket that reaches the rank, by joins over bucket rows."""
    return f"""
    SELECT {group}, CASE WHEN le = CAST('Infinity' AS DOUBLE) THEN before_le
             ELSE before_le + (le - before_le) * ({q} * total - before_n) / (n - before_n) END AS value
    FROM (SELECT *, coalesce(lag(le) OVER w, 0.0) AS before_le, coalesce(lag(n) OVER w, 0) AS before_n,
                 max(n) OVER (PARTITION BY {group}) AS total
          FROM (SELECT {group}, le, count(*) FILTER (WHERE latency_ms / 1000.0 <= le) AS n
                FROM {source}, {BOUNDS} GROUP BY ALL)
          WINDOW w AS (PARTITION BY {group} ORDER BY le))
    WHERE n >= {q} * total QUALIFY row_number() OVER (PARTITION BY {group} ORDER BY le) = 1"""


@query(
    "histogram_quantile",
    duck(f"SELECT path, round(value, 6) AS p95 FROM ({quantile_sql('path', 'requests', 0.95)})"),
)
def histogram_quantile(spark, d):
    hist = rq.latency_buckets(b.requests(spark, d), "path")
    return hist.select("path", F.round(rq.histogram_quantile(F.col("buckets"), 0.95), 6).alias("p95"))


@query(
    "error_rate_5xx",
    duck(f"""
    SELECT strftime(time_bucket(INTERVAL 5 MINUTES, ts), {STAMP}) AS window_start, count(*) AS requests,
           round(count(*) FILTER (WHERE status >= 500) / count(*), 6) AS error_rate
    FROM requests GROUP BY 1"""),
)
def error_rate_5xx(spark, d):
    out = rq.error_rate(b.requests(spark, d), rq.window_of("5 minutes"))
    return out.select(at("window.start").alias("window_start"), "requests", F.round("error_rate", 6).alias("error_rate"))


RANK_SQL = """
    SELECT event_type, CAST(p AS DOUBLE) AS percent, value
    FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r,
                 count(*) OVER (PARTITION BY event_type) AS n FROM events),
         (SELECT unnest([0, 50, 95, 100]) AS p)
    WHERE r = round_even(p / 100.0 * (n - 1), 0) + 1"""


@query("nearest_rank_percentile", RANK_SQL)
def nearest_rank_percentile(spark, d):
    return rq.nearest_rank_percentile(b.table(spark, d, "events"), "value", [0, 50, 95, 100], ["event_type"])


PRICED = " + ".join(f"sum({k}) / 1000000.0 * {p}" for k, p in TOKEN_PRICES.items())


@query(
    "token_usage_cost",
    duck(f"""
    SELECT client_id, day, {', '.join(f'CAST(sum({k}) AS BIGINT) AS {k}' for k in TOKEN_PRICES)},
           round(CAST({PRICED} AS DOUBLE), 9) AS estimated_cost_usd FROM usage GROUP BY 1, 2"""),
)
def token_usage_cost(spark, d):
    out = rq.token_usage_cost(b.usage(spark, d), "client_id", "day")
    return out.withColumn("estimated_cost_usd", F.round("estimated_cost_usd", 9))


# --- windowed rates and alerts, in batch ----------------------------------------------------------

MINUTELY = (
    "minutely",
    "SELECT r.*, date_trunc('minute', ts) - INTERVAL 1 MINUTE * i AS start "
    "FROM requests r, (SELECT unnest(range(0, 5)) AS i)",
)


def held_sql(evaluated: str, minutes: int) -> str:
    """Times whose last evaluations all hold, by a self-join on the minutes before."""
    return f"""
    WITH_EVALUATED AS ({evaluated})
    SELECT strftime(e.at, {STAMP}) AS at, round(e.value, 6) AS value
    FROM WITH_EVALUATED e JOIN WITH_EVALUATED p
      ON p.at BETWEEN e.at - INTERVAL {minutes} MINUTES AND e.at
    GROUP BY e.at, e.value HAVING count(*) = {minutes + 1}"""


def alert_sql(evaluated: str, minutes: int) -> str:
    body = held_sql(evaluated, minutes)
    head, tail = body.split(")\n    SELECT strftime", 1)
    return duck("SELECT strftime" + tail, MINUTELY, ("WITH_EVALUATED", head.split("AS (", 1)[1]))


def fired(df):
    return df.select(at("at").alias("at"), F.round("value", 6).alias("value"))


@query(
    "alert_high_error_rate",
    alert_sql(
        """SELECT start + INTERVAL 5 MINUTES AS at, count(*) FILTER (WHERE status >= 500) / count(*) AS value
           FROM minutely GROUP BY 1 HAVING count(*) FILTER (WHERE status >= 500) / count(*) > 0.05""",
        10,
    ),
)
def alert_high_error_rate(spark, d):
    return fired(rq.alert_high_error_rate(b.requests(spark, d)))


@query(
    "alert_high_p95",
    alert_sql(
        f"""SELECT start + INTERVAL 5 MINUTES AS at, value FROM ({quantile_sql('start', "(SELECT * FROM minutely WHERE path = '/answer')", 0.95)})
            WHERE value > 0.8""",
        10,
    ),
)
def alert_high_p95(spark, d):
    return fired(rq.alert_high_p95(b.requests(spark, d)))


@query(
    "alert_no_traffic",
    alert_sql(
        """SELECT g.at, coalesce(n, 0) / 300.0 AS value
           FROM (SELECT unnest(generate_series(date_trunc('minute', min(ts)) + INTERVAL 1 MINUTE,
                        date_trunc('minute', max(ts)) + INTERVAL 1 MINUTE, INTERVAL 1 MINUTE)) AS at FROM requests) g
           LEFT JOIN (SELECT start + INTERVAL 5 MINUTES AS at, count(*) AS n FROM minutely GROUP BY 1) c ON c.at = g.at
           WHERE coalesce(n, 0) / 300.0 < 0.01""",
        15,
    ),
)
def alert_no_traffic(spark, d):
    return fired(rq.alert_no_traffic(b.requests(spark, d)))
