"""Streaming queries: run over all input, then compared with the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vector import hash_embedding
from ..operators import requests as rq
from ..operators.candidates import with_intent
from ..session import shared_dir
from ..sources import logs
from ..streaming import jobs, sinks
from . import bindings as b
from .bindings import DIM, TOP_K, duck
from .compose import SERVED
from .registry import query
from .requests import JUDGED, LOG_SQL, NUMBERED, QUOTA_SQL, STAMP, at, flat_log

ANSWERED_STATUS = 200


def request_stream(spark, d):
    events = b.table(spark, d, "events")
    return b.requests_of(sinks.read_stream(spark, d, events, "events.parquet"))


def arriving_requests(spark, d, batches):
    """The requests as files that arrive one after the other, in order of time, each a micro-batch."""
    events = b.table(spark, d, "events")
    folder = shared_dir(spark, "arriving")
    shares = [i / batches for i in range(1, batches)]
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = events.agg(F.percentile_approx(micros, F.array(*map(F.lit, shares)), F.lit(1000))).head()[0] or []
    for low, high in zip([None, *cuts], [*cuts, None]):
        some = F.lit(True) if low is None else micros > low
        some = some if high is None else some & (micros <= high)
        events.where(some).coalesce(1).write.mode("append").parquet(folder)
    return b.requests_of(sinks.read_stream(spark, folder, events, "*.parquet", maxFilesPerTrigger="1"))


def run(spark, stream, name, keys):
    return sinks.aggregate_to_end(stream, shared_dir(spark, name), keys)


@query("stream_quota_admission", duck(QUOTA_SQL, JUDGED, NUMBERED))
def stream_quota_admission(spark, d):
    """In three micro-batches, so that most numbers continue from counters of earlier ones."""
    out = shared_dir(spark, "quota-stream")
    return jobs.run_quota(arriving_requests(spark, d, 3), b.tenants(spark, d), out)


@query(
    "stream_request_metrics",
    duck(f"""
    SELECT strftime(time_bucket(INTERVAL 5 MINUTES, ts), {STAMP}) AS window_start, method, path, status,
           count(*) AS count, round(sum(latency_ms) / 1000.0, 6) AS sum,
           count(*) FILTER (WHERE latency_ms <= 500) AS within_500ms,
           count(*) FILTER (WHERE path = '/answer' AND status = 200) AS recommendations
    FROM requests GROUP BY 1, 2, 3, 4"""),
)
def stream_request_metrics(spark, d):
    stream = jobs.request_metrics(request_stream(spark, d))
    now = run(spark, stream, "metrics-stream", ["window", "method", "path", "status"])
    half = F.filter("buckets", lambda e: e["le"] == 0.5)[0]["n"]
    given = (F.col("path") == "/answer") & (F.col("status") == ANSWERED_STATUS)
    return now.select(
        at("window.start").alias("window_start"), "method", "path", "status", "count",
        F.round("sum", 6).alias("sum"), half.alias("within_500ms"),
        F.when(given, F.col("count")).otherwise(0).alias("recommendations"),
    )


@query("stream_access_log_sink", duck(LOG_SQL + " WHERE client_id IS NOT NULL"))
def stream_access_log_sink(spark, d):
    out = shared_dir(spark, "log-stream")
    served = F.col("status") == ANSWERED_STATUS
    rows = request_stream(spark, d).withColumns(
        {
            "rate_limit": F.when(served, 40),
            "rate_remaining": F.when(served & (F.col("path") == "/answer"), F.col("latency_ms") % 40),
        }
    )
    jobs.access_log_sink(rq.access_log_row(rows), f"{out}/log", f"{out}/state").awaitTermination()
    return flat_log(logs.read_access_log(spark, f"{out}/log"))


def sliding_sql(length: int, where: str, group: str) -> str:
    """Counts per sliding window of ``length`` minutes, one per minute."""
    return f"""
    SELECT strftime(date_trunc('minute', ts) - INTERVAL 1 MINUTE * i, {STAMP}) AS window_start, {group}, count(*) AS n
    FROM requests, (SELECT unnest(range(0, {length})) AS i) WHERE {where} GROUP BY 1, 2"""


@query(
    "sliding_request_rate",
    duck(f"SELECT *, round(n / 300.0, 6) AS rate FROM ({sliding_sql(5, 'true', 'path')})"),
)
def sliding_request_rate(spark, d):
    minutes = rq.minute_requests(jobs.watermarked(request_stream(spark, d)), "path")
    now = rq.request_rate(run(spark, minutes, "rate-stream", ["window", "path"]))
    return now.select(at("window.start").alias("window_start"), "path", "n", F.round("rate", 6).alias("rate"))


@query(
    "hourly_recommendations",
    duck(f"""
    SELECT strftime(date_trunc('hour', ts), {STAMP}) AS window_start, client_id, count(*) AS total
    FROM requests WHERE path = '/answer' AND status = 200 GROUP BY 1, 2"""),
)
def hourly_recommendations(spark, d):
    stream = rq.hourly_recommendations(jobs.watermarked(request_stream(spark, d)))
    now = run(spark, stream, "recommendation-stream", ["window", "client_id"])
    return now.select(at("window.start").alias("window_start"), "client_id", "total")


@query(
    "rate_429_by_path",
    duck(f"SELECT *, round(n / 600.0, 6) AS rate, n / 600.0 > 1 AS alert FROM ({sliding_sql(10, 'status = 429', 'path')})"),
)
def rate_429_by_path(spark, d):
    minutes = rq.minute_refusals(jobs.watermarked(request_stream(spark, d)))
    now = rq.refusal_rate(run(spark, minutes, "refused-stream", ["window", "path"]))
    return now.select(at("window.start").alias("window_start"), "path", "n", F.round("rate", 6).alias("rate"), "alert")


@query(
    "count_5xx_by_path",
    duck(f"""
    SELECT strftime(date_trunc('hour', ts), {STAMP}) AS window_start, path, count(*) AS n
    FROM requests WHERE status >= 500 GROUP BY 1, 2"""),
)
def count_5xx_by_path(spark, d):
    stream = rq.count_5xx_by_path(jobs.watermarked(request_stream(spark, d)))
    now = run(spark, stream, "failure-stream", ["window", "path"])
    return now.select(at("window.start").alias("window_start"), "path", "n")


@query(
    "tenant_answer_rate",
    duck("SELECT *, round(n / 300.0, 6) AS rate, n / 300.0 > 5 AS alert FROM ("
         + sliding_sql(5, "path = '/answer'", "client_id") + ")"),
)
def tenant_answer_rate(spark, d):
    minutes = rq.minute_answers(jobs.watermarked(request_stream(spark, d)))
    now = rq.answer_rate(run(spark, minutes, "answer-stream", ["window", "client_id"]))
    return now.select(at("window.start").alias("window_start"), "client_id", "n", F.round("rate", 6).alias("rate"), "alert")


@query("stream_retrieve", duck("SELECT msg_id, cards_json, sources FROM served", SERVED))
def stream_retrieve(spark, d):
    """Messages arrive as a stream and are answered per micro-batch."""
    out = shared_dir(spark, "answer-stream")
    part = b.table(spark, d, "part")
    arriving = b.message_text_of(sinks.read_stream(spark, d, part, "part.parquet"))
    products = b.catalog_vec(spark, d)
    known = b.patterns(spark, d)

    def answer(batch, batch_id):
        messages = with_intent(batch, known).withColumn("vec", hash_embedding(F.col("message"), DIM))
        served = jobs.answer_batch(messages, products, TOP_K)
        return served.withColumn("sources", F.array_join("sources", "|"))

    sinks.run_batches(arriving, out, answer)
    answers = spark.read.schema("msg_id long, cards_json string, sources string").parquet(f"{out}/rows")
    return answers.drop(sinks.BATCH)
