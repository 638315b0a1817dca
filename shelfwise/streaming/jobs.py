"""The request log and the message flow as Structured Streaming jobs.

Windowed jobs are the batch expressions of ``operators.requests`` on a watermarked stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import DEFAULT_TOP_K
from ..operators import requests as rq
from ..operators.compose import cards_and_sources
from ..operators.retrieval import retrieve_prefilter
from ..session import materialized
from ..sources.logs import client_rows
from .sinks import read_batches, run_batches
from .values import BATCH, SNAPSHOT_EVERY, Values

LATENESS = "10 minutes"
QUOTA_LATENESS_DAYS = 1


def watermarked(requests: DataFrame, delay: str = LATENESS) -> DataFrame:
    """Rows older than the newest one by more than ``delay`` may be dropped."""
    return requests.withWatermark("ts", delay)


def request_metrics(requests: DataFrame) -> DataFrame:
    """Counts and latency buckets per five minutes, method, path and status."""
    by = [rq.window_of("5 minutes"), "method", "path", "status"]
    return rq.latency_buckets(watermarked(requests), *by)


ADMITTED = "rid long, client_id string, day date, used long, remaining long, admitted boolean"
COUNTED = "client_id string, day date, total long"


def quota_counters(spark: SparkSession, out: str, every: int = SNAPSHOT_EVERY) -> Values:
    """Requests counted so far per client and UTC day."""
    return Values(spark, f"{out}/counters", T._parse_datatype_string(COUNTED), ["client_id", "day"], every)


def admit_batch(batch: DataFrame, batch_id: int, tenants: DataFrame, counters: Values) -> DataFrame:
    """Admission of one micro-batch's requests, numbered after those that earlier batches counted.

    Numbering is that of the batch job: counts per client, day and minute first, then places inside a minute, so a client
    with a third of all rows is many tasks. Counters are joined to the minutes, not to rows, and written for the clients of this batch only.
    """
    narrow = ["rid", "client_id", "day", "ts", "daily_limit"]
    rows = materialized(rq.authorised(batch, tenants).select(*narrow), "authorised")
    sums = rows.groupBy("client_id", "day").agg(F.count("*").alias("n"))
    counted = counters.current(before=batch_id).join(sums.select("client_id", "day"), ["client_id", "day"], "left_semi")
    counted = materialized(counted.select("client_id", "day", "total"), "counted")
    total = (F.col("n") + F.coalesce("total", F.lit(0))).alias("total")
    counters.put(batch_id, sums.join(counted, ["client_id", "day"], "left").select("client_id", "day", total))
    admitted = rq.quota_running_usage(rows, counted=counted)
    return admitted.select(*T._parse_datatype_string(ADMITTED).names)


def run_quota(requests: DataFrame, tenants: DataFrame, out: str, every: int = SNAPSHOT_EVERY) -> DataFrame:
    """Daily quota over all available input: every authorised request with its number and whether it is admitted.

    Inside a micro-batch a client's requests are taken in (ts, rid) order, across micro-batches in order of arrival. A
    late request still counts on its own day; counters are forgotten ``QUOTA_LATENESS_DAYS`` after their day, at the next snapshot, and
    a request later than that is counted anew. A replayed micro-batch starts from the counters before it and
    replaces its own counters and rows.
    """
    spark = requests.sparkSession
    counters = quota_counters(spark, out, every)

    def admit(batch: DataFrame, batch_id: int) -> DataFrame:
        newest = counters.current(before=batch_id).agg(F.max("day")).head()[0]
        if newest is not None:
            counters.snapshot(batch_id, F.col("day") >= F.date_sub(F.lit(newest), QUOTA_LATENESS_DAYS + 1))
        return admit_batch(batch, batch_id, tenants, counters)

    run_batches(requests, out, admit)
    return read_batches(spark, out, T._parse_datatype_string(ADMITTED)).drop(BATCH)


def access_log_sink(log: DataFrame, path: str, checkpoint: str):
    """Log records to JSON files below one folder per client; returns the running query.

    The rows of a client are dealt to one task of a micro-batch: a file per client and batch, not one per client and task.
    """
    return (
        client_rows(log)
        .repartition("client")
        .writeStream.partitionBy("client")
        .format("json")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def answer_batch(messages: DataFrame, products: DataFrame, k: int = DEFAULT_TOP_K) -> DataFrame:
    """Cards and sources for the messages of one micro-batch against the static catalog."""
    hits = retrieve_prefilter(messages, products, k)
    tagged = hits.join(messages.select("msg_id", "tenant_id"), "msg_id")
    return cards_and_sources(tagged, products)
