"""Streams fed in several micro-batches against the batch answer over all rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.operators import requests as rq
from shelfwise.session import shared_dir
from shelfwise.streaming import jobs, sinks
from shelfwise.streaming.values import Values

DAY = dt.datetime(2024, 3, 1)
SCHEMA = "rid long, client_id string, x_api_key string, ts timestamp, method string, path string, status int, latency_ms int"


@pytest.fixture(scope="module")
def fed(spark, tmp_path_factory):
    """Requests of two days in four files, in time order."""
    folder = str(tmp_path_factory.mktemp("requests"))
    rows = [
        (i, "hot" if i % 3 else f"c{i % 5}", "k", DAY + dt.timedelta(minutes=7 * i), "GET", ["/answer", "/greet"][i % 2],
         [200, 500, 429][i % 3], i * 10)
        for i in range(240)
    ]
    whole = spark.createDataFrame(rows, SCHEMA)
    for part in range(4):
        one = whole.where((F.col("rid") >= part * 60) & (F.col("rid") < part * 60 + 60))
        one.coalesce(1).write.mode("append").parquet(folder)
    tenants = spark.createDataFrame([("hot", "k", 100)] + [(f"c{i}", "k", i) for i in range(5)], "client_id string, api_key string, max_requests_per_day int")
    return folder, whole, tenants


def stream(spark, fed):
    return sinks.read_stream(spark, fed[0], fed[1], "*.parquet", maxFilesPerTrigger="1")


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_quota_counters_equal_batch(spark, fed):
    out = shared_dir(spark, "quota-test")
    got = jobs.run_quota(stream(spark, fed), fed[2], out)
    columns = ["rid", "client_id", "day", "used", "remaining", "admitted"]
    batch = rq.quota_running_usage(rq.authorised(fed[1], fed[2]))
    assert rows_of(got, *columns) == rows_of(batch, *columns)
    assert batch.where("NOT admitted").count() > 0
    totals = jobs.quota_counters(spark, out).current()
    assert rows_of(totals, "client_id", "day", "total") == rows_of(batch.groupBy("client_id", "day").count(), "client_id", "day", "count")


def test_a_hot_client_over_eight_batches(spark, tmp_path):
    """A client with most rows, snapshots on the way, and a run that stops in the middle of a batch and replays it."""
    rows = [(i, "hot" if i % 5 else f"c{i % 3}", "k", DAY + dt.timedelta(seconds=400 * i), "GET", "/answer", 200, 1) for i in range(400)]
    whole = spark.createDataFrame(rows, SCHEMA)
    for part in range(8):
        whole.where(f"rid >= {part * 50} and rid < {part * 50 + 50}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    tenants = spark.createDataFrame([("hot", "k", 120), ("c0", "k", 20), ("c1", "k", 0), ("c2", "k", None)], "client_id string, api_key string, max_requests_per_day int")
    source = lambda: sinks.read_stream(spark, str(tmp_path / "in"), whole, "*.parquet", maxFilesPerTrigger="1")
    out = shared_dir(spark, "hot-test")
    put, calls = jobs.Values.put, []

    def stops(self, batch_id, changed):
        put(self, batch_id, changed)
        calls.append(batch_id)
        if batch_id == 5 and calls.count(5) == 1:
            raise RuntimeError("stopped after the counters, before the rows")

    jobs.Values.put = stops
    try:
        with pytest.raises(Exception, match="stopped after"):
            jobs.run_quota(source(), tenants, out, every=3)
        got = jobs.run_quota(source(), tenants, out, every=3)
    finally:
        jobs.Values.put = put
    assert calls == [0, 1, 2, 3, 4, 5, 5, 6, 7]
    columns = ["rid", "client_id", "day", "used", "remaining", "admitted"]
    batch = rq.quota_running_usage(rq.authorised(whole, tenants))
    assert rows_of(got, *columns) == rows_of(batch, *columns)
    counters = jobs.quota_counters(spark, out, 3)
    assert counters.pointed()[1] >= 2
    changed = spark.read.parquet(f"{out}/counters/rows/batch_id=7")
    assert changed.count() == whole.where("rid >= 350").select("client_id", F.to_date("ts")).distinct().count()


def test_a_stop_between_snapshot_and_pointer(spark, tmp_path):
    values = Values(spark, f"file://{tmp_path}/v", T._parse_datatype_string("k string, v long"), ["k"], every=2)
    batch = lambda **kv: spark.createDataFrame(list(kv.items()), "k string, v long")
    now = lambda: dict((r["k"], r["v"]) for r in values.current().collect())
    assert now() == {}
    values.put(0, batch(a=1, b=1))
    values.put(1, batch(a=2))
    point, values.point_to = values.point_to, lambda name: (_ for _ in ()).throw(RuntimeError("stopped"))
    with pytest.raises(RuntimeError):
        values.snapshot(2)
    values.point_to = point
    assert values.pointed() == (None, -1) and now() == {"a": 2, "b": 1}
    assert values.snapshot(2) and values.pointed()[1] == 1
    values.put(2, batch(b=9, c=1))
    values.put(2, batch(b=3, c=3))  # a replay
    assert now() == {"a": 2, "b": 3, "c": 3}
    assert {r["k"]: r["v"] for r in values.current(before=2).collect()} == {"a": 2, "b": 1}
    assert not values.snapshot(3)
    values.put(3, batch(a=7))
    assert values.snapshot(4, F.col("k") != "b") and now() == {"a": 7, "c": 3}
    tail = values._changes(values.pointed()[1], None)
    assert tail.count() == 0, "what a snapshot holds is not read again"


def test_windowed_counts_equal_batch(spark, fed):
    for job, keys in [
        (jobs.request_metrics, ["window", "method", "path", "status"]),
        (lambda df: rq.minute_requests(jobs.watermarked(df), "path"), ["window", "path"]),
        (lambda df: rq.count_5xx_by_path(jobs.watermarked(df)), ["window", "path"]),
        (lambda df: rq.hourly_recommendations(jobs.watermarked(df)), ["window", "client_id"]),
    ]:
        out = shared_dir(spark, "window-test")
        now = sinks.aggregate_to_end(job(stream(spark, fed)), out, keys)
        batch = job(fed[1])
        assert rows_of(now, *batch.columns) == rows_of(batch, *batch.columns)
        batches = spark.read.parquet(f"{out}/rows").select(sinks.BATCH).distinct().count()
        assert batches >= 3


def test_streamed_minutes_give_the_sliding_rate(spark, fed):
    out = shared_dir(spark, "minute-test")
    now = sinks.aggregate_to_end(rq.minute_requests(jobs.watermarked(stream(spark, fed)), "path"), out, ["window", "path"])
    batch = rq.sliding_request_rate(fed[1])
    assert rows_of(rq.request_rate(now), *batch.columns) == rows_of(batch, *batch.columns)
    plan = batch._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.rindex("Aggregate"), "log rows are counted before they are copied to windows"


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    for minute, rid in [(0, 1), (600, 2), (700, 3), (1, 4)]:
        row = [(rid, "a", "k", DAY + dt.timedelta(minutes=minute), "GET", "/x", 200, 1)]
        spark.createDataFrame(row, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "late"))
    like = spark.createDataFrame([], SCHEMA)
    source = sinks.read_stream(spark, str(tmp_path / "late"), like, "*.parquet", maxFilesPerTrigger="1")
    out = shared_dir(spark, "late-test")
    now = sinks.aggregate_to_end(rq.count_5xx_by_path(jobs.watermarked(source.withColumn("status", F.lit(500)))), out, ["window", "path"])
    assert sum(r["n"] for r in now.collect()) == 3


def test_log_stream_writes_a_file_per_client_and_batch(spark, tmp_path):
    """However many tasks read a micro-batch, a client's rows are one file of it."""
    rows = spark.range(400).selectExpr("cast(id as string) AS rid", "concat('c', id % 5) AS client_id")
    rows.repartition(8).write.parquet(str(tmp_path / "in"))
    stream = sinks.read_stream(spark, str(tmp_path / "in"), rows, "*.parquet")
    jobs.access_log_sink(stream, str(tmp_path / "log"), str(tmp_path / "state")).awaitTermination()
    files = [f for f in (tmp_path / "log").glob("client=*/*.json")]
    assert sorted(f.parent.name for f in files) == [f"client=c{i}" for i in range(5)]
    assert sum(len(f.read_text().splitlines()) for f in files) == 400
