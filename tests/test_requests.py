import datetime as dt
import gzip
import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import requests as rq
from shelfwise.sources import client_files, logs

DAY = dt.datetime(2024, 3, 1)


def log(spark, rows):
    return spark.createDataFrame(rows, "rid long, client_id string, x_api_key string, ts timestamp, method string, path string, status int, latency_ms int")


def request(rid, client="a", key="k", seconds=0, path="/answer", status=200, ms=100):
    return (rid, client, key, DAY + dt.timedelta(seconds=seconds), "POST", path, status, ms)


@pytest.fixture(scope="module")
def tenants(spark):
    return spark.createDataFrame([("a", "k", 2), ("b", "k", None), ("z", "k", 0)], "client_id string, api_key string, max_requests_per_day int")


def test_auth_order(spark, tenants):
    rows = [request(1, None), request(2, ""), request(3, "x"), request(4, "a", None), request(5, "a", ""), request(6, "a", "bad"), request(7, "a")]
    out = {r["rid"]: (r["auth_status"], r["auth_detail"]) for r in rq.classify_request_auth(log(spark, rows), tenants).collect()}
    assert [out[i][0] for i in range(1, 8)] == [400, 400, 401, 401, 401, 401, None]
    assert out[3][1] == "Unknown client_id: x" and out[6][1] == "Invalid API key" and out[7][1] is None


def test_two_admitted_then_refused(spark, tenants):
    rows = [request(i, seconds=i * 40) for i in (3, 1, 2)] + [request(9, "z"), request(8, "b"), request(7, "a", "bad"), request(10, "a", seconds=90_000)]
    passed = rq.authorised(log(spark, rows), tenants)
    out = {r["rid"]: (r["used"], r["remaining"], r["admitted"]) for r in rq.quota_running_usage(passed).collect()}
    assert out == {1: (1, 1, True), 2: (2, 0, True), 3: (2, 0, False), 9: (0, 0, False), 8: (1, 999, True), 10: (1, 1, True)}
    used = {(r["client_id"], r["day"].day): r["used"] for r in rq.daily_usage(passed).collect()}
    assert used == {("a", 1): 2, ("z", 1): 0, ("b", 1): 1, ("a", 2): 1}


@pytest.mark.parametrize("slot", [1, 60, 7200])
def test_quota_numbers_a_hot_client(spark, slot):
    rng = np.random.default_rng(1)
    rows = [request(i, "a" if i % 3 else f"c{i}", seconds=int(rng.integers(0, 5000))) for i in range(400)]
    many = spark.createDataFrame([("a", "k", 150)] + [(f"c{i}", "k", 1) for i in range(400)], "client_id string, api_key string, max_requests_per_day int")
    out = rq.quota_running_usage(rq.authorised(log(spark, rows), many), slot_seconds=slot).where("client_id = 'a'")
    got = [(r["rid"], r["used"], r["admitted"]) for r in out.orderBy("ts", "rid").collect()]
    own = sorted((r for r in rows if r[1] == "a"), key=lambda r: (r[3], r[0]))
    assert got == [(r[0], min(n, 150), n <= 150) for n, r in enumerate(own, 1)]


def nearest(values, p):
    ordered = sorted(values)
    return ordered[min(len(ordered) - 1, round(p / 100 * (len(ordered) - 1)))]


@pytest.mark.parametrize(("accuracy", "rows"), [(10, 5), (50, 20), (1000, 100_000)])
def test_percentiles(spark, accuracy, rows):
    rng = np.random.default_rng(2)
    inf = float("inf")
    groups = {
        "five": [10.0, 20.0, 30.0, 40.0, 50.0],
        "hot": [7.0] * 300 + list(rng.normal(size=200)),
        "one": [3.5],
        "tie": [1.0, 2.0, 3.0, 4.0],
        "tail": [*rng.normal(size=3000).tolist(), 1e15],
        "infinite": [-inf, *rng.normal(size=50).tolist(), inf, inf, inf, inf],
        None: [2.0, 9.0, 4.0],
    }
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("five", None)], "g string, v double")
    ask = {"accuracy": accuracy, "bracket_rows": rows}
    out = rq.nearest_rank_percentile(df, "v", [0, 50, 95, 100], ["g"], **ask)
    got = {(r["g"], r["percent"]): r["v"] for r in out.collect()}
    assert got == {(g, float(p)): nearest(vs, p) for g, vs in groups.items() for p in (0, 50, 95, 100)}
    assert rq.nearest_rank_percentile(df, "v", [50], **ask).count() == 1
    assert rq.nearest_rank_percentile(df.where("false"), "v", [50], **ask).count() == 0
    mixed = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "v double")
    assert [str(r["v"]) for r in rq.nearest_rank_percentile(mixed, "v", [0, 50, 100], **ask).orderBy("percent").collect()] == ["1.0", "2.0", "nan"]


def test_histogram_and_quantile(spark):
    rows = [request(i, ms=ms) for i, ms in enumerate([5, 20, 40, 90, 200])]
    hist = rq.latency_buckets(log(spark, rows), "path", bounds=[0.01, 0.05, 0.1, float("inf")]).first()
    assert [b["n"] for b in hist["buckets"]] == [1, 3, 4, 5] and hist["sum"] == pytest.approx(0.355)

    def quantile(counts, q):
        bounds = [0.01, 0.05, 0.1, float("inf")]
        arr = F.array(*[F.struct(F.lit(le).alias("le"), F.lit(n).cast("long").alias("n")) for le, n in zip(bounds, counts, strict=True)])
        return spark.range(1).select(rq.histogram_quantile(arr, q)).first()[0]

    assert quantile([1, 3, 4, 5], 0.5) == pytest.approx(0.01 + 0.04 * 1.5 / 2)
    assert quantile([4, 4, 4, 4], 0.5) == pytest.approx(0.005)
    assert quantile([1, 1, 1, 100], 0.95) == 0.1
    assert quantile([0, 0, 0, 0], 0.95) is None


def test_condition_must_hold_without_a_gap(spark):
    minutes = [*range(0, 12), *range(13, 24), 40]
    rows = spark.createDataFrame([(DAY + dt.timedelta(minutes=m), float(m)) for m in minutes], "at timestamp, value double")
    fired = sorted(int(r["value"]) for r in rq.held_for(rows, 10).collect())
    assert fired == [10, 11, 23]


def test_silence_is_no_traffic(spark):
    rows = [request(i, seconds=10 * i) for i in range(60)] + [request(99, seconds=3600)]
    fired = [r["at"] for r in rq.alert_no_traffic(log(spark, rows)).orderBy("at").collect()]
    quiet = Counter()
    for t in range(1, 62):
        quiet[t] = sum(t * 60 - 300 <= (r[3] - DAY).total_seconds() < t * 60 for r in rows) < 3
    expected = [t for t in range(16, 62) if all(quiet[u] for u in range(t - 15, t + 1))]
    assert [(a - DAY).total_seconds() / 60 for a in fired] == expected and expected


def test_access_log_round_trip(spark, tmp_path):
    rows = log(spark, [request(1), request(2, None), request(3, "b")]).withColumns({"rate_limit": F.when(F.col("rid") == 1, 5), "rate_remaining": F.lit(None)})
    path = str(tmp_path / "log")
    logs.write_access_log(rq.access_log_row(rows), path)
    (tmp_path / "log" / "broken.json").write_text('{"ts": 1.5, "rid"\n', encoding="utf-8")
    back = {r["rid"]: r for r in logs.read_access_log(spark, path).collect()}
    assert set(back) == {"1", "3", None}
    assert tuple(back["1"]["rate_limit"]) == (5, 0) and back["3"]["rate_limit"] is None
    assert back["1"]["client_id"] == "a" and back["1"]["ts"] == DAY.replace(tzinfo=dt.UTC).timestamp()
    assert back[None][logs.CORRUPT].startswith('{"ts"')


def test_quota_table(spark, tmp_path):
    path = str(tmp_path / "quota")
    assert logs.read_quota(spark, path).count() == 0
    usage = lambda *rows: spark.createDataFrame(rows, "client_id string, day date, used long")
    one, two = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    logs.quota_state_upsert(usage(("a", one, 1), ("b", one, 2), ("a", two, 3)), path)
    logs.quota_state_upsert(usage(("a", one, 9)), path)
    got = sorted(tuple(r) for r in logs.read_quota(spark, path).collect())
    assert got == [("a", one, 9), ("a", two, 3), ("b", one, 2)]


def test_access_log_of_some_clients_reads_their_folders_only(spark, tmp_path):
    path = str(tmp_path / "log")
    logs.write_access_log(rq.access_log_row(log(spark, [request(1), request(3, "b"), request(4, "7")]).withColumns({"rate_limit": F.lit(None), "rate_remaining": F.lit(None)})), path)
    some = logs.read_access_log(spark, path, ["b", "7"])
    assert sorted(r["rid"] for r in some.collect()) == ["3", "4"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "client" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_an_unreadable_quota_file_is_an_error(spark, tmp_path):
    path = str(tmp_path / "quota")
    usage = spark.createDataFrame([("a", dt.date(2024, 1, 1), 1)], "client_id string, day date, used long")
    logs.quota_state_upsert(usage, path)
    (tmp_path / "quota" / "day=2024-01-01" / "part-bad.parquet").write_bytes(b"no parquet here, not at all")
    with pytest.raises(Exception, match="(?i)parquet|corrupt|read"):
        logs.quota_state_upsert(usage, path)


ODD_CLIENTS = ["a/b", "x=y %", "", "é{1}[2]", "tab\tnew\nline", "it's", "c\\d:*?#^\"", ".hidden", "_under", "same", "Same"]


def test_access_log_has_the_folders_and_lines_that_spark_writes(spark, tmp_path):
    """Folders, lines and rows equal those of the writer and reader of Spark, also for odd names; parts of a client that come later are added."""
    rows = [request(i, ODD_CLIENTS[i % len(ODD_CLIENTS)], path="/a  \"q\" ü", seconds=i) for i in range(300)] + [request(1000 + i, "hot") for i in range(700)]
    made = rq.access_log_row(log(spark, rows).withColumns({"rate_limit": F.when(F.col("rid") % 2 == 1, 5), "rate_remaining": F.lit(None)}))
    direct, plain = tmp_path / "direct", tmp_path / "plain"
    for part in (F.col("status") == 200, F.lit(False), F.col("rid") == "7"):
        logs.write_access_log(made.where(part), str(direct))
        logs.client_rows(made.where(part)).write.mode("append").partitionBy("client").json(str(plain))
    assert not [f for f in direct.iterdir() if not f.name.startswith("client=")]
    lines = lambda folder: {d.name: sorted(x for f in d.glob("[!.]*.json") for x in f.read_text("utf-8").split("\n")[:-1]) for d in folder.glob("client=*")}
    assert lines(direct) == lines(plain) and len(lines(direct)) == len(ODD_CLIENTS) + 1
    back = sorted(map(str, logs.read_access_log(spark, str(direct)).collect()))
    assert len(back) == 1001 and back == sorted(map(str, spark.read.schema(f"{logs.ACCESS_LOG}, {logs.CORRUPT} string").json(str(plain), recursiveFileLookup=True).collect()))
    some = logs.read_access_log(spark, str(direct), ["a/b", "hot"])
    assert some.groupBy("client_id").count().collect() and {r[0] for r in some.select("client_id").collect()} == {"a/b", "hot"}


def test_writing_the_access_log_starts_no_file_of_hadoop_and_one_file_per_client_and_task(spark, tmp_path):
    rows = log(spark, [request(i, f"c{i % 50}") for i in range(500)]).withColumns({"rate_limit": F.lit(None), "rate_remaining": F.lit(None)})
    logs.write_access_log(rq.access_log_row(rows), str(tmp_path / "log"))
    files = [f for f in (tmp_path / "log").rglob("*") if f.is_file()]
    assert len(files) == 50 and all(f.suffix == ".json" for f in files)


def test_all_lines_of_all_files_are_read_in_ranges(spark, tmp_path, monkeypatch):
    """Line ends of any kind, a file without one at its end, a byte order mark, long lines, compressed and hidden files."""
    line = lambda i, **more: json.dumps({"ts": 1.0, "rid": str(i), **more})
    folder = tmp_path / "log" / "client=a" / "deep"
    folder.mkdir(parents=True)
    (folder / "one.json").write_bytes("\n".join(line(i, path="x" * (i % 7) * 40) for i in range(200)).encode())
    (folder / "two.json").write_bytes(b"\xef\xbb\xbf" + "\r\n".join([line(200), "", "  ", line(201)]).encode() + b"\r" + line(202).encode() + b"\nno json \xff\n[" + line(203).encode() + b"," + line(204).encode() + b"]")
    (tmp_path / "log" / "three.json.gz").write_bytes(gzip.compress((line(205) + "\n" + line(206)).encode()))
    (tmp_path / "log" / "empty").write_bytes(b"")
    for hidden in (folder / "_four.json", folder / ".five.json"):
        hidden.write_text(line(999))
    expected = spark.read.schema(f"{logs.ACCESS_LOG}, {logs.CORRUPT} string").json(str(tmp_path / "log"), recursiveFileLookup=True).collect()
    assert len(expected) == 208
    for size in (64, 8 * 2**20):
        monkeypatch.setattr(client_files, "RANGE", size)
        assert sorted(map(str, logs.read_access_log(spark, str(tmp_path / "log")).collect())) == sorted(map(str, expected))


def test_a_file_is_put_in_its_place_once(tmp_path):
    """A repeated task finds its file there; other errors are not hidden."""
    staged, place = tmp_path / "s", tmp_path / "client=a" / "p"
    staged.write_text("1")
    for _ in range(2):
        client_files.put(str(staged), str(place))
        assert place.read_text() == "1" and not staged.exists()
    with pytest.raises(FileNotFoundError):
        client_files.put(str(staged), str(tmp_path / "client=b" / "p"))
