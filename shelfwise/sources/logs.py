"""Log, quota and report files."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import client_files

NO_CLIENT = "n/a"
CORRUPT = "_corrupt_record"
ACCESS_LOG = (
    "ts double, rid string, client_id string, method string, path string, status int, "
    "latency_ms int, rate_limit struct<limit: int, remaining: int>"
)
QUOTA = "client_id string, day date, used bigint"
QUOTA_COLUMNS = ["client_id", "day", "used"]


def client_rows(log: DataFrame) -> DataFrame:
    """Rows that belong to a client's log file; the client stays inside the record too."""
    known = log.where(F.col("client_id") != NO_CLIENT)
    return known.withColumn("client", F.col("client_id"))


def write_access_log(log: DataFrame, path: str) -> None:
    """Append JSON lines below one folder per client."""
    rows = client_rows(log).hint("rebalance", "client")
    folder = client_files.mounted(log.sparkSession, path)
    if folder is None:
        rows.write.mode("append").partitionBy("client").json(path)
        return
    line = F.to_json(F.struct(*(c for c in rows.columns if c != "client")))
    client_files.append_lines(rows.select("client", line.alias("line")), "client", folder, ".json")


def read_access_log(spark: SparkSession, path: str, clients: Sequence[str] | None = None) -> DataFrame:
    """Log lines; a line that is no JSON keeps its text in ``_corrupt_record``.

    All files are read, also those outside a client's folder. With ``clients`` only the folders of these are.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    schema = f"{ACCESS_LOG}, {CORRUPT} string"
    if clients is None:
        reader = spark.read.schema(schema).options(**options, recursiveFileLookup="true")
        folder = client_files.mounted(spark, path)
        if folder is None or not os.path.isdir(folder) or client_files.is_stream_output(folder):
            return reader.json(path)
        lines, compressed = client_files.read_lines(spark, folder)
        texts = getattr(lines._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
        log = reader._df(reader._jreader.json(texts))
        return log.unionByName(reader.json(compressed)) if compressed else log
    lines = spark.read.schema(f"{schema}, client string").options(**options).json(path)
    return lines.where(F.col("client").isin(*clients)).drop("client")


def read_quota(spark: SparkSession, path: str) -> DataFrame:
    """Usage per client and day; a missing table is an empty one.

    A file that cannot be read is an error: it holds the counts of many clients, and counting them from zero again would
    be made permanent by the next write.
    """
    try:
        return spark.read.schema(QUOTA).option("ignoreCorruptFiles", "false").parquet(path).select(*QUOTA_COLUMNS)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], QUOTA)


def quota_state_upsert(usage: DataFrame, path: str) -> None:
    """Replace the given (client, day) counts; only the days in ``usage`` are rewritten."""
    new = usage.select(F.col("client_id"), F.col("day"), F.col("used").cast("long").alias("used"))
    old = read_quota(usage.sparkSession, path)
    touched = new.select("day").distinct()
    kept = old.join(touched, "day", "left_semi").join(
        new.select("client_id", "day"), ["client_id", "day"], "left_anti"
    )
    rows = kept.select(*QUOTA_COLUMNS).unionByName(new).hint("rebalance", "day")
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("day").parquet(path)


def write_eval_report(summary: DataFrame, cases: DataFrame, path: str, **about: str | int) -> None:
    """The summary as one JSON row with run id and time, the cases as JSON lines next to it."""
    facts = {name: F.lit(value) for name, value in about.items()}
    head = summary.withColumns(
        {"run_id": F.uuid(), "timestamp_utc": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"), **facts}
    )
    head.write.json(f"{path}/summary")
    cases.write.json(f"{path}/cases")
