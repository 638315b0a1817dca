"""Session settings and the shared folder that jobs write to."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent

# Settings every job relies on: UTC days, runtime re-planning and skew splitting.
# Partition counts are upper bounds that AQE coalesces to the real data size.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Folders per client are listed many by a task; one by a task costs more to start than to list.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "256",
    # Queries are written for this; ``tell_case_apart`` changes it for a result that needs it.
    "spark.sql.caseSensitive": "false",
}


def build_session(app: str = "shelfwise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the required settings; ``conf`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in REQUIRED_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime-changeable settings to a session somebody else built."""
    for key, value in REQUIRED_CONF.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    ship_package(spark)
    return spark


def tell_case_apart(df: DataFrame) -> DataFrame:
    """``df``; if some of its columns differ only in case, the session tells case apart from now on, until ``prepare``.

    Otherwise such a frame can be built, but neither its columns be named nor the frame be written or read back.
    """
    if len({name.lower() for name in df.columns}) < len(set(df.columns)):
        df.sparkSession.conf.set("spark.sql.caseSensitive", "true")
    return df


def ship_package(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per Spark context."""
    name = f"{PACKAGE.name}.zip"
    if any(str(f).endswith(f"/{name}") for f in spark.sparkContext.listFiles):
        return
    folder = Path(tempfile.mkdtemp(prefix="shelfwise-code-"))
    with zipfile.ZipFile(folder / name, "w") as archive:
        for source in sorted(PACKAGE.rglob("*.py")):
            archive.write(source, source.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(str(folder / name))


def _shared_base(spark: SparkSession) -> str:
    """The cluster's shared folder; only a local-mode session may fall back to a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="shelfwise-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the cluster's shared folder (``spark.checkpoint.dir``)."""
    return f"{_shared_base(spark)}/{purpose}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, purpose: str) -> DataFrame:
    """Compute once: write to the shared folder and read back.

    Cuts the lineage, survives the loss of executors, and gives the planner the real size, so a
    result that is small gets broadcast by the planner's own threshold and a large one does not.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows dealt to all tasks of the session before they are multiplied.

    A compact file of millions of rows is read by a few tasks, and whatever follows in the same stage is held by them alone.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
