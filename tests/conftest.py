import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from shelfwise.session import build_session, prepare

    session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
        spark__driver__host="127.0.0.1",
    )
    session.sparkContext.setLogLevel("OFF")
    yield prepare(session)
    session.stop()


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate a text expression over literals: values(fn, [texts]) -> results in order."""
    from pyspark.sql import functions as F

    def run(fn, inputs):
        rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
        return [r[0] for r in rows.select("i", fn(F.col("x")).alias("v")).orderBy("i").select("v").collect()]

    return run
