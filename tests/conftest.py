import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from callscope.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def make_calls(spark):
    """Calls from short rows ``(id, session, server, tool, status, latency, time in ms)``."""
    from pyspark.sql import functions as F

    def make(rows):
        df = spark.createDataFrame(
            rows, "id long, session_id string, server_name string, tool_name string, status string, latency_ms int, ms long")
        return df.withColumn("timestamp", F.timestamp_millis("ms")).drop("ms")

    return make
