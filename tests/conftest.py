import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


SAMPLE = """line_number bigint, sample_id string, source string, messages array<struct<role string, content string>>,
tools array<struct<type string, function struct<name string, description string, parameters string>>>,
assistant struct<content string, tool_calls array<struct<type string, function struct<name string, arguments string>>>>,
metadata struct<category string, subcategory string, task string>, batch_no int"""


def sample(line, sid, text="hi", tools=(), calls=(), content=None, source="xlam", batch=1):
    """One canonical sample row; text None leaves the messages NULL."""
    messages = None if text is None else [("system", "s"), ("user", text)]
    made = [("function", (n, a)) for n, a in calls]
    listed = [("function", (n, "d", p)) for n, p in tools]
    return (line, sid, source, messages, listed, (content, made), (None, None, None), batch)


@pytest.fixture
def samples(spark):
    return lambda *rows: spark.createDataFrame([*rows], SAMPLE)


@pytest.fixture
def row():
    return sample
