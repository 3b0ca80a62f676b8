import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from docflow.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions=4, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def apply(spark):
    """Values of a column expression over a list of texts, in order."""

    def run(fn, values, schema="string"):
        df = spark.createDataFrame(list(enumerate(values)), f"i int, v {schema}")
        rows = df.select("i", fn("v").alias("r")).collect()
        return [r["r"] for r in sorted(rows, key=lambda r: r["i"])]

    return run


@pytest.fixture
def responses(spark):
    """A response table from texts; documents are numbered from 0."""

    def make(*texts):
        return spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "doc_id long, page_no int, text string")

    return make
