import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from tagspark.session import local_session

    session = local_session(8, "4g", "tests")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """A DataFrame from rows and a schema string."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


COUNTS = "sampleId string, cellId string, tag string, umiCount bigint"


@pytest.fixture
def counts(frame):
    return lambda rows: frame(rows, COUNTS)
