import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ripplenet.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny_edges(spark):
    pairs = [(1, 3), (1, 4), (3, 2), (4, 6), (6, 2), (3, 6), (3, 7), (7, 8)]
    return spark.createDataFrame(pairs, "src bigint, dst bigint")


@pytest.fixture(scope="session")
def dup_edges(spark):
    pairs = [(1, 2), (1, 2), (2, 1), (1, 3), (1, 3), (4, 2), (2, 4), (2, 5), (5, 4), (5, 6), (4, 7)]
    return spark.createDataFrame(pairs, "src bigint, dst bigint")
