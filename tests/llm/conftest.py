import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import edge  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(edge.documents(), edge.DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], edge.DOCS)
