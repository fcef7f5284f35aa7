import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from spotlake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", shuffle_partitions=4, app="spotlake-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def grid10(spark):
    rows = [(0, i, float(i % 10), float(i // 10)) for i in range(100)]
    return spark.createDataFrame(rows, "sample_id INT, barcode BIGINT, x DOUBLE, y DOUBLE").cache()
