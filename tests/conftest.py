import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from labelmill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # Tests run many small plans once: light compilation and few partitions suit them.
    return local_session("8", 3, "8g", "-XX:TieredStopAtLevel=1 -XX:ReservedCodeCacheSize=256m")


@pytest.fixture(scope="session")
def sf_dir():
    return f"/root/testdata/sf{os.environ.get('TEST_SF', '0.001')}"


@pytest.fixture
def labelled(spark):
    """Builds ``(row_id, text, label)`` from ``(text, label)`` pairs, spread over several partitions."""

    def make(pairs, partitions=3):
        rows = [(i, t, l) for i, (t, l) in enumerate(pairs)]
        return spark.createDataFrame(rows, "row_id bigint, text string, label string").repartition(partitions)

    return make
