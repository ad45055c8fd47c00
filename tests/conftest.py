import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from factspark.session import local_session  # noqa: E402
from factspark.sources.tables import Tables  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(8, partitions=4, memory="6g")


@pytest.fixture(scope="session")
def tables(spark):
    return Tables(spark, SMALL)
