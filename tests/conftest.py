import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from casespark.session import checkpoint_dir, get_spark
    s = get_spark("local[4]", app="casespark-tests", shuffle_partitions=4)
    checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small_dir():
    return SMALL
