import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parent)]

from tidemark import session


@pytest.fixture(scope="session")
def spark():
    spark = session.local_session("8", shuffle_partitions=4)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture
def hot(spark):
    """Split every key larger than 20 rows, so small fixtures take the skew path."""
    spark.conf.set(session.HOT_ROWS_KEY, "20")
    yield
    spark.conf.unset(session.HOT_ROWS_KEY)
