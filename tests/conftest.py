import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from matchlog.session import local_session  # noqa: E402
from matchlog.sources.schema import LOG  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_log(spark):
    """Log rows from (game, player, time, event, contents) tuples, in order."""

    def make(rows, species=("T", "P"), winner=1):
        return spark.createDataFrame(
            [
                (g, winner, float(t), p, species[p], event, contents, i)
                for i, (g, p, t, event, contents) in enumerate(rows)
            ],
            LOG,
        )

    return make
