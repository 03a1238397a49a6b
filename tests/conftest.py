import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from windrow.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4, app="windrow-tests")
    session.sparkContext.setLogLevel("OFF")
    session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="windrow-test-checkpoint-"))
    yield session
    session.stop()


@pytest.fixture()
def rows():
    def collect(df, *order):
        return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]

    return collect
