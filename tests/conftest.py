import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from checks.compare import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    # Plans are compared as text and must not be shortened.
    session.conf.set("spark.sql.maxMetadataStringLength", "100000")
    yield session
    session.stop()
