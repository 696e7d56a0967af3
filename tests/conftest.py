import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("SPANLOOM_DRIVER_MEMORY", "4g")

from spanloom.runtime import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "4", shuffle_partitions="4")
    yield s
    s.stop()
