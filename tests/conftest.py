import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ringdata.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[4]", partitions=4, memory="4g", app="tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
