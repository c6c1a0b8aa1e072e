import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark():
    from tessella.session import build_session

    session = build_session("local[4]", 4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
