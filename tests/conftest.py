import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join((sys.path[0], os.environ.get("PYTHONPATH", "")))


@pytest.fixture(scope="session")
def spark():
    from sparkgrain.session import build_session

    s = build_session("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def folder():
    with tempfile.TemporaryDirectory() as d:
        yield d
