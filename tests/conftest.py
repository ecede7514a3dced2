import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL_SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from roomrate.session import build_session

    s = build_session("local[4]", 4, app_name="roomrate-tests")
    yield s
    s.stop()
