import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from spoor import session

    s = session.local("4", memory="4g", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
