import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from formweave.session import session, ship

    s = session("local[4]", 4, "formweave-tests")
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    return s
