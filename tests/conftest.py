import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from kinetra.session import local_session, ship

    session = local_session("kinetra-tests", "4", 4)
    ship(session)
    yield session
    session.stop()
