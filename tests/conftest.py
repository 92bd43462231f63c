from __future__ import annotations

import pytest

from stockcount.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "stockcount-tests", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
