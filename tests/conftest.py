import pytest

from foliant.runtime import ship
from foliant.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()
