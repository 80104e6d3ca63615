import pytest

from tests.compare import connect
from tideline.plans import registry
from tideline.session import configure, local_session


@pytest.fixture(scope="session")
def spark():
    session = configure(local_session(8))
    registry.load_all()
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    return connect("sf0.001")
