import pytest

from pvseries.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=4, app="pvseries-tests", memory="4g", shuffle_partitions=4)
    yield session
    session.stop()
