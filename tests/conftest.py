import pytest

from tests.compare import session


@pytest.fixture(scope="session")
def spark():
    s = session(cores=4, partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
