import pytest

from ridgeline.session import local_session, sweep


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, partitions=4, memory="6g", name="tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    sweep(s)
    s.stop()
