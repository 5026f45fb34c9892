import pytest

from pairlens.session import build


@pytest.fixture(scope="session")
def spark():
    s = build("local[4]", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
