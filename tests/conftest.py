import pytest

from lumenframe.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", "tests", 4)
    s.sparkContext.setLogLevel("ERROR")
    return s
