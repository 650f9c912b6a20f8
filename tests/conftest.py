import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from terrane.session import build_session

    place = tmp_path_factory.mktemp("spark")
    conf = {"spark__sql__shuffle__partitions": "4", "spark__sql__warehouse__dir": str(place / "warehouse"), "spark__checkpoint__dir": f"file://{place}/shared", "spark__driver__memory": "4g"}
    session = build_session("tests", "local[4]", **conf)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
