import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quernel.session import build_session

    conf = {"spark__sql__shuffle__partitions": "4", "spark__ui__enabled": "false", "spark__driver__memory": "2g", "spark__checkpoint__dir": f"file://{tmp_path_factory.mktemp('shared')}"}
    s = build_session("tests", "local[4]", **conf)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
