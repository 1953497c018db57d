import os

import pytest

os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")


@pytest.fixture(scope="session")
def spark():
    from factorloom.session import session

    s = session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g", spark__sql__warehouse__dir="/tmp/factorloom-warehouse")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
