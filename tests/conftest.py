import os
import tempfile

import pytest

from lumenlog.session import session

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    shared = tempfile.mkdtemp(prefix="spark-")
    s = session("local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="6g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__checkpoint__dir=shared)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF
