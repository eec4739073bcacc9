import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hortus.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", 4, app="hortus-tests")
    yield s


@pytest.fixture(scope="session")
def src(spark):
    from hortus.sources.testdata import TestdataTables
    return TestdataTables(spark, SMALL)


@pytest.fixture(scope="session")
def tables(src):
    return src.tables()
