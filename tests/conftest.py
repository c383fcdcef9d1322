import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sparsile.session import local_session  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(8, 8)


@pytest.fixture(scope="session")
def tables(spark):
    from sparsile.catalog.tables import Tables

    return Tables(spark, FOLDER)
