import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from ledgerlight.session import get_session
    s = get_session("local[4]", shuffle_partitions=8, app_name="ledgerlight-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def scratch():
    return tempfile.mkdtemp(prefix="ledgerlight-test-")
