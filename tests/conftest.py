import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from visitlens.session import get_session
    s = get_session("local[4]", app_name="visitlens-tests", shuffle_partitions=4)
    # tests run without a cluster-provided checkpoint folder: use a scratch one
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="visitlens-test-ckpt-"))
    yield s


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="visitlens-test-")
