import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from groundcover.session import ensure_checkpoint_dir, local_session, ship_package  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, "tests")
    s.sparkContext.setLogLevel("OFF")
    ensure_checkpoint_dir(s)
    ship_package(s)
    return s


@pytest.fixture(scope="session")
def sf():
    return SF
