"""One local session for all tests, and the folder of small test tables where there is one."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = Path(os.environ.get("KOMAGRID_TEST_DATA", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark():
    from komagrid.session import local_session, ship

    session = local_session(4, 4, driver_memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    if not DATA.exists():
        pytest.skip("no test tables")
    return str(DATA)
