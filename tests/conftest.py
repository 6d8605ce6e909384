"""One small session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark():
    from corploom.session import session

    s = session("local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="3g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("the test tables are not here")
    return str(folder)
