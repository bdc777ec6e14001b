"""One local session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def spark():
    from lodestrata.session import local_session

    return local_session(4, 4, "4g")


@pytest.fixture(scope="session")
def sf():
    """The smallest data folder; tests that need it are skipped without it."""
    path = "/root/testdata/sf0.001"
    if not Path(path).exists():
        pytest.skip("no test data")
    return path
