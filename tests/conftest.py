import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracle  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return oracle.session()
