import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from voicelake.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session("tests", "local[8]", 4)
