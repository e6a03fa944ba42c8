from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ledgermesh.session import clear_stages, get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear_stages(session)
    session.stop()
