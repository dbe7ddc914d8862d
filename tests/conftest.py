from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from orefold.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", app="tests", **{"spark__driver__memory": "3g", "spark__sql__shuffle__partitions": "4"})
    yield s
    s.stop()
