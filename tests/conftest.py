import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("GRIDSMITH_DRIVER_MEMORY", "8g")


@pytest.fixture(scope="session")
def spark():
    from gridsmith.session import local_session

    return local_session("*", 4)


@pytest.fixture
def tiny_limits(monkeypatch):
    """Sizes so small that every operator takes its distributed form."""
    from gridsmith.session import LIMITS

    monkeypatch.setattr(LIMITS, "single_task_rows", 40)
    monkeypatch.setattr(LIMITS, "broadcast_bytes", 0)
    monkeypatch.setattr(LIMITS, "hot_share", 8)
    return LIMITS
