import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))


@pytest.fixture(scope="session")
def spark():
    from compare import session

    s = session(4)
    yield s
    s.stop()


@pytest.fixture
def split_groups(monkeypatch):
    """Make every group count as too long for one task, with tiny tiles."""
    from vigilspark.operators import ordered, weights

    monkeypatch.setattr(ordered, "SAFE_GROUP", 4)
    monkeypatch.setattr(weights, "SAFE_GROUP", 4)
    monkeypatch.setattr(ordered, "CHUNK", 8)
    return ordered.Extent(10_000, 10_000)
