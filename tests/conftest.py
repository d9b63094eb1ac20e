from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark():
    from upland.session import local_session, ship

    session = local_session(4, "tests")
    ship(session)
    return session


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con(sf_dir):
    import oracle_compare

    return oracle_compare.connect(sf_dir)
