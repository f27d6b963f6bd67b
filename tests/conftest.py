import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lumenloom.session import local_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = f"file://{tmp_path_factory.mktemp('shared')}"
    session = local_session("tests", "4", spark__sql__shuffle__partitions="4", spark__driver__memory="3g", spark__checkpoint__dir=shared)
    session.sparkContext.setLogLevel("ERROR")
    yield ship(session)
    session.stop()
