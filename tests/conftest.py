import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from loomstone.session import importable, local_session

    session = local_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    importable(session)
    yield session
    session.stop()
