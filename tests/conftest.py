import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from chronoplane.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build("local[4]", 4, spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
