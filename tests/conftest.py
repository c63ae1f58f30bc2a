from pathlib import Path

import pytest

from alertloom.session import build_session

ROOT = str(Path(__file__).resolve().parent.parent)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__driver__bindAddress="127.0.0.1"
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    yield session
    session.stop()
