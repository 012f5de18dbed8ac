import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from attest.session import build_session, prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # Tables are tiny here: few partitions, and no time spent on compiling stages.
    session = build_session("tests", "local[8]", spark__sql__shuffle__partitions="2", spark__driver__memory="8g",
                            spark__sql__codegen__wholeStage="false", spark__sql__codegen__factoryMode="NO_CODEGEN")
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()
