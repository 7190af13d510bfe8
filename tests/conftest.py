import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from granary.runtime import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark(
        "tests",
        8,
        **{"spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4"},
    )
    yield session
    session.stop()
