import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def ready(spark):
    from relsift.llm._session import prepare

    return prepare(spark)
