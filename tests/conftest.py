import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from plumbline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, memory="6g")


@pytest.fixture(scope="session")
def churn(spark):
    from plumbline import load_sample

    return load_sample(spark, "churn_prediction").persist()
