import os

import pytest

os.environ.setdefault("PYSPARK_PYTHON", "python")


@pytest.fixture(scope="session")
def spark():
    from contactweave.session import build_session

    s = build_session("tests", cores=4, partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
