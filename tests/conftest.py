import os

import pytest

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@pytest.fixture(scope="session")
def spark():
    from millrace.session import local_session

    session = local_session(cpus=4, shuffle_partitions=4, driver_memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
