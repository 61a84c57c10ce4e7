from __future__ import annotations

import pytest

from fieldloom.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("local[4]", "tests", spark_sql_shuffle_partitions="4")
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()
