import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from creativeaudit import session  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    s = session.build("local[8]", "tests", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
        "spark.sql.streaming.stateStore.stateSchemaCheck": "true"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
