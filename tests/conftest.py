import os
import sys
import datetime as dt

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from seqdrift.config import get_spark
    s = get_spark("local[4]", app="seqdrift-tests", shuffle_partitions=4)
    yield s
    s.stop()


def T(hm: str) -> dt.datetime:
    h, m = hm.split(":")
    return dt.datetime(2024, 1, 1, int(h), int(m))


# FIXTURES §3.1 — the hand log: (event_id, event_time, user_id, product_id, user_session)
LOG = [
    (1, T("10:00"), 1, 10, "s1"),
    (2, T("10:01"), 1, 20, "s1"),
    (3, T("10:02"), 1, 30, "s1"),
    (4, T("10:03"), 1, 20, "s1"),
    (5, T("10:00"), 2, 20, "s2"),
    (6, T("10:05"), 2, 30, "s2"),
    (7, T("10:05"), 2, 10, "s2"),
    (8, T("10:07"), 3, 9, "s3"),
    (9, T("10:08"), 3, 100, "s3"),
    (10, T("10:09"), 4, 20, "s4"),
]


@pytest.fixture()
def log(spark):
    from seqdrift.schema import EVENT_SCHEMA
    return spark.createDataFrame(LOG, EVENT_SCHEMA)
