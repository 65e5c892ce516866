import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from planmark.plans.views import Views  # noqa: E402
from planmark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.sql.streaming.stateStore.providerClass":
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def views(spark):
    return Views(spark, "/root/testdata/sf0.001")


def rows(df, *columns):
    """Comparable content of a small result; doubles to 9 decimals."""
    flat = lambda v: round(v, 9) if isinstance(v, float) else v
    picked = df.select(*columns) if columns else df.select(*sorted(df.columns))
    return sorted(tuple(flat(v) for v in r) for r in picked.collect())
