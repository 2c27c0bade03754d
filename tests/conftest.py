import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidegate.session import ROWS_PER_TASK_CONF, local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", partitions=8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from tidegate.views import Tables

    return Tables(spark, SF_DIR)


@pytest.fixture
def small_tasks(spark):
    """Treat a key of more than a few rows as hot, so that ordered operators cut it."""
    spark.conf.set(ROWS_PER_TASK_CONF, "40")
    yield spark
    spark.conf.unset(ROWS_PER_TASK_CONF)


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-test-", dir="/tmp")


def rows(df, *cols):
    """Rows of a small result as a sorted list of tuples."""
    picked = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
