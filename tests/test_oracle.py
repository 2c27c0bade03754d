"""Every query against its oracle, and the same with all larger keys treated as hot."""

import pytest

from tests.compare import diff, duck
from tests.conftest import SF_DIR
from tidegate.plans import load_all
from tidegate.registry import ORACLES, QUERIES

load_all()

# Queries on operators that cut a hot key.
ORDERED = (
    "join_ttl_latest ad_click_join trig_any "
    "task_process stock_running_sum stock_running_avg stock_pool stop_detect spike_detect "
    "markov_train fraud_score stat_ewma stat_running_median sort_secondary src_nline"
).split()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    assert diff(spark, con, SF_DIR, QUERIES[name], ORACLES[name]) == ""


@pytest.mark.parametrize("name", ORDERED)
def test_hot_keys(small_tasks, con, name):
    assert diff(small_tasks, con, SF_DIR, QUERIES[name], ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0
