"""Queries next to their SQL twins on the smallest tables; the slow searches are left to the driver."""

from pathlib import Path

import pytest

from checks.compare import difference, twin_connection
from checks.registry import CHECKS

SF_DIR = "/root/testdata/sf0.001"
FAMILIES = ("checks.telemetry", "checks.runs")
NAMES = [n for n, c in CHECKS.items() if c.run.__module__ in FAMILIES] + ["random_search", "classify_commits", "stream_heartbeat_timeouts"]


@pytest.fixture(scope="module")
def twins():
    if not Path(SF_DIR).exists():
        pytest.skip("the driver's tables are not here")
    return twin_connection(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, twins, name):
    assert difference(spark, twins, SF_DIR, name) is None


def test_every_query_has_a_shape():
    assert len(CHECKS) > 120 and all(c.columns for c in CHECKS.values())
