"""Every registered query next to its SQL twin on the small tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from check_oracle import compare
from playtally.plans.registry import registry

NAMES = sorted(registry())


def test_every_query_has_a_twin():
    assert set(contract.queries()) >= set(NAMES)
    assert set(contract.oracle_sql()) >= set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_same_result(spark, sf_dir, name):
    ok, note = compare(spark, name, sf_dir)
    assert ok, note


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns[:2] == ["minute_ms", "minute"]
    assert frame.limit(1).count() == 1
