"""Every registered query beside its SQL on the smallest data."""

import pytest

import __spark_entry__ as entry_point
from tests.compare import TESTDATA, compare
from tideline.plans import registry

registry.load_all()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, duck, name):
    status, rows, note = compare(
        spark, duck, "sf0.001", name, registry.QUERIES[name], registry.ORACLES[name]
    )
    assert status == "ok", note


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs_without_sql(spark, name):
    assert registry.QUERIES[name](spark, f"{TESTDATA}/sf0.001").count() > 0


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
