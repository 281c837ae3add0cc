"""Every registered query of the core against its SQL on the smallest data."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect
from wardlight.workload import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_matches_sql(spark, name):
    status, rows, *_, detail = compare(spark, connect(FOLDER), name, registry.QUERIES[name], registry.ORACLES.get(name), FOLDER)
    assert status == ("match" if name in registry.ORACLES else "rows-only") and rows > 0, detail


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
