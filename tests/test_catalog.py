"""Every catalogued query with a SQL twin gives the twin's rows, and no query depends on how its input is dealt out."""

import pytest

from tessella.catalog import ORACLES, QUERIES

from .compare import assert_same, connection, rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, con, name):
    assert_same(QUERIES[name](spark, FOLDER), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_twin(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


@pytest.mark.parametrize("name", ["w01_distinct_passages", "l05_fixed_slice", "c13_rrf_fusion", "a11_nearest_rank", "w08_last_wins", "u02_ordered_dedupe"])
def test_dealing_changes_nothing(spark, name, monkeypatch):
    from tessella.catalog import base

    expected = rows(QUERIES[name](spark, FOLDER).toPandas())
    plain = base.table
    dealt = lambda s, d, t: plain(s, d, t).repartition(7)
    for module in ("relational", "retrieval", "base"):
        monkeypatch.setattr(f"tessella.catalog.{module}.table", dealt)
    assert rows(QUERIES[name](spark, FOLDER).toPandas()) == expected
