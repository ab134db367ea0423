"""Every query against its SQL."""

import oracle
import pytest
from conftest import SF

from tessella.plans import catalog


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, con, name):
    oracle.compare(spark, con, catalog.queries()[name], catalog.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["qid", "doc_id", "rank", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
