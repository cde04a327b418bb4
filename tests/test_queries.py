"""Every registered query of the reference operators against its SQL on the smallest tables."""

import pytest

from skeinworks.queries import ORACLE, QUERIES
from tests.compare import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    same(QUERIES[name](spark, SF), ORACLE[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["entity_id", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
