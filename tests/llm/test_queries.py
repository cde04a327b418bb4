"""Registered queries of the corpus operators against their SQL on the smallest tables."""

import pytest

from skeinworks.llm.queries import ORACLE, QUERIES
from tests.compare import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    same(QUERIES[name](spark, SF), ORACLE[name], SF)
