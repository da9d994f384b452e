import pytest

from sluice.llm.oracle import ORACLE
from sluice.llm.queries import QUERIES

from ..oracle import same


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    same(QUERIES[name](spark, sf), ORACLE[name], sf)
