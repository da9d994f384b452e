import pytest

from sluice.queries import ORACLE, QUERIES

from .oracle import same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    sf = "/root/testdata/sf0.01"
    df = QUERIES[name](spark, sf)
    if name in ORACLE:
        same(df, ORACLE[name], sf)
    else:
        assert df.count() > 0
