import pytest

from ledgerline.plans import catalog
from tests.conftest import SF
from tests.oracle import same_rows


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, duck, name):
    same_rows(catalog.QUERIES[name](spark, SF), duck, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs_alike_twice(spark, name):
    first, again = (sorted(map(str, catalog.QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert first == again and first
