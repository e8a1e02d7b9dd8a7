import pytest
from boundwise.plans import catalogue
from duck import assert_same

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    assert_same(catalogue.queries()[name](spark, SF), catalogue.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(n for n in catalogue.queries() if n.endswith("_bounds")))
def test_bounds_hold(spark, name):
    got = catalogue.queries()[name](spark, SF).collect()
    assert got and all(r.within_eps for r in got)


def test_flagship(spark):
    got = catalogue.flagship(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 5 and all(0 < r.q25 <= r.q50 <= r.q75 for r in got)
