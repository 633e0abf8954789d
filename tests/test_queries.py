import pytest
from biblink.plans import more_oracles, more_queries, oracles, queries

from . import oracle

SF = "/root/testdata/sf0.001"
QUERIES, SQL = queries.QUERIES | more_queries.QUERIES, oracles.SQL | more_oracles.SQL


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, con, name):
    assert oracle.compare(spark, con, QUERIES[name], SQL[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_imports_and_lists():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["biblio_bounds", "biblio_segment", "ref_key_sha1", "parse_locator", "dedupe_candidates"])
def test_plans_join_on_keys(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_manuscripts_are_joined_on_keys(spark):
    from biblink.plans import fixtures

    for sql in (fixtures.REFS, fixtures.LINES):
        plan = fixtures.fixture(spark, SF, sql)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
