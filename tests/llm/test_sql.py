import pytest
from biblink.llm.queries import QUERIES, SQL

from .. import oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, name):
    assert oracle.compare(spark, oracle.connect(SF), QUERIES[name], SQL[name], SF) is None
