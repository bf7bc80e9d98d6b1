"""Every query of the subpackage that has SQL gives DuckDB's rows on the smallest tables."""

import pytest

from framelake.llm import queries
from tests.test_queries import duck, rows  # noqa: F401  the fixture and the comparison


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query(spark, duck, sf_dir, name):  # noqa: F811
    df = queries.QUERIES[name](spark, sf_dir)
    result = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, result.fetchall())
