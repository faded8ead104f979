"""The corpus queries against their DuckDB SQL (sf0.001)."""
import pytest

from conftest import SF_SMALL
from metrilake.llm.queries import QUERIES, SQL


def _rows(df):
    cols = sorted(df.columns)
    return cols, sorted("|".join(repr(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, duck, name):
    assert _rows(QUERIES[name](spark, SF_SMALL).toPandas()) == _rows(duck.execute(SQL[name]).df())
