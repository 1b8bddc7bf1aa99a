"""All queries of the text operators against their SQL, on the smallest data folder."""

from pathlib import Path

import pytest

from gneiss.llm import oracle, queries
from tests.compare import rows, views

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not Path(DATA).exists():
        pytest.skip("no data")
    return views(DATA)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    df = queries.QUERIES[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in oracle.SQL:
        cur = con.execute(oracle.SQL[name])
        assert got == rows([c[0] for c in cur.description], cur.fetchall())
