"""Every registered market query against its SQL, and the others for rows."""

import pytest

from marketframe.plans import catalog as queries
from oracle import compare

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    assert compare(spark, DIR, queries.QUERIES[name], queries.SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    queries.QUERIES[name](spark, DIR).count()


def test_flagship(spark):
    df = queries.flagship(spark, DIR)
    assert df.count() > 400 and len(df.columns) == 63
