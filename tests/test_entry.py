"""The driver contract: names, schemas and results on the smallest tables."""

import os

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def test_names():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100 and all(callable(f) for f in q.values())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["query_id", "doc_id", "score", "rank", "n_legs", "best_leg"] and df.count() > 0
