"""Corpus queries against their SQL."""

import os
from collections import Counter

import duckdb
import pytest

from helixlake.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import TINY


def plain(value):
    return round(value, 5) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(TINY):
        duck.sql(f"create view {f.split('.')[0]} as select * from '{TINY}/{f}'")
    got, want = QUERIES[name](spark, str(TINY)), duck.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in got.collect())
    wanted = Counter(tuple(plain(r[k]) for k in at) for r in want.fetchall())
    assert rows == wanted, (columns, sorted((rows - wanted).items(), key=str)[:3], sorted((wanted - rows).items(), key=str)[:3])
