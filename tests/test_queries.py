"""Every query outside the training-data subpackage: its rows against its SQL, over the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from tidewell import fixtures
from tidewell.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return "nan" if math.isnan(value) else f"{float(value):.9g}"
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


@pytest.fixture(scope="module")
def duck(spark, sf_dir):
    fixtures.store(spark, sf_dir)  # the listings are joined once, not for each query
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in frame.collect())
    if name not in ORACLES:
        return
    answer = duck.execute(ORACLES[name])
    found = [c[0] for c in answer.description]
    assert sorted(found) == columns
    assert rows == sorted(repr([plain(dict(zip(found, r, strict=True))[c]) for c in columns]) for r in answer.fetchall())
