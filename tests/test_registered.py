"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os
from collections import Counter

import pytest

import __spark_entry__ as driver

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(driver.queries()))
def test_query(spark, duck, name):
    frame = driver.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    rows = Counter(repr(tuple(row[c] for c in columns)) for row in frame.collect())
    text = driver.oracle_sql().get(name)
    if text is None:
        assert rows
        return
    answer = duck.execute(text)
    names = [column[0] for column in answer.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = Counter(repr(tuple(row[i] for i in at)) for row in answer.fetchall())
    assert rows == want


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_every_check_has_its_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
