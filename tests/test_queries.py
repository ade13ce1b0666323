"""Every query with SQL equals it on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def shown(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    cell = lambda v: f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, str(DATA))
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert shown([tuple(r) for r in df.collect()], df.columns) == shown(want.fetchall(), want.columns)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql_or_is_learned_or_digested():
    assert set(entry.queries()) - set(entry.oracle_sql()) <= {"op1_media", "op3_sentencepiece", "op7_langid", "pipeline"}
