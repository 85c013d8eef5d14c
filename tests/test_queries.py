"""Every registered query of the core library runs and equals its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from lightloom import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Minutes each on noise; test_modes has their operators on series with known modes.
SLOW = {"joint_extraction", "sequential_modes"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_registry():
    assert set(plans.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", [n for n in plans.QUERIES if n not in SLOW])
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows or name in {"run_groups"}
    if name in plans.ORACLES:
        want = duck.sql(plans.ORACLES[name])
        names = sorted(df.columns)
        assert names == sorted(want.columns)
        text = lambda v: None if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
        ours = sorted(([text(r[c]) for c in names] for r in rows), key=str)
        theirs = sorted(([text(r[want.columns.index(c)]) for c in names] for r in want.fetchall()), key=str)
        assert ours == theirs
