"""Every query against its SQL, value by value."""

import duckdb
import pytest

from lodestone.plans.oracle import ORACLE_SQL
from lodestone.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"eval_summary", "rank_flips", "three_strategies", "failed_queries"}  # the driver's oracle run has these too


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(frame):
    columns = sorted(frame.columns)
    rows = frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()
    return columns, sorted(map(repr, rows))


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE_SQL and n not in SLOW])
def test_query(spark, duck, sf_dir, name):
    assert plain(QUERIES[name](spark, sf_dir).toPandas()) == plain(duck.execute(ORACLE_SQL[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 200
