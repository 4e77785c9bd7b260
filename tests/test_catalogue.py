"""Every registered query against its SQL on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from factloom.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(df):
    def plain(v):
        if v is None or str(v) in ("<NA>", "NaT", "nan"):
            return None
        if isinstance(v, (int, float)) or hasattr(v, "item"):
            v = float(v)
            return None if math.isnan(v) else round(v, 6)
        return str(v)

    return Counter(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    found = QUERIES[name](spark, sf).toPandas()
    if name in ORACLES:
        wanted = duck.execute(ORACLES[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows(found) == rows(wanted)
    assert len(found)


def test_every_rule_occurs(spark, sf):
    assert {r.rule_id for r in QUERIES["verdict_histogram"](spark, sf).collect()} == {"R1", "R2", "R3", "R4a", "R4b", "R5a", "R5b", "R6", "R7", "R8", "R9"}


def test_blocking_joins_by_key(spark, sf):
    plan = QUERIES["classify_pairs"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 11
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
