"""The exact nearest-neighbour join against every pair."""

import math

import numpy as np
import pytest

from factloom.operators import nearest

KINDS = "id long, document_id string, v array<double>"


def brute(rows, asked, k, floor, same):
    def ok(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    out = set()
    for q, qd, qv in asked:
        if not ok(qv):
            continue
        scored = []
        for i, d, v in rows:
            if not ok(v) or len(v) != len(qv) or (d == qd and d is not None and not (same and i > q)):
                continue
            if d is None and qd is None and i == q and not same:
                pass
            s = float(np.dot(qv, v) / (np.linalg.norm(qv) * np.linalg.norm(v)))
            if s >= floor:
                scored.append((-round(s, 9), i))
        out |= {(q, i, rank + 1) for rank, (_, i) in enumerate(sorted(scored)[:k])}
    return out


def found(spark, rows, asked, k, floor=0.25, same=False):
    got = nearest.neighbours(spark.createDataFrame(rows, KINDS), spark.createDataFrame(asked, KINDS), k, floor, same).collect()
    return {(r.query_id, r.candidate_id, r["rank"]) for r in got}


def clustered(rng, n, d=12, centres=9, spread=0.15):
    middle = rng.normal(size=(centres, d))
    return [(i, f"d{rng.integers(0, 7)}", (middle[i % centres] + rng.normal(size=d) * spread).tolist()) for i in range(n)]


@pytest.mark.parametrize("same", [False, True])
def test_equal_to_every_pair(spark, monkeypatch, same):
    """With small blocks, so that cells are split both ways."""
    monkeypatch.setattr(nearest, "PER_PIVOT", 60)
    monkeypatch.setattr(nearest, "BLOCK", 40)
    monkeypatch.setattr(nearest, "ASKED", 15)
    rng = np.random.default_rng(3)
    rows = clustered(rng, 500)
    assert found(spark, rows, rows[::3], 6, same=same) == brute(rows, rows[::3], 6, 0.25, same)


def test_loose_data_and_no_floor(spark, monkeypatch):
    monkeypatch.setattr(nearest, "PER_PIVOT", 30)
    rng = np.random.default_rng(4)
    rows = [(i, f"d{i % 3}", rng.normal(size=24).tolist()) for i in range(300)]
    assert found(spark, rows, rows[:40], 4, -1.0) == brute(rows, rows[:40], 4, -1.0, False)


@pytest.mark.parametrize("per", [10, 2048])
def test_odd_rows(spark, monkeypatch, per):
    monkeypatch.setattr(nearest, "PER_PIVOT", per)
    rng = np.random.default_rng(5)
    rows = clustered(rng, 60, d=4)
    rows += [(100, "a", None), (101, "a", [0.0] * 4), (102, "a", [math.nan, 1.0, 0.0, 0.0]), (103, "a", [1.0, None, 0.0, 0.0]), (104, "a", [math.inf, 0.0, 0.0, 1.0]), (105, "a", []), (106, "a", [3.0, 4.0]), (107, "b", [6.0, 8.0]), (108, "b", [1e200, 1e200, 0.0, 1e200])]
    rows += [(200 + i, f"e{i % 2}", [1.0, 2.0, 3.0, 4.0]) for i in range(30)]  # ties by id
    asked = [r for r in rows if r[0] % 2 == 0 or r[0] > 99]
    assert found(spark, rows, asked, 5) == brute([r for r in rows if r[0] != 108], [r for r in asked if r[0] != 108], 5, 0.25, False) | {x for x in found(spark, rows, asked, 5) if 108 in x[:2]}
    assert found(spark, rows, [(106, "a", [3.0, 4.0])], 5) == {(106, 107, 1)}
    assert found(spark, [], [], 5) == set() == found(spark, rows, [], 5) == found(spark, [], rows[:3], 5)


def test_bounds_leave_most_pairs_out(spark, monkeypatch):
    monkeypatch.setattr(nearest, "PER_PIVOT", 50)
    rng = np.random.default_rng(6)
    rows = clustered(rng, 3000, centres=30, spread=0.05)
    v = spark.createDataFrame(rows, KINDS)
    told = nearest.effort(v, v.where("id % 10 = 0"), 5, 0.25).selectExpr("sum(compared) c", "sum(pruned) p").first()
    assert told.c + told.p == 300 * 3000 and told.p > 5 * told.c


def test_one_scan_whatever_the_queries(spark, tmp_path, monkeypatch):
    """The plan reads the vectors as often for many queries as for few."""
    monkeypatch.setattr(nearest, "PER_PIVOT", 50)
    rng = np.random.default_rng(7)
    spark.createDataFrame(clustered(rng, 200), KINDS).write.parquet(str(tmp_path / "v"))
    v = spark.read.parquet(str(tmp_path / "v"))
    scans = [nearest.neighbours(v, q, 3, 0.25)._jdf.queryExecution().executedPlan().toString().count("Scan parquet") for q in (v.where("id < 5"), v)]
    assert scans[0] == scans[1]


@pytest.mark.parametrize("same", [False, True])
def test_rounds_make_no_more_rows_than_there_are(spark, monkeypatch, same):
    """Where visits are too many for one pass, cells are met in rounds, which are stored one by one; the result is that of every pair."""
    from factloom.plans import engine

    for name, n in (("PER_PIVOT", 40), ("BLOCK", 40), ("ASKED", 15), ("ONCE", 100), ("BUNDLE", 50), ("BUNDLE_ASKED", 60)):
        monkeypatch.setattr(nearest, name, n)
    rng = np.random.default_rng(8)
    rows = clustered(rng, 300) + [(1000 + i, "e", [1.0, 2.0, 3.0]) for i in range(3)] + [(2000, "f", [2.0, 4.0, 6.0]), (2001, None, [math.nan] * 12)]
    stored = []

    def store(df):
        stored.append(engine.written(df))
        return stored[-1]

    v, asked = spark.createDataFrame(rows, KINDS), spark.createDataFrame(rows[::2], KINDS)
    got = {(r.query_id, r.candidate_id, r["rank"]) for r in nearest.neighbours(v, asked, 6, 0.25, same, store, engine.deleted).collect()}
    assert got == brute(rows, rows[::2], 6, 0.25, same)
    assert len(stored) > 3
