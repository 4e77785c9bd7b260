"""Chunks of tables: units move once, and what is put together in rows equals what is packed by stretches and what grids say."""

import functools
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import chunking, evidence, stretches
from factloom.plans.catalogue import QUERIES

UNITS = "document_id string, page int, seq int, evidence_id string, type string, text string, table_index int, headers array<string>, row int, col int, row_header string, column_header string"


def test_units_move_once(spark, sf):
    plan = QUERIES["workspace_chunks"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


@pytest.mark.parametrize("tokens", [None, 70])
def test_rows_as_stretches(spark, tmp_path, tokens):
    rng, rows = random.Random(5), []
    for d, p in [("a", 0), ("a", 1), ("b", 2), ("", 0), ("c", 3)]:
        for i in range(90):
            kind = rng.choice(["TEXT", "IMAGE", "TABLE", "TABLE_CELL", "TABLE_CELL", "TABLE_CELL", "TABLE_CELL"])
            index = rng.choice([0, 0, 0, 1, 2, None]) if "TABLE" in kind else None
            index = 7 if d == "c" and kind == "TABLE_CELL" else index  # cells without a table
            text = rng.choice(["", " ", None, "é" * 9]) if kind == "IMAGE" else rng.choice([None, ""]) if kind == "TABLE" and i % 3 else "w" * rng.choice([1, 3, 9, 25, 150])
            rows.append((d, p, i, f"e{i}", kind, text, index, ["A", "B"] if kind == "TABLE" else None, rng.choice([None, *range(9)]) if kind == "TABLE_CELL" else None, rng.randint(0, 3) if kind == "TABLE_CELL" else None, "r", "c"))
    units = spark.createDataFrame(rows, UNITS).repartition(5)
    columns = ["document_id", "page", "seq", "type", "text", "chunk", "item"]
    got = sorted(str(tuple(r)) for r in chunking.placed(units, 120, tokens).select(columns).collect())
    want = sorted(str(tuple(r)) for r in chunking.placed(units, 120, tokens, functools.partial(stretches.packed, path=str(tmp_path), stretch=8)).select(columns).collect())
    assert got == want and len({x for x in got if "'TABLE'" in x and "part=2" in x})


def test_table_units_as_grids(spark):
    rng = random.Random(6)
    cells = [("d", p, t, rng.choice([None, -4, 0, 2, 3, 9, 11]), rng.choice([None, -1, 0, 5, 7]), rng.choice([None, "", "  ", " x", f"v{i}", f"w {i} "])) for p in (0, 1) for t in (0, 1, None) for i in range(25)]
    df = spark.createDataFrame(cells, "document_id string, page int, table_index int, row int, col int, text string")
    units = evidence.table_units(df).cache()
    key = ["document_id", "page", "table_index"]
    grid = evidence.cleaned_grid(df.withColumn("table_id", F.struct(*key)).drop(*key))
    plain = lambda d: sorted(str(tuple(r)) for r in d.collect())
    columns = ["row", "col", "text", "column_header", "row_header"]
    assert plain(units.where("type = 'TABLE_CELL'").select(*key, *columns)) == plain(grid.where("not is_header").select("table_id.*", *columns))
    sizes = grid.groupBy("table_id").agg(F.max("n_rows").alias("n_rows"), F.max("n_cols").alias("n_cols"))
    assert plain(units.where("type = 'TABLE'").select(*key, "text", "n_rows", "n_cols")) == plain(evidence.grid_text(grid).join(sizes, "table_id").select("table_id.*", "text", "n_rows", "n_cols"))
    places = units.groupBy("page").agg(F.sort_array(F.collect_list("place")).alias("p")).collect()
    assert all(r.p == list(range(len(r.p))) for r in places)
