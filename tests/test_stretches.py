"""Packing by stretches against a loop, the fold, and through a workspace."""

import functools
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import chunking, stretches
from factloom.plans.api import Workspace

KINDS = "document_id string, page int, item struct<a:int,b:long>, chars long, tokens long, opens boolean"


def looped(rows, max_chars, max_tokens):
    """Chunk of each item, one by one."""
    found, at = {}, {}
    for d, p, item, chars, tokens, opens in sorted(rows, key=lambda r: (r[0] or "", r[0] is not None, -1 if r[1] is None else r[1], r[2])):
        chars, tokens = chars or 0, tokens or 0
        chunk, c, t, some = at.get((d, p), (-1, 0, 0, False))
        if not some or opens or c + chars > max_chars or t + tokens > max_tokens:
            chunk, c, t = chunk + 1, 0, 0
        at[d, p] = chunk, c + chars, t + tokens, not (chars > max_chars or tokens > max_tokens)
        found[d, p, item] = chunk
    return found


def made(rng, pages, longest, most):
    sizes = {"even": lambda: rng.randint(1, most), "small": lambda: rng.choice([0, 0, 0, 1]), "odd": lambda: rng.choice([0, 1, 3, most // 2, most, most + 1, 3 * most, None])}
    rows = []
    for d, p in pages:
        kind = sizes[rng.choice(list(sizes))]
        for i in range(rng.randint(1, longest)):
            rows.append((d, p, (i // 3, i % 3), kind(), kind(), rng.choice([None, False, False, rng.random() < 0.05])))
    return rows


@pytest.mark.parametrize("seed,stretch", [(1, 4), (2, 7), (3, 64), (4, 1), (5, 1 << 14)])
def test_stretches_against_a_loop(spark, tmp_path, seed, stretch):
    rng = random.Random(seed)
    rows = made(rng, [(d, p) for d in ("a", "b", "", None) for p in (0, 1, None)], 150, 40)
    units = spark.createDataFrame(rows, KINDS).repartition(5)
    got = stretches.packed(units, 60, 55, path=str(tmp_path), stretch=stretch).collect()
    assert {(r.document_id, r.page, tuple(r.item)): r.chunk for r in got} == looped(rows, 60, 55) and len(got) == len(rows)
    fold = chunking.packed(units.withColumn("opens", F.coalesce("opens", F.lit(False))), 60, 55).collect()
    assert sorted(map(str, fold)) == sorted(map(str, got))


def test_no_items_and_no_token_limit(spark, tmp_path):
    units = spark.createDataFrame([], KINDS)
    assert stretches.packed(units, 10, path=str(tmp_path)).count() == 0
    rows = [("d", 0, (0, i), 3, 10**9, False) for i in range(50)]
    got = stretches.packed(spark.createDataFrame(rows, KINDS).drop("opens"), 10, path=str(tmp_path), stretch=8)
    assert {(r.document_id, r.page, tuple(r.item)): r.chunk for r in got.collect()} == looped(rows, 10, 1 << 40)


def test_one_page_is_many_tasks(spark, tmp_path):
    n = 200_000
    units = spark.range(n).select(F.lit("d").alias("document_id"), F.lit(0).alias("page"), F.col("id").alias("item"), (F.col("id") * 7919 % 101).alias("chars"), F.lit(1).alias("tokens"))
    got = stretches.packed(units, 997, path=str(tmp_path), stretch=1000)
    rows = [("d", 0, i, i * 7919 % 101, 1, False) for i in range(n)]
    want = looped(rows, 997, 1 << 40)
    assert all(want["d", 0, r.item] == r.chunk for r in got.select("item", "chunk").collect())
    tables = [p for p in tmp_path.glob("stretches-*")]
    sizes = spark.read.parquet(str(tables[0])).groupBy("block").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= 1000 and sizes[1] >= 200


def test_workspace_packs_long_pages_by_stretches(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([("1", "\n".join(f"Line {i} says {i * 37 % 1000} units of {'x' * (i % 90)}" for i in range(60))), ("report e", "one 1")], "doc_id string, text string")
    cells = [("1", 1, 0, r, c, f"cell {r} {c}" if r else f"head {c}") for r in range(50) for c in range(3)]
    w = Workspace(spark, str(tmp_path / "w"))
    w.ingest(docs, spark.createDataFrame(cells, "document_id string, page int, table_index int, row int, col int, text string"))
    columns = ["document_id", "page", "chunk", "evidence_id", "text"]
    fold = sorted(map(tuple, w.chunks(300).select(columns).collect()))
    assert len({r[:3] for r in fold}) > 10
    monkeypatch.setattr(chunking, "FOLD_UP_TO", 10)
    monkeypatch.setattr(stretches, "packed", functools.partial(stretches.packed, stretch=16))
    assert sorted(map(tuple, w.chunks(300).select(columns).collect())) == fold
    assert list((tmp_path / "w" / "stretches").iterdir())
    w.vacuum(hours=0)
    assert not list((tmp_path / "w" / "stretches").iterdir())
