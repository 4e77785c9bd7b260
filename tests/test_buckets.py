"""Tables in buckets: merges that touch few of them, look-ups, and runs of extraction that are stopped."""

import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from test_api import TEXTS, Reader

from factloom.plans.api import Workspace
from factloom.sources import buckets

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests
cloudpickle.register_pickle_by_value(sys.modules["test_api"])
KINDS = "id string, part string, n long"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_merge_writes_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    first = [(f"k{i}", p, i) for i in range(200) for p in "ab"]
    table = buckets.write(spark.createDataFrame(first, KINDS), path, ["id"], 8)
    assert rows(buckets.read(spark, path, table)) == sorted(first) and len(table["at"]) == 8
    # by the whole key, and by a part of it: rows that have it go, the given ones come
    one = spark.createDataFrame([("k7", "a", -1)], KINDS)
    then = buckets.merge(path, table, one, one.select("id", "part"))
    assert [b for b in then["at"] if then["at"][b] != table["at"].get(b)] == [str(buckets_of(spark, "k7", 8))]
    assert rows(buckets.read(spark, path, then)) == sorted([x for x in first if x[:2] != ("k7", "a")] + [("k7", "a", -1)])
    gone = buckets.merge(path, then, one.limit(0), spark.createDataFrame([("k7",), ("none",)], "id string"))
    assert rows(buckets.read(spark, path, gone)) == sorted(x for x in first if x[0] != "k7")
    assert rows(buckets.read(spark, path, table)) == sorted(first)  # the old description still holds
    # columns that come later, an empty table, and nothing to merge
    wider = spark.createDataFrame([("k1", "c", 5, True)], KINDS + ", more boolean")
    now = buckets.read(spark, path, buckets.merge(path, gone, wider, wider.select("id", "part")))
    assert now.where("more").count() == 1 and now.where("more is null").count() == 398
    empty = buckets.write(one.limit(0), path, ["id"])
    assert empty["at"] == {} and buckets.read(spark, path, empty).count() == 0
    assert rows(buckets.read(spark, path, buckets.merge(path, empty, one, one.select("id")))) == [("k7", "a", -1)]
    same = buckets.merge(path, gone, one.limit(0), one.select("id").limit(0))
    assert same["at"] == gone["at"]


def buckets_of(spark, key, n):
    return spark.createDataFrame([(key,)], "id string").select(buckets.bucket(["id"], n)).first()[0]


@pytest.mark.parametrize("named", [1, 1000])
def test_look_ups_read_their_buckets(spark, tmp_path, monkeypatch, named):
    monkeypatch.setattr(buckets, "NAMED", named)
    path = str(tmp_path / "t")
    table = buckets.write(spark.createDataFrame([(f"k{i}", "a", i) for i in range(500)], KINDS), path, ["id"], 16)
    found = buckets.look_up(spark, path, table, ["k3", "k77", "lost"])
    assert rows(found) == [("k3", "a", 3), ("k77", "a", 77)]
    read = {f.split("bucket=")[1].split("/")[0] for f in found.inputFiles()}
    assert read <= {str(buckets_of(spark, k, 16)) for k in ("k3", "k77", "lost")}
    assert buckets.look_up(spark, path, table, []).count() == 0
    if named > 1:
        assert "PushedFilters: [In(id" in found._jdf.queryExecution().executedPlan().toString().replace("*", "")


class Stops(Reader):
    """Answers until a mark is there, and counts what it is asked."""

    def __init__(self, path, stop_at):
        self.path, self.stop_at = path, stop_at

    def run(self, rows):
        for r in rows:
            open(f"{self.path}/{abs(hash(r['prompt']))}-{os.getpid()}-{os.urandom(4).hex()}", "w").close()
        if self.stop_at is not None and len(os.listdir(self.path)) >= self.stop_at:
            raise SystemExit("killed")
        return super().run(rows)


def test_a_stopped_run_resumes(spark, tmp_path):
    w = Workspace(spark, str(tmp_path / "w"))
    docs = [(i, f"Alpha {i} | revenue | {i} | Rs crore | FY24") for i in range(12)]
    w.ingest(spark.createDataFrame(docs, "doc_id long, text string"))
    (tmp_path / "asked").mkdir()
    with pytest.raises(Exception, match="killed|SystemExit|crashed|exited|EOF"):
        w.extract_facts(Stops(str(tmp_path / "asked"), 8), commit_every=3)
    kept = w.table("facts").count() if w._has("facts") else 0
    asked = len(os.listdir(tmp_path / "asked"))
    assert 0 < kept < 12 and w.table("extraction_chunks").where("status = 'COMPLETED'").count() == kept
    report = w.extract_facts(Stops(str(tmp_path / "asked"), None), commit_every=3)
    assert w.table("facts").count() == 12 == w.table("extraction_chunks").where("status = 'COMPLETED'").count()
    assert len(os.listdir(tmp_path / "asked")) - asked == 12 - kept  # what was stored isn't asked again
    assert report.agg(F.sum("chunks_processed"), F.sum("chunks_skipped"), F.sum("facts_saved")).first() == (12 - kept, kept, 12 - kept)


def test_a_small_change_writes_little(spark, tmp_path):
    w = Workspace(spark, str(tmp_path / "w"))
    w.ingest(spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string"))
    w.extract_facts(Reader())
    w.match_changes()
    before = w.versions()
    assert all(isinstance(before[n], dict) for n in ("documents", "evidence", "facts", "relationships", "extraction_chunks"))
    one = w.table("facts").where("value_text = '5,000'")
    changed = one.withColumn("normalized_number", F.col("normalized_number") * 3)
    w.merge(facts=(changed, changed.select("fact_id")))
    now = w.versions()
    assert sum(now["facts"]["at"][b] != before["facts"]["at"].get(b) for b in now["facts"]["at"]) == 1 and w.table("facts").count() == 6
    assert w.fact(one.first().fact_id).first().normalized_number == 3 * one.first().normalized_number
    told = w.match_changes().first()
    assert (told.new, told.changed, told.gone) == (0, 1, 0)
    assert w.vacuum() == 0  # too fresh
    data = {n: rows(w.table(n).select(sorted(c for c, t in w.table(n).dtypes if not t.startswith("array")))) for n in ("facts", "relationships", "documents")}
    assert w.vacuum(hours=0) > 0 and w.vacuum(hours=0) == 0
    assert data == {n: rows(w.table(n).select(sorted(c for c, t in w.table(n).dtypes if not t.startswith("array")))) for n in data}
