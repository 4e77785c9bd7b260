"""Licence scans, the prefix trie and hard negatives against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin as GroupedData

from factloom.llm import licenses, negatives, prefixes

DOCS = "doc_id long, text string, w array<string>, t string, at int, word string"
TURNS = "conv_id long, turn long, role string, text string, c string, depth int, g long, place int"
VECTORS = "vec_id long, embedding array<double>, label int, row int, q string, id long, win int"


# Licences


def plain_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_places(words):
    found = []
    for t in licenses.TEMPLATES[:3]:
        found += [(i, t.label) for i in range(len(words)) if words[i : i + len(t.words)] == t.words]
    return found


def scanned(spark, texts):
    docs = spark.createDataFrame([(i, t, ["x"], "y", 0, "z") for i, t in texts], DOCS)
    return sorted(licenses.digest(licenses.scan(docs)).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_words))


def test_base_phrases_against_a_loop(spark):
    rng = random.Random(11)
    parts = ["Under the MIT License", "under the mit", "license", "Apache License, Version 2.0", "apache license version", "CC BY-NC", "cc by", "nc", "the", "mit", "é", "Under_the-MIT\tLICENSE", "2", "MIT License under", "\x00", "²apache"]
    texts = [(i, rng.choice([" ", "\n", ". "]).join(rng.choice(parts) for _ in range(rng.randrange(30)))) for i in range(150)]
    for r, (i, text) in zip(scanned(spark, texts), texts):
        words = plain_words(text)
        places = plain_places(words)
        starts = [p for p, _ in places]
        assert (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word) == (i, len(words), len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score > 0.99 or not places)


def test_own_templates_and_odd_rows(spark):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    long = "word " * 200_000 + gpl + " tail" * 50_000
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
    texts = [(0, gpl), (1, long), (2, None), (3, ""), (4, "general public license version 3 gnu"), (5, isc), (6, "GNU General Public License, version 3"), (6, "GNU General Public License, version 3"), (None, "cc-by-nc"), (7, "İ LİCENSE under the mit lKcense"), (8, "version 3")]
    got = scanned(spark, texts)
    assert len(got) == len(texts)
    by = {r.doc_id: r for r in got}
    assert by[0].labels == "gpl-3" and by[0].n_base == 0 and by[0].base_labels == "" and by[0].score == 1
    assert by[1].labels == "gpl-3" and by[1].n_words == 200_000 + 12 + 50_000
    assert (by[2].n_words, by[2].labels, by[2].score, by[2].first_word) == (0, "", 0, None) == (by[3].n_words, by[3].labels, by[3].score, by[3].first_word)
    assert by[4].labels == "" and by[5].labels == "isc" and by[7].labels == ""
    assert by[6].labels == "gpl-3" and 0 < by[6].score < 1  # it begins inside the template
    assert by[None].labels == "cc-by-nc" and by[8].labels == ""
    assert scanned(spark, []) == []


def test_every_template_finds_its_own_text(spark):
    texts = [(i, f"Header {i}. {t.text.replace('|', ' ').upper()} - tail") for i, t in enumerate(licenses.TEMPLATES)]
    for r, t in zip(scanned(spark, texts), licenses.TEMPLATES):
        assert t.label in r.labels.split(",") and r.score > 0.999


# Prefix trie


def plain_trie(turns):
    own = {}
    for c, n, role, text in turns:
        if c is not None:
            own.setdefault(c, []).append((n is not None, n or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + mine[h:])
    members, below = {}, {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    for node in members:
        if node:
            below.setdefault(node[:-1], []).append(node)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        kids = below.get(node, [])
        own_saved = (len(members[node]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0)
        ends = sorted(c for c in members[node] if built[c] == node)
        leaves, saved = (sum(out[k][5] for k in kids) if kids else 1), own_saved + sum(out[k][6] for k in kids)
        parent = min(members[node[:-1]]) if node else None
        out[node] = (min(members[node]), len(node), parent, len(members[node]), len(kids), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return sorted(out.values(), key=str)


def got_trie(spark, turns, parts=None, **kinds):
    df = spark.createDataFrame([(c, n, r, t, "x", 1, 2, 3) for c, n, r, t in turns], TURNS)
    out = prefixes.trie(df.repartition(parts) if parts else df, **kinds)
    return sorted((tuple(r) for r in out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def made_turns(rng, convs, alphabet=3):
    turns = []
    for c in rng.sample(range(-30, 200), convs):
        turns += [(c, n, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None, "d  e\tf"][: alphabet + 1])) for n in range(rng.randrange(1, 7))]
    return turns


@pytest.mark.parametrize("kinds", [{}, {"primes": (5, 7), "bases": (2, 3)}])
def test_trie_against_a_loop(spark, kinds):
    """Also with fingerprints of a few bits, where most groups hold collisions."""
    rng = random.Random(12)
    turns = made_turns(rng, 90) + [(c, n, "user", f"same {n}") for c in (400, 401, 402, 403, 410) for n in range(4)] + [(20, None, "system", "first"), (20, None, None, "first"), (40, 3, "u", "tie"), (40, 3, "u", "tie"), (41, 3, "u", "b"), (41, 3, "u", "a"), (None, 0, "user", "lost")]
    rng.shuffle(turns)
    assert got_trie(spark, turns, **kinds) == plain_trie(turns)


def test_long_conversations_lie_across_tasks(spark):
    """Two equal conversations of most rows, of which one is the other's base; hot first turns; ids without turns of their own."""
    long = [(c, n, "user", f"word {n % 50}" + " x" * (n % 3)) for c in (100, 101) for n in range(3000)]
    short = [(c, 0, "user", "hello there") for c in range(200, 420)] + [(c, 1, "assistant", f"reply {c % 7}") for c in range(200, 420, 2)]
    alone = [(c, 0, "user", "nothing is left") for c in range(2001, 2018)]  # no base: turnless where the head is longer than they are
    turns = long + short + alone
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got, want = got_trie(spark, turns), plain_sparse(turns)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == want
    assert any(r[1] == 0 and r[-1] != hashlib.sha256(b"").hexdigest() for r in got)


def plain_sparse(turns):
    """As plain_trie, with numbers for sequences: long ones would make long keys."""
    names, short = {}, []
    for c, n, role, text in turns:
        short.append((c, n, role, text))
    own = {}
    for c, n, role, text in short:
        own.setdefault(c, []).append((n, role, text))
    built = {}
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    members, parent, last, ends = {0: list(built)}, {}, {}, {}
    for c, seq in built.items():
        at = 0
        for turn in seq:
            node = names.setdefault((at, turn), len(names) + 1)
            parent[node], last[node], at = at, turn, node
            members.setdefault(node, []).append(c)
        ends.setdefault(at, []).append(c)
    depth, kids = {0: 0}, {}
    for node in sorted(parent):
        depth[node] = depth[parent[node]] + 1
        kids.setdefault(parent[node], []).append(node)
    out = {}
    for node in sorted(members, reverse=True):
        saved = (len(members[node]) - 1) * len(last[node][1].split()) if node else 0
        under = kids.get(node, [])
        out[node] = (min(members[node]), depth[node], min(members[parent[node]]) if node else None, len(members[node]), len(under), sum(out[k][5] for k in under) or 1, saved + sum(out[k][6] for k in under), hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest())
    return sorted(out.values(), key=str)


def test_trie_of_nothing(spark):
    assert got_trie(spark, []) == [] == got_trie(spark, [(None, 1, "a", "b")])
    one = got_trie(spark, [(3, 1, None, None)])
    assert one == plain_trie([(3, 1, None, None)])


# Hard negatives


def plain_negatives(rows):
    kept = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for n, (a, v, label) in enumerate(kept):
        if a is None or a % 100:
            continue
        others = [(dot(v, w), i, m, lab) for m, (i, w, lab) in enumerate(kept) if m != n and len(w) == len(v)]
        order = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
        for ps, p, _, _ in sorted((x for x in others if x[3] == label), key=order)[:5]:
            fits = sorted((x for x in others if x[3] != label and 30 * ps <= 100 * x[0] <= 90 * ps), key=order)[:10]
            out += [(a, p, k + 1, i, ps, s) for k, (s, i, _, _) in enumerate(fits)]
    return sorted(out, key=str)


def mined(spark, rows):
    df = spark.createDataFrame([(i, v, label, 1, "q", 2, 3) for i, v, label in rows], VECTORS)
    out = negatives.hard_negatives(df).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_negatives_against_a_loop(spark):
    rng = np.random.default_rng(13)
    centres = rng.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] + rng.normal(size=12) * 0.7).tolist(), int(rng.integers(0, 10))) for i in range(900)]
    assert mined(spark, rows) == plain_negatives(rows)


def test_negatives_of_odd_rows(spark):
    rng = np.random.default_rng(14)
    hot = [0.5, 0.25, -0.5]
    rows = [(i, hot, i % 3) for i in range(0, 700)]  # equal vectors: ties go by id
    rows += [(1000 + i, rng.normal(size=3).round(2).tolist(), int(rng.integers(0, 4))) for i in range(300)]
    rows += [(2000, None, 1), (2100, [1.0, math.nan, 0.0], 1), (2200, [1.0, math.inf, 0.0], 1), (2300, [1.0, None, 0.0], 1), (2400, hot, None), (2500, [1.0, 2.0], 1), (2501, [1.0, 2.0], 1), (2502, [0.5, 0.75], 2), (2600, [], 5), (2601, [], 5), (2602, [], 6), (2700, [0.0, 0.0, 0.0], 1), (None, hot, 1), (None, [0.4, 0.2, -0.4], 2), (1100, [1e6, -1e6, 3.0], 2), (1101, [1e6, 5.0, 1e5], 2), (1102, [4e5, 5.0, 1e5], 1)]
    assert mined(spark, rows) == plain_negatives(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0], 1)]) == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(15)
    q = np.floor(rng.normal(size=(3000, 64)) * 32).astype("i8")
    edges = negatives.edges_of(q[:1000])
    code = []
    for x in q:
        places = [np.searchsorted(e, v, side="right") - 1 for e, v in zip(edges, x)]
        code.append(bytes(places) if all(0 <= p < len(e) - 1 for p, e in zip(places, edges)) else None)
    low, high = negatives.bounds(code, q[:20], edges)
    exact = q[:20] @ q.T
    assert (low <= exact).all() and (exact <= high).all()
    rows = {"row": list(range(3000)), "id": list(range(3000)), "label": [i % 4 for i in range(3000)], "q": [x.astype("<i2").tobytes() for x in q], "code": code}
    anchors = {k: v[:20] for k, v in rows.items()}
    found, scored = negatives.block(rows, anchors, 64, edges, 5, False)
    assert scored < 20 * 750 * 0.25  # of 750 rows of the label each
    for i in range(20):
        same = [r for r in range(3000) if r % 4 == i % 4 and r != i]
        assert [r[2] for r in found if r[0] == i] == sorted(same, key=lambda r: (-exact[i, r], r))[:5]


def test_a_sample_brings_few_rows_to_the_driver(spark, monkeypatch):
    """The rows of smallest hashes, of which each task offers its share, not as many as the whole sample."""
    rows, key = spark.range(0, 40_000, 1, 32).withColumnRenamed("id", "row"), F.xxhash64(F.lit(13), "row")
    want = [r.row for r in rows.orderBy(key).limit(200).collect()]
    offered, plain = [], type(rows).orderBy
    monkeypatch.setattr(type(rows), "orderBy", lambda self, *c: offered.append(self.count()) or plain(self, *c))
    assert [r.row for r in negatives.smallest(rows, key, 200).collect()] == want and 200 <= offered[0] < 1200
    assert negatives.smallest(rows.limit(50), key, 200).count() == 50


def test_negatives_in_a_worker_that_has_imported_pyarrow_alone(spark, monkeypatch):
    """A fresh worker holds what the pickled function names: pyarrow's own attribute `compute` isn't there until someone imports it."""
    rows = spark.createDataFrame([(i, i, 0, 1, b"\1\0", None, [0]) for i in range(2)], "row long, id long, label long, dim int, q binary, code binary, wins array<long>")
    works = []
    meant = GroupedData.applyInArrow
    monkeypatch.setattr(GroupedData, "applyInArrow", lambda self, work, schema: works.append(work) or meant(self, work, schema))
    negatives.met(rows.drop("wins"), rows, {}, 2, 2, False)
    part = pa.table({"anchor": [False, True], "row": [0, 1], "id": [0, 1], "label": [0, 0], "q": [b"\1\0", b"\1\0"], "code": pa.nulls(2, pa.binary()), "wins": [None, [0]]})
    monkeypatch.delattr(pa, "compute", raising=False)
    assert works[0]((None, None, pa.scalar(1)), part).to_pylist() == [{"anchor_row": 1, "win": 0, "row": 0, "id": 0, "score": 1}]
