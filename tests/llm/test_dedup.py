"""Exact, line, near and suffix deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from factloom.llm import common, exact, lines, near, queries, suffixes

DOCS = "doc_id long, text string, lang string, n_chars long, id string, t string, h string"


def docs(spark, texts, ids=None):
    """With columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", 0, "x", "y", "z") for i, t in zip(ids or range(len(texts)), texts)], DOCS)


def words(rng, n, among=400):
    return " ".join(f"w{rng.randrange(among)}" for _ in range(n))


def test_components_against_a_loop(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 400)] + [(500, i) for i in range(501, 560)]
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for a, b in edges if a != b for n in (a, b)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


class Session:
    """A session without a checkpoint folder."""

    def __init__(self, master):
        self.sparkContext = self._jsc = self
        self.master, self.set_to = master, {}
        self.conf = self

    def sc(self):
        return self

    def getCheckpointDir(self):
        return self

    def isDefined(self):
        return False

    def get(self, key, default=None):
        return self.set_to.get(key, default)

    def set(self, key, value):
        self.set_to[key] = value


def test_the_shared_folder_is_the_sessions_own():
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            common.shared_dir(Session(master))
    for master in ("local", "local[*]", "local[8]", "local[4,2]"):
        session = Session(master)
        assert common.shared_dir(session).startswith("file:///") and common.shared_dir(session) == session.get("spark.checkpoint.dir")


def test_written_tables_go(spark):
    import glob

    root = common.shared_dir(spark).removeprefix("file://")
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long")
    before = set(glob.glob(f"{root}/*"))
    assert common.components(edges).count() == 31
    assert len(set(glob.glob(f"{root}/*")) - before) == 1  # the last round, which the result reads


def test_exact(spark):
    texts = ["a  b", "a b", None, "", " ", "a\tb", "x" * 100_000, "x" * 100_000, "a\u00a0b"]
    got = {r.doc_id: r for r in exact.classes(docs(spark, texts)).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    for t, members in groups.items():
        for i in members:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (members[0], len(members), i == members[0], hashlib.sha256(t.encode()).hexdigest())
    kept = exact.drop_copies(docs(spark, texts))
    assert kept.columns == docs(spark, texts).columns and sorted(r.doc_id for r in kept.collect()) == sorted(m[0] for m in groups.values())
    assert exact.classes(docs(spark, [])).count() == 0
    twice = {(r.keep_id, r.group_size) for r in exact.classes(docs(spark, ["q", "q"], [7, 7])).collect()}
    assert twice == {(7, 2)}


ROWS = [(1, "A"), (2, "A"), (2, "B"), (None, "A"), (None, "C c"), (None, "C  c"), (3, None), (4, ""), (2, "B"), (5, "x " * 50_000)]


def test_stages_keep_one_row_of_each_text(spark):
    """Rows of equal and of no id are told apart."""
    rows = spark.createDataFrame([(i, t, "en", n, "x", "y", "z") for n, (i, t) in enumerate(ROWS)], DOCS).repartition(3)
    for stage in (exact.drop_copies, near.drop_near):
        out = stage(rows)
        assert out.columns == rows.columns
        kept = sorted((r.doc_id or 0, (r.text or "").strip().replace("  ", " ")[:3]) for r in out.collect())
        assert kept == [(0, "C c"), (1, "A"), (2, "B"), (3, ""), (5, "x x")], stage
    assert sorted(map(tuple, exact.drop_copies(docs(spark, ["A", "A"], [1, 1])).collect())) == [(1, "A", "en", 0, "x", "y", "z")]
    assert exact.drop_copies(docs(spark, [])).count() == near.drop_near(docs(spark, [])).count() == 0


def test_near_keeps_rows_of_null_and_repeated_ids(spark):
    rng = random.Random(9)
    x = words(rng, 40)
    y, other = x + " more", words(rng, 40)
    got = near.classes(docs(spark, [x, other, y, y, other], [1, None, 3, 3, 1])).collect()
    assert sorted((r.doc_id or 0, r.class_id, r.class_size) for r in got) == [(0, 1, 2), (1, 1, 2), (1, 1, 3), (3, 1, 3), (3, 1, 3)]
    assert sum(r.kept for r in got) == 2
    alone = near.classes(docs(spark, [x, y], [None, None])).collect()
    assert [(r.class_id, r.class_size) for r in alone] == [(None, 2)] * 2 and sum(r.kept for r in alone) == 1


def test_lines_of_repeated_rows(spark):
    x = "\n".join(f"line {i}" for i in range(12))
    got = [(r.doc_id, r.n_lines, r.n_removed) for r in lines.removals(docs(spark, [x, x, x], [1, 2, 2])).collect()]
    gone = max(n for _, _, n in got)
    assert gone > 0 and sorted(got) == [(1, 12, 0), (2, 12, gone), (2, 12, gone)]
    # rows of one id and text: an id stands for its text, so both keep the first place
    assert all(r.n_removed == 0 for r in lines.removals(docs(spark, [x, x], [1, 1])).collect())
    no_id = lines.removals(docs(spark, [x, None, x], [None, None, 1])).collect()
    assert sorted((r.doc_id or 0, r.n_lines, r.n_removed) for r in no_id) == [(0, 1, 0), (0, 12, 0), (1, 12, gone)]
    long = "\n".join(f"own {i}" for i in range(40_000))
    big = lines.removals(docs(spark, [long, long + "\nend"]), with_text=True).collect()
    assert sorted(r.n_removed for r in big)[0] == 0 and max(r.n_removed for r in big) > 20_000


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), c.execute(queries.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert Counter(map(str, got[columns].itertuples(index=False, name=None))) == Counter(map(str, want[columns].itertuples(index=False, name=None)))


def brute_lines(texts):
    chunks = []
    for i, t in enumerate(texts):
        all_lines = (t or "").split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in all_lines]
        s = 0
        for j in range(len(all_lines)):
            if j == len(all_lines) - 1 or ((h[j - 1] if j else 0) * 31 + h[j]) % lines.DIVISOR == 0:
                chunks.append((i, s, j + 1))
                s = j + 1
    seen, gone = set(), {i: [] for i in range(len(texts))}
    for i, s, e in chunks:
        text = "\n".join((texts[i] or "").split("\n")[s:e])
        if e - s >= lines.MIN_LINES:
            if text in seen:
                gone[i].append((s, e))
            seen.add(text)
    out = []
    for i, t in enumerate(texts):
        out_lines = {k for s, e in gone[i] for k in range(s, e)}
        rest = "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in out_lines)
        out.append((len((t or "").split("\n")), len(out_lines), len(gone[i]), hashlib.sha256(rest.encode()).hexdigest()))
    return out


def test_lines(spark):
    rng = random.Random(2)
    passage = [words(rng, 5) for _ in range(12)]
    texts = [None, "", "\n", "\n\n\n\n", "one"]
    for _ in range(25):
        own = [words(rng, 4) for _ in range(rng.randint(0, 6))]
        at = rng.randint(0, len(own))
        texts.append("\n".join(own[:at] + passage[rng.randint(0, 3) :] + own[at:]))
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_spans, r.kept_sha256) for r in lines.removals(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_lines(texts)
    assert sum(n for _, n, _, _ in got.values()) > 100
    assert lines.removals(docs(spark, [])).count() == 0


def full_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance():
    rng = random.Random(3)
    for _ in range(400):
        a = [rng.randint(1, 4) for _ in range(rng.randint(0, 30))]
        b = list(a)
        for _ in range(rng.randint(0, 8)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = [rng.randint(1, 4)] * rng.randint(0, 1)
        x, y, d = np.array(a, np.uint64), np.array(b, np.uint64), full_distance(a, b)
        for most in (0, 2, 5, 40):
            want = d if d <= most else None
            assert near.distance(x, y, most) == want
            if a and b and abs(len(a) - len(b)) <= most:
                assert near._rows(x, y, most) == want == near._diagonals(x, y, most)


def test_sketches_keep_order_and_occurrence():
    a = near.word_codes("a b c d e f g h i j", {})
    assert (near.sketch(a) != near.sketch(a[::-1])).any()
    same = near.labelled(near.word_codes("x " * 20, {}))
    assert len(set(same.tolist())) == len(same) == 16


def test_near(spark):
    rng = random.Random(4)
    texts = [None, "", "  ", "a b c d", "a b c e", "A  b C d"]
    for _ in range(25):
        base = words(rng, rng.randint(30, 120)).split()
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            copy = list(base)
            for _ in range(rng.randint(1, 2)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(9999)}"
            texts.append(" ".join(copy))
    texts += [words(rng, 50) for _ in range(10)]
    got = {r.doc_id: r for r in near.classes(docs(spark, texts)).collect()}
    codes = [near.word_codes(t or "", {}) for t in texts]
    parent = list(range(len(texts)))

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i in range(len(texts)):
        for j in range(i):
            if (not len(codes[i]) and not len(codes[j])) or (len(codes[i]) and len(codes[j]) and (codes[i].tolist() == codes[j].tolist() or min(len(codes[i]), len(codes[j])) >= 5 and near.similar(codes[i], codes[j]))):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    assert {i: r.class_id for i, r in got.items()} == {i: root(i) for i in range(len(texts))}
    sizes = Counter(r.class_id for r in got.values())
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got.values())
    assert near.classes(docs(spark, [])).count() == 0


def brute_repeats(texts, length=400):
    n = Counter()
    for t in texts:
        b = (t or "").encode()
        n.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for t in texts:
        b = (t or "").encode()
        mark = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if n[b[i : i + length]] > 1:
                mark[i] += 1
                mark[i + length] -= 1
        gone, data = np.cumsum(mark[:-1]) > 0, np.frombuffer(b, np.uint8)
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(b) else 0
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
    return out


def passages_and_texts(rng, sizes):
    def some(n):
        return "".join(rng.choice("abcdefgh é") for _ in range(n))

    passages = [some(k) for k in sizes]
    texts = [None, "", "a" * 3000, "ab" * 500, "x" + "a" * 399, passages[1] + "1", passages[1] + "2"]
    for _ in range(40):
        t = some(rng.randint(0, 700))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            if rng.random() < 0.5:
                k = rng.randint(0, len(p))
                p = p[:k] + (some(1) if rng.random() < 0.5 else "") + p[k:]
            t += p + some(rng.randint(0, 500))
        texts.append(t)
    return passages, texts + [texts[20], texts[30][100:], texts[25][:-3], "q" + texts[26]]


def found_repeats(spark, texts, parts=5, **given):
    rows = suffixes.repeats(docs(spark, texts).repartition(parts), **given).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert len(rows) == len(texts)
    return [got[i] for i in range(len(texts))]


def test_repeats(spark):
    passages, texts = passages_and_texts(random.Random(5), (395, 399, 400, 401, 700, 2500))
    got = found_repeats(spark, texts)
    assert got == brute_repeats(texts) and sum(n > 0 for _, n, _, _ in got) > 20
    clean = suffixes.without_repeats(docs(spark, texts))
    assert clean.columns == docs(spark, texts).columns
    left = {r.doc_id: r.text for r in clean.collect()}
    assert len(left) == len(texts) and left[0] is None and left[2] == "" and all(len((left[i] or "").encode()) <= got[i][0] - got[i][1] for i in left)
    assert suffixes.repeats(docs(spark, [])).count() == 0 and suffixes.without_repeats(docs(spark, [])).count() == 0
    # rows of one id, and without one: each is a document
    rows = [passages[5], passages[5], "short", passages[5], passages[4]]
    twice = suffixes.repeats(docs(spark, rows, [1, 1, None, None, 1])).collect()
    n = len(passages[5].encode())
    assert sorted((r.doc_id or 0, r.n_removed) for r in twice) == [(0, 0), (0, n), (1, 0), (1, n), (1, n)]
    stage = suffixes.without_repeats(docs(spark, rows, [1, 1, None, None, 1])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in stage) == sorted([(0, "short"), (0, ""), (1, ""), (1, ""), (1, passages[4])])


@pytest.mark.parametrize(("length", "parts"), [(8, 1), (11, 7), (200, 3)])
def test_repeats_of_other_lengths(spark, length, parts):
    rng = random.Random(length)
    _, texts = passages_and_texts(rng, [length + k for k in (-5, -1, 0, 1, 90, 700)])
    texts += ["".join(rng.choice("ab") for _ in range(rng.randint(0, 3 * length))) for _ in range(30)]
    assert found_repeats(spark, texts, parts, length=length) == brute_repeats(texts, length)


def test_repeats_of_a_very_long_text(spark):
    rng = np.random.default_rng(3)
    long = bytes(rng.integers(97, 123, 3_000_000, dtype=np.uint8)).decode()
    texts = [long, long[1_000_000:1_000_399], long[2_000_000:2_000_700], "." + long[2_500_000:2_500_400]]
    assert [r[1] for r in found_repeats(spark, texts)] == [1100, 0, 700, 400]


def test_passages_of_words(spark):
    """The stage's rule: runs of repeated bytes that hold over 50 words."""
    rng = random.Random(8)
    long, short = words(rng, 51, 10**6), " ".join(f"{rng.randrange(10**9):09}" for _ in range(40))
    texts = [f"{rng.random()} {p} {rng.random()}" for p in (long, long, short, short)]
    left = [r.text for r in suffixes.without_repeats(docs(spark, texts), length=256, min_words=51).orderBy("doc_id").collect()]
    assert all(long not in t for t in left[:2]) and left[2:] == texts[2:]


def test_phrases_are_cut_alike_wherever_they_stand():
    rng = np.random.default_rng(4)
    passage, cuts = rng.integers(0, 256, 5000, dtype=np.uint8), []
    k, w = suffixes.sampling(400)
    for n in (0, 1, 333):
        data = np.concatenate([rng.integers(0, 256, n, dtype=np.uint8), passage, rng.integers(0, 256, 50, dtype=np.uint8)])
        start, low = suffixes.parsed(data, np.array([0, len(data)]), 400)
        assert start[0] == 0 and start[-1] == len(data) and (np.diff(start) <= w + k).all()
        inner = start[(start >= n + w + k) & (start < n + 5000 - w - k)] - n
        cuts.append(inner.tolist())
        assert len(start) > 5000 / w
        digest = suffixes.digests(data, start)
        assert len(set(digest.tolist())) == len(start) - 1
    assert cuts[0] == cuts[1] == cuts[2]


def test_stretches_change_nothing(monkeypatch):
    rng = np.random.default_rng(6)
    data = rng.integers(97, 100, 9000, dtype=np.uint8)
    data[3000:4000] = 97
    base = np.array([0, 1500, 1990, 6000, 9000])
    whole = suffixes.parsed(data, base, 400)
    digest = suffixes.digests(data, whole[0])
    monkeypatch.setattr(suffixes, "STRETCH", 700)
    for a, b in zip((*whole, digest), (*suffixes.parsed(data, base, 400), suffixes.digests(data, whole[0]))):
        assert (a == b).all()


def test_a_shards_suffixes_are_in_order():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 3000, dtype=np.uint8)
    base = np.array([0, 1100, 2000, 3000])
    start, low = suffixes.parsed(data, base, 60)
    none = np.zeros(0, np.int64)
    _, names = np.unique([data[a:b].tobytes() for a, b in zip(start, start[1:])], return_inverse=True)
    names = np.where(np.bincount(names)[names] > 1, names, -1)
    shard = suffixes.Shard(60, np.arange(3), base, start, low, [names], none, none, none, none)
    shard.sort()
    runs = shard.runs()
    suffix = [tuple(names[i : i + runs[i]].tolist()) for i in shard.order]
    depth = 1 << (shard.deepest() - 1).bit_length()
    assert [x[:depth] for x in suffix] == sorted(x[:depth] for x in suffix) and len(suffix) == (names >= 0).sum()
    for i in range(1, len(suffix)):
        same = 0
        while same < min(len(suffix[i - 1]), len(suffix[i])) and suffix[i - 1][same] == suffix[i][same]:
            same += 1
        assert min(same, shard.common[i]) == shard.common[i] and (shard.common[i] == same or shard.common[i] >= depth)


def test_words_of_scripts_without_spaces(spark):
    """A passage of 60 ideographs holds over 50 words; one of 60 letters is one word."""
    rng = random.Random(77)
    han, letters = "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(100)), "".join(rng.choice("abcdefghijk") for _ in range(300))
    texts = [f"eins {han} zwei", f"drei {han} vier", f"one {letters} two", f"three {letters} four"]
    left = [r.text for r in suffixes.without_repeats(docs(spark, texts), length=200, min_words=51).orderBy("doc_id").collect()]
    assert han[5:-5] not in left[0] and han[5:-5] not in left[1] and left[2:] == texts[2:]
    assert suffixes.n_words("a b c".encode()) == 3 and suffixes.n_words(("x " + han).encode()) == 102 and suffixes.n_words("ein Wört".encode()) == 2


def test_near_beyond_a_groups_leaders(spark, monkeypatch):
    """Texts that share a passage share its sketches; two similar ones among them may both be unlike the first and the last of the group."""
    monkeypatch.setattr(near, "BLOCK", 4)  # several blocks
    rng = random.Random(11)
    passage = words(rng, 40).split()
    texts = []
    for i in range(24):
        own = [f"w{i % 12 if 4 <= i < 20 else i + 100}x{j}" for j in range(60)]
        if i >= 12:
            own[5] = "changed"
        texts.append(" ".join(passage + own))
    monkeypatch.setattr(near, "sketch", lambda codes: np.arange(near.SKETCHES, dtype=np.uint64))  # one group for each sketch
    codes = [near.word_codes(t, {}) for t in texts]
    want = {i: min(j for j in range(24) if j == i or near.similar(codes[i], codes[j])) for i in range(24)}
    assert want[16] == 4 and want[19] == 7 and want[23] == 23
    assert {r.doc_id: r.class_id for r in near.classes(docs(spark, texts)).collect()} == want


def test_words_have_one_hash_wherever_they_stand(monkeypatch):
    """Words are hashed by their bytes, some at a time, whatever parts them and whatever their length."""
    words = ["the", "The", "éa", "\u4e2d\u6587", "x" * 300, "a\u0301", "the", "b"]
    text = "\u3000" + "\t\n".join(words) + "\u2003 "
    whole = near.word_codes(text)
    assert near.word_codes(" \n").size == 0
    assert [int(near.word_codes(w)[0]) for w in words] == whole.tolist() and len(set(whole.tolist())) == len({w.lower() for w in words})
    monkeypatch.setattr(near, "STRETCH", 5)
    assert near.word_codes(text).tolist() == whole.tolist()
    rng = np.random.default_rng(5)
    h = near.labelled(rng.integers(0, 1 << 40, 60, dtype=np.uint64))
    keys = h[None, :] * near.FACTORS[:, None] + near.SHIFTS[:, None]
    keys = (keys ^ (keys >> np.uint64(31))) * near.STEP
    for i, found in enumerate(near.sketch_places(h)):
        assert found.tolist() == sorted(np.argsort(keys[i])[: near.MINIMA].tolist())
