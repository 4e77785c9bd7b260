"""Operator 10: toxicity by Levenshtein automata over a lexicon trie, with context windows.

The lexicon is learned from training labels: words, and open stems that many endings follow, whose documents are
toxic far more often than others. Its trie is intersected with the Levenshtein automaton of distance one; the
product is determinised lazily, so that a word costs one step a character and most end after a few. Every hit
is weighed in its window: inside quotation marks or near reporting words it counts as quotation, else as abuse.
A logistic regression over these counts, fitted on the same bounded sample of training rows, gives the score.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, slices, table, trim

#: Labelled training rows that lexicon and weights are fitted on, at most (those of the smallest hashes), and entries.
SAMPLE, ENTRIES = 20_000, 400
WINDOW, STEM = 8, (4, 7)
FUZZY_FROM = 5  # letters from which a word may be misspelled
# Marks that open or close a quotation, and words that report one.
MARKS = "\"“”„«»‘’"
REPORTING = ("said", "says", "quote", "quoted", "wrote", "called", "dit", "sagte", "dijo")
FEATURES = ("any", "abuse", "stems", "misspelled", "quoted", "density")
WORD = re.compile(r"[^\W\d_]+")


def training(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) != 0


class Lexicon:
    """Trie of entries and its lazily determinised product with the distance-one Levenshtein automaton."""

    NONE, MISSPELLED, OPEN, EXACT = 0, 1, 2, 3

    def __init__(self, entries: list[tuple[str, bool]]):
        self.next: list[dict[str, int]] = [{}]
        self.word, self.open, self.long = [False], [False], [False]
        for text, is_open in entries:
            at = 0
            for c in text:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.word.append(False), self.open.append(False), self.long.append(False)
                at = self.next[at][c]
            if is_open:
                self.open[at] = True
            else:
                self.word[at] = True
                self.long[at] = len(text) >= FUZZY_FROM
        self.letters = {c for n in self.next for c in n}
        start = self.closed({(0, 0)})
        self.states, self.ids, self.moves, self.kinds = [start], {start: 0}, {}, [self.kind(start)]

    def closed(self, items: set[tuple[int, int]]) -> frozenset:
        """With the letters of the entry that the word may lack; node -1: an open stem has been read."""
        out = set(items)
        for node, errors in items:
            if node >= 0 and not errors:
                out |= {(n, 1) for n in self.next[node].values()}
        return frozenset(out)

    def kind(self, state: frozenset) -> int:
        best = self.NONE
        for node, errors in state:
            if node < 0 or (self.open[node] and not errors):
                best = max(best, self.OPEN)
            elif self.word[node] and not errors:
                best = max(best, self.EXACT)
            elif self.word[node] and self.long[node]:
                best = max(best, self.MISSPELLED)
        return best

    def step(self, state: int, c: str) -> int:
        out = set()
        for node, errors in self.states[state]:
            if node < 0 or (self.open[node] and not errors):
                out.add((-1, 0))
                if node < 0:
                    continue
            if c in self.next[node]:
                out.add((self.next[node][c], errors))
            if not errors:
                out.add((node, 1))
                out |= {(n, 1) for n in self.next[node].values()}
        to = self.closed(out)
        if to not in self.ids:
            self.ids[to] = len(self.states)
            self.states.append(to)
            self.kinds.append(self.kind(to))
        self.moves[state, c] = self.ids[to]
        return self.ids[to]

    def match(self, word: str) -> int:
        state, moves, letters = 0, self.moves, self.letters
        for c in word:
            c = c if c in letters else ""
            at = moves.get((state, c))
            state = self.step(state, c) if at is None else at
            if not self.states[state]:
                return self.NONE
        return self.kinds[state]


def features(text: str, lexicon: Lexicon, kept: dict[str, int]) -> list[float]:
    """Of one text, in the order of FEATURES."""
    text = text.lower()
    found = WORD.findall(text)
    hits = set()
    for word in set(found):
        kind = kept.get(word)
        if kind is None:
            if len(kept) > 200_000:
                kept.clear()
            kind = kept[word] = lexicon.match(word)
        if kind:
            hits.add(word)
    if not hits:
        return [0.0] * len(FEATURES)
    counts: dict[object, float] = defaultdict(float)
    places = list(WORD.finditer(text))
    for i, place in enumerate(places):
        if place[0] not in hits:
            continue
        low, high = places[max(0, i - WINDOW)].start(), places[min(len(places) - 1, i + WINDOW)].end()
        before, after = text[low : place.start()], text[place.end() : high]
        marked = any(m in before for m in MARKS) and any(m in after for m in MARKS)
        if marked or any(p[0] in REPORTING for p in places[max(0, i - WINDOW) : i]):
            counts["quoted"] += 1
        else:
            counts[kept[place[0]] if place[0] in kept else lexicon.match(place[0])] += 1
    told = counts[Lexicon.EXACT], counts[Lexicon.OPEN], counts[Lexicon.MISSPELLED]
    return [1.0 if told[0] + told[1] else 0.0, *(float(np.log1p(x)) for x in (*told, counts["quoted"])), 10.0 * (told[0] + told[1]) / len(found)]


def learn_lexicon(sample: DataFrame) -> list[tuple[str, bool]]:
    """sample: t, toxic. Entries by the significance of their documents' toxicity; the result holds ENTRIES at most."""
    texts = sample.select("toxic", F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(r"[\p{L}]{3,40}"), 0)).alias("ws"))
    words = texts.select("toxic", F.explode("ws").alias("w"))
    total, toxic = sample.agg(F.count("*"), F.sum("toxic")).first()
    if not toxic or toxic == total:
        return []
    rate = toxic / total

    def best(df: DataFrame, least: int):
        """By the log-likelihood ratio of the toxic share among the entry's documents; chance finds one above the bound in e**2 tables like this."""
        counts = cut(df.groupBy("w").agg(F.count("*").alias("n"), F.sum("toxic").alias("k")), "entries")
        bound = math.log(max(1, counts.count())) + 2
        n, k = F.col("n"), F.col("k")
        ratio = k * F.log(k / (n * rate)) + F.when(n > k, (n - k) * F.log((n - k) / (n * (1 - rate)))).otherwise(0.0)
        return counts.where((k >= least) & (k >= 0.8 * n)).withColumn("g", ratio).where(F.col("g") > bound).orderBy(F.desc("g"), "w").limit(ENTRIES).collect()

    whole = best(words, 3)
    def prefixes(w: Column) -> Column:
        some = F.transform(F.sequence(F.lit(STEM[0]), F.greatest(F.lit(STEM[0]), F.least(F.lit(STEM[1]), F.length(w) - 1))), lambda k: F.substring(w, F.lit(1), k))
        return F.when(F.length(w) > STEM[0], some).otherwise(F.array().cast("array<string>"))

    stems = texts.select("toxic", F.explode(F.array_distinct(F.flatten(F.transform("ws", prefixes)))).alias("w"))
    ended = words.where("toxic = 1").select("w").distinct().select(F.explode(prefixes(F.col("w"))).alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    # A stem is open when it has several distinct endings among toxic documents.
    stems = stems.join(ended.where("n >= 5").select(F.col("p").alias("w")), "w", "left_semi")
    opened: list[str] = []
    for r in sorted(best(stems, 5), key=lambda r: (len(r.w), -r.g)):
        if not any(r.w.startswith(p) for p in opened):
            opened.append(r.w)
    return [(p, True) for p in opened] + [(r.w, False) for r in whole if not any(r.w.startswith(p) for p in opened)]


def fit(rows: np.ndarray, labels: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression, the bias first, by Newton's method."""
    x = np.hstack([np.ones((len(rows), 1)), rows])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (labels - p) - ridge * w)
    return w


def featured(docs: DataFrame, lexicon: Lexicon, weights: np.ndarray | None = None) -> DataFrame:
    """docs: id, t. Gives id and features, or with weights id and score."""
    spread = docs.sparkSession.sparkContext.broadcast((lexicon, weights))  # of bounded size: ENTRIES
    kind = docs.schema["id"].dataType.simpleString()

    def work(batches):
        (own, w), kept = spread.value, {}
        for batch in slices(batches):
            x = [features(t, own, kept) if t else [0.0] * len(FEATURES) for t in batch.column(1).to_pylist()]
            if w is None:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["id", "x"])
            else:
                s = 1 / (1 + np.exp(-np.clip(w[0] + np.array(x).reshape(-1, len(FEATURES)) @ w[1:], -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["id", "score"])

    return docs.mapInArrow(work, f"id {kind}, x array<double>" if weights is None else f"id {kind}, score double")


def learned_model(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and weights, from `sample` labelled training rows at most."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & training(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    some = cut(marks.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(sample), "labels")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    learned = cut(texts.join(F.broadcast(some), "id"), "labelled")  # `sample` ids at most
    if learned.count() > sample:  # ids repeat
        learned = cut(learned.orderBy(F.xxhash64(F.col("id").cast("string")), "id", F.xxhash64("t")).limit(sample), "labelled")
    lexicon = Lexicon(learn_lexicon(learned))
    known = featured(learned.select(F.col("toxic").alias("id"), "t"), lexicon).collect()
    y = np.array([r.id for r in known], dtype=float)
    if len(y) and 0 < y.mean() < 1:
        weights = fit(np.array([r.x for r in known]), y)
    else:
        rate = min(max(y.mean() if len(y) else 0.0, 1e-9), 1 - 1e-9)
        weights = np.zeros(1 + len(FEATURES))
        weights[0] = np.log(rate / (1 - rate))
    return lexicon, weights


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted.

    Null and empty texts get the score of a text without hits. A document with several labels is toxic if one says
    so; null labels aren't used. Without training labels of both kinds every score is the toxic rate (0 without labels).
    Rows of equal or null ids are scored each by its text; null ids count as held out. Other columns aren't read.
    """
    lexicon, weights = learned_model(docs, labels, id_col, text_col, label_col, sample)
    out = featured(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")), lexicon, weights)
    return out.select(F.col("id").alias(id_col), F.coalesce(~training(F.col("id")), F.lit(True)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with all their columns, whose text isn't predicted toxic; each row is judged by itself, without a shuffle."""
    lexicon, weights = learned_model(docs, labels, id_col, text_col, label_col, sample)
    spread = docs.sparkSession.sparkContext.broadcast((lexicon, weights))  # of bounded size: ENTRIES
    at = docs.columns.index(text_col)

    def work(batches):
        (own, w), kept = spread.value, {}
        for batch in slices(batches):
            x = np.array([features(t, own, kept) if t else [0.0] * len(FEATURES) for t in batch.column(at).to_pylist()]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(w[0] + x @ w[1:] < 0, pa.bool_()))
        del kept
        trim()

    return docs.mapInArrow(work, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
