"""Operator 8: URL filter by rules and, where no rule fits, by the ratio of two character language models.

The models are variable-order Markov chains over the characters of accepted and rejected URLs, smoothed by
interpolating each order with the next lower one (Witten-Bell weights). Training URLs are those that a rule
decides, so nothing is labelled by hand. The log-likelihood difference by character is calibrated on held-out
training URLs: the threshold is the one at which balanced errors are fewest.

judge() fits them on all URLs that a rule decides. Counts are tables of character runs: a character's probability rests on the run of up to
ORDER characters before it and itself, so it is worked out once for each distinct run that is asked for, and a URL's score is a
sum over its runs. No model is held in one place; Ratio is the same for lists of URLs.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop, slices, table

#: (host, path, verdict) in the contract's order.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
ORDER = 5
#: One in HELD_OUT of the labelled URLs of a verdict, in the order of their hashes, calibrates.
HELD_OUT = 5
#: Runs of characters that a task counts before it passes them on.
COUNTED = 100_000


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: str) -> tuple[Column, Column]:
    """Host and path; null or no '://' gives both empty."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.col(url).substr(at + 3, F.length(url))).otherwise("")
    whole = F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^([^/?#]*)([^?#]*)", 2)
    return lower_ascii(whole), path


def with_rule(pages: DataFrame, host: str = "host", path: str = "path", rules=RULES) -> DataFrame:
    """Adds rule and rule_verdict: of the rules that fit, the longest as written; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("rule_verdict", verdict)


class Markov:
    """Character counts after each context of up to `order` characters."""

    def __init__(self, order: int = ORDER):
        self.order, self.seen = order, defaultdict(dict)

    def learn(self, text: str) -> None:
        text = "\x02" + text + "\x03"
        for i in range(1, len(text)):
            for k in range(min(self.order, i) + 1):
                after = self.seen[text[i - k : i]]
                after[text[i]] = after.get(text[i], 0) + 1

    def close(self) -> None:
        self.total = {c: (sum(a.values()), len(a)) for c, a in self.seen.items()}

    def log(self, text: str) -> float:
        """Natural log-likelihood."""
        text, out = "\x02" + text + "\x03", 0.0
        for i in range(1, len(text)):
            p = 1.0 / 0x110000
            for k in range(min(self.order, i) + 1):
                if (c := text[i - k : i]) not in self.total:
                    break
                n, kinds = self.total[c]
                p = (self.seen[c].get(text[i], 0) + kinds * p) / (n + kinds)
            out += math.log(p)
        return out


class Ratio:
    def __init__(self, allowed: list[str], blocked: list[str], order: int = ORDER):
        """Without training URLs on either side, all URLs are allowed."""
        self.allow, self.block, self.threshold = Markov(order), Markov(order), -math.inf
        if not allowed or not blocked:
            self.allow.close(), self.block.close()
            return
        for model, texts in ((self.allow, allowed), (self.block, blocked)):
            for i, text in enumerate(texts):
                if i % HELD_OUT or len(texts) < 2 * HELD_OUT:
                    model.learn(text)
            model.close()
        marks = sorted([(self.score(t), True) for t in allowed[::HELD_OUT]] + [(self.score(t), False) for t in blocked[::HELD_OUT]])
        n_allowed, n_blocked = len(allowed[::HELD_OUT]), len(blocked[::HELD_OUT])
        best, error, self.threshold = 0, 0, marks[0][0] - 1e-9
        for i, (score, good) in enumerate(marks):
            error += n_blocked if good else -n_allowed
            if (i + 1 == len(marks) or marks[i + 1][0] > score) and error < best:
                best, self.threshold = error, score + 1e-9 if i + 1 == len(marks) else (score + marks[i + 1][0]) / 2

    def score(self, text: str) -> float:
        return (self.allow.log(text) - self.block.log(text)) / (len(text) + 1)


def runs(text: str, order: int) -> list[str]:
    """Each character with those before it that it may depend on."""
    text = "\x02" + text + "\x03"
    return [text[max(0, i - order) : i + 1] for i in range(1, len(text))]


def _counted(order: int):
    def work(batches):
        found: tuple[Counter, Counter] = Counter(), Counter()

        def sent():
            every = list(found[0] | found[1])
            out = pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *(pa.array([c[r] for r in every], pa.int64()) for c in found)], ["run", "a", "b"])
            found[0].clear(), found[1].clear()
            return out

        for batch in slices(batches):
            for side, text in zip(batch.column("side").to_pylist(), batch.column("t").to_pylist()):
                found[side == "block"].update(runs(text, order))
                if len(found[0]) + len(found[1]) > COUNTED:
                    yield sent()
        yield sent()

    return work


def _asked(order: int):
    def work(batches):
        for batch in slices(batches):
            each = [Counter(runs(t, order)) for t in batch.column("t").to_pylist()]
            at = pa.array([i for i, c in enumerate(each) for _ in c], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("side").take(at), pa.array([r for c in each for r in c], pa.string()), pa.array([n for c in each for n in c.values()], pa.int32())], ["id", "side", "run", "n"])

    return work


def in_order(rows: DataFrame, *by: str) -> DataFrame:
    """rows, written out in order with a rising id whose high bits name the partition."""
    return cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("id", F.monotonically_increasing_id()), "ordered")


def probabilities(learned: DataFrame, asked: DataFrame) -> DataFrame:
    """learned: run, a, b (how often among allowed and blocked URLs); asked: run, distinct. run, d: the difference of the logarithms of both models' probabilities."""
    ends = lambda n: F.expr(f"right(run, {n})")
    suffixes = learned.select(F.explode(F.sequence(F.lit(1), F.length("run"))).alias("n"), "run", "a", "b").select(ends("n").alias("g"), "a", "b")
    seen = cut(suffixes.groupBy("g").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "seen")
    before = F.expr("left(g, length(g) - 1)").alias("c")
    # Written out, so that the join after it stands alone and the rows of a common context can be split.
    after = cut(seen.groupBy(before).agg(F.sum("a").alias("n_a"), F.count_if(F.col("a") > 0).alias("kinds_a"), F.sum("b").alias("n_b"), F.count_if(F.col("b") > 0).alias("kinds_b")), "after")
    each = asked.select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("n")).select("run", "n", ends("n").alias("g"))
    counts = ["a", "n_a", "kinds_a", "b", "n_b", "kinds_b"]
    met = each.join(seen, "g", "left").select("run", "n", before, "a", "b").join(after, "c", "left").select("run", "n", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts))
    orders = met.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("n", *counts))).alias("orders"))

    def p(s: str) -> Column:  # from the empty context up; what follows a context that wasn't seen wasn't either
        return F.aggregate("orders", F.lit(1.0 / 0x110000), lambda p, x: F.when(x[f"n_{s}"] > 0, (x[s] + x[f"kinds_{s}"] * p) / (x[f"n_{s}"] + x[f"kinds_{s}"])).otherwise(p))

    out = cut(orders.select("run", (F.log(p("a")) - F.log(p("b"))).cast("decimal(18,15)").alias("d")), "logs")  # sums of decimals don't hang on their order
    drop(seen, after)
    return out


def threshold_of(held: DataFrame) -> float:
    """held: side, score. As Ratio's: the first of the scores at which balanced errors are fewest. Sums by partition alone come to the driver."""
    allowed = F.col("side") == "allow"
    marks = in_order(held.groupBy("score").agg(F.count_if(allowed).alias("a"), F.count_if(~allowed).alias("b")), "score")
    part = F.shiftright("id", 33).alias("part")
    sums = sorted(marks.groupBy(part).agg(F.sum("a"), F.sum("b")).collect())
    n_a, n_b = sum(r[1] for r in sums), sum(r[2] for r in sums)
    so_far = [(r[0], sum(x[1] for x in sums[:i]), sum(x[2] for x in sums[:i])) for i, r in enumerate(sums)]
    offsets = F.broadcast(held.sparkSession.createDataFrame(so_far, "part long, a_before long, b_before long"))
    up = Window.partitionBy("part").orderBy("id")
    error = (F.sum("a").over(up) + F.col("a_before")) * n_b - (F.sum("b").over(up) + F.col("b_before")) * n_a
    best = marks.select("*", part).join(offsets, "part").select(error.alias("error"), "score").agg(F.min(F.struct("error", "score")).alias("best"), F.min("score").alias("least")).first()
    if best.best.error >= 0:
        found = best.least - 1e-9
    else:
        following = marks.where(F.col("score") > best.best.score).agg(F.min("score")).first()[0]
        found = best.best.score + 1e-9 if following is None else (best.best.score + following) / 2
    drop(marks)
    return found


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, order: int = ORDER) -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict, score (null where a rule decides).

    Null URLs and those without '://' have an empty host and path and are judged by the models. Rows with the
    same id or URL are judged alike. The models are fitted on all distinct URLs that a rule decides.
    """
    host, path = parts(url_col)
    base = with_rule(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("u"), host.alias("host"), path.alias("path")), rules=rules).withColumn("t", F.concat("host", "path"))
    texts = in_order(base.select(F.coalesce("rule_verdict", F.lit("")).alias("side"), "t").distinct().withColumn("h", F.xxhash64("t")), "side", "h", "t")
    part = F.shiftright("id", 33).alias("part")
    # A row for each partition and verdict comes to the driver.
    totals, shifts = Counter(), []
    for r in sorted(texts.where("side <> ''").groupBy(part, "side").agg(F.min("id").alias("least"), F.count("*").alias("n")).collect()):
        shifts.append((r.part, r.side, r.least - totals[r.side]))
        totals[r.side] += r.n
    decided = base.where("rule_verdict is not null").select(F.col("id").alias(id_col), "host", "path", "rule", F.col("rule_verdict").alias("verdict"), F.lit(None).cast("double").alias("score"))
    open_ = base.where("rule_verdict is null")
    if not totals["allow"] or not totals["block"]:
        drop(texts)
        return decided.unionByName(open_.select(F.col("id").alias(id_col), "host", "path", "rule", F.lit("allow").alias("verdict"), F.lit(0.0).alias("score")))

    shift = F.broadcast(pages.sparkSession.createDataFrame(shifts, "part long, side string, shift long"))
    labelled = texts.where("side <> ''").select("id", "side", "t", part).join(shift, ["part", "side"])
    held = (F.col("id") - F.col("shift")) % HELD_OUT == 0
    few = [side for side, n in totals.items() if n < 2 * HELD_OUT]
    learned = cut(labelled.where(~held | F.col("side").isin(few)).select("side", "t").mapInArrow(_counted(order), "run string, a long, b long").groupBy("run").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "learned")
    asked = texts.where("side = ''").select("id", "side", "t").unionByName(labelled.where(held).select("id", "side", "t"))
    places = cut(asked.mapInArrow(_asked(order), "id long, side string, run string, n int"), "places")
    logs = probabilities(learned, places.select("run").distinct())
    scores = cut(places.join(logs, "run").groupBy("id", "side").agg((F.sum(F.col("n") * F.col("d")).cast("double") / F.sum("n")).alias("score")), "scores")
    drop(learned, places, logs)
    threshold = threshold_of(scores.where("side <> ''").select("side", "score"))
    found = cut(texts.where("side = ''").select("id", "t").join(scores.select("id", "score"), "id").select("t", "score"), "judged")
    drop(texts, scores)
    verdict = F.when(F.col("score") >= threshold, "allow").otherwise("block").alias("verdict")
    return decided.unionByName(open_.join(found.hint("merge"), "t").select(F.col("id").alias(id_col), "host", "path", "rule", verdict, "score"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
