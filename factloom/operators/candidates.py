"""Candidate pairs: exhaustive by lossless blocking, nearest vectors, shared words, and the choice among them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import folded, jaccard, present, tokens

from .compare import CLAIM_FROM, OVERLAP_FROM, SUBJECT_FROM, effective, prepared, side
from .nearest import neighbours

EXHAUSTIVE_UP_TO, TOP_K, FLOOR = 250_000, 10, 0.25


def eligible(include_same_document: bool = False) -> Column:
    """Of an unordered pair, once: other document, or also the same one."""
    once = F.col("a_fact_id") < F.col("b_fact_id")
    return once if include_same_document else once & (F.col("a_document_id") != F.col("b_document_id"))


def space(facts: DataFrame, include_same_document: bool = False) -> DataFrame:
    """Number of eligible unordered pairs, in closed form from the facts per document."""
    per = facts.groupBy("document_id").agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("s"))
    return total.select(F.coalesce((F.expr("t * (t - 1)") if include_same_document else F.expr("t * t - s")) / 2, F.lit(0)).cast("long").alias("pairs"))


def blocking_keys() -> Column:
    """A pair with any verdict but 'unrelated' shares one of these: a content word of either form, or the entity."""
    return F.array_distinct(F.concat(F.transform(F.array_union("raw_content", "claim_content"), lambda t: F.concat(F.lit("t:"), t)), F.array(F.concat(F.lit("e:"), folded(F.coalesce("entity", F.lit("")))))))


def blocked(facts: DataFrame, include_same_document: bool = False, only: Column | None = None, document_id: str | None = None, touched: DataFrame | None = None) -> DataFrame:
    """Pairs (a_*, b_*) of prepared facts that share a blocking key, each under its smallest shared key only: no distinct.

    document_id: only pairs with a fact of this document; its facts alone meet all others. touched (fact_id): the same for these facts."""
    keyed = prepared(facts).withColumn("keys", blocking_keys())
    each = keyed.withColumn("key", F.explode("keys"))

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        a, b = side(left, "a"), side(right, "b")
        pairs = a.join(b, (F.col("a_key") == F.col("b_key")) & eligible(include_same_document)).where(F.array_min(F.array_intersect("a_keys", "b_keys")) == F.col("a_key"))
        return (pairs if only is None else pairs.where(only)).drop("a_key", "b_key", "a_keys", "b_keys")

    if touched is not None:
        own, others = (each.join(touched.select("fact_id"), "fact_id", how) for how in ("left_semi", "left_anti"))
        return met(own, each).unionByName(met(others, own))
    if document_id is None:
        return met(each, each)
    own, others = each.where(F.col("document_id") == document_id), each.where(F.col("document_id") != document_id)
    return met(own, each).unionByName(met(others, own))


def related(facts: DataFrame, include_same_document: bool = False, document_id: str | None = None, touched: DataFrame | None = None, store: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Pairs (a_*, b_*) of prepared facts: all that can have another verdict than 'unrelated', and few others.

    What a verdict needs, rule by rule: content words of the raw forms that are similar enough; or the same canonical claim; or the same
    entity and claim; or similar subjects and claims. Sets of words that are similar enough share one of their rarest, so a
    word that all facts hold brings no pairs together, unlike in blocked(). Facts that lack an entity or a claim, which then say nothing
    against a pair, meet by any word or name that they share. document_id, touched: as in blocked(). store: writes a table and reads it
    again; with it each step is a small plan of its own, where one plan of all of them fills a small driver."""
    whole = store(prepared(facts))
    p = whole.select("fact_id", "document_id", "entity", "claim", "canonical_subject", "canonical_predicate", "value_kind", "raw_tokens", "raw_content", "claim_content", "subject_content")
    bare = ~present(F.col("entity")) | ~present(F.col("claim"))
    if touched is not None:
        own = p.join(touched.select("fact_id"), "fact_id", "left_semi")
    else:
        own = p if document_id is None else p.where(F.col("document_id") == document_id)

    def pairs(found: DataFrame) -> DataFrame:
        """Once, whichever side asked."""
        ids = found.where(F.col("query_id") != F.col("candidate_id")) if include_same_document else found.where("qd <> cd")
        return ids.select(F.least("query_id", "candidate_id").alias("a"), F.greatest("query_id", "candidate_id").alias("b"))

    def named(df: DataFrame, q: bool, **columns: str) -> DataFrame:
        return df.select(F.col("fact_id").alias("query_id" if q else "candidate_id"), F.col("document_id").alias("qd" if q else "cd"), *(F.col(c).alias(n) for n, c in columns.items()))

    def similar(words: str, floor: float, also: str | None = None, least: float = 0.0) -> DataFrame:
        sets, asking = (df.select("fact_id", "document_id", F.col(words).alias("words")) for df in (p, own))
        every = store(rarest_first(sets, sets))
        met = meeting(every if own is p else store(rarest_first(asking, sets)), every, floor, not include_same_document)
        met = met.where(jaccard(F.col("qw"), F.col("cw")) >= floor)
        if also is not None:
            met = met.join(named(p, True, qs=also).drop("qd"), "query_id").join(named(p, False, cs=also).drop("cd"), "candidate_id").where(jaccard(F.col("qs"), F.col("cs")) >= least)
        return store(pairs(met))

    def equal(*columns: str) -> DataFrame:
        keys = {f"k{i}": folded(F.col(c)) for i, c in enumerate(columns)}
        left, right = (df.withColumns(keys).where(F.concat(*keys).isNotNull()) for df in (own, p))
        return store(pairs(named(left, True, **{k: k for k in keys}).join(named(right, False, **{k: k for k in keys}), list(keys))))

    ids = similar("raw_content", OVERLAP_FROM).union(similar("claim_content", CLAIM_FROM, "subject_content", SUBJECT_FROM)).union(equal("canonical_subject", "canonical_predicate", "value_kind")).union(equal("entity", "claim"))
    tagged = lambda tag, c: F.when(present(F.col(c)), F.concat(F.lit(tag), folded(F.col(c))))
    any_word = F.transform(F.array_union("raw_tokens", "claim_content"), lambda w: F.concat(F.lit("w:"), w))
    keys = F.explode(F.array_compact(F.concat(any_word, F.array(tagged("e:", "entity"), tagged("s:", "canonical_subject"), tagged("p:", "canonical_predicate"))))).alias("key")
    asking, every = (df.select("fact_id", "document_id", keys, bare.alias("bare")) for df in (own, p))
    lacking = [store(pairs(named(left, True, key="key").join(named(right, False, key="key"), "key"))) for left, right in ((asking.where("bare"), every), (asking, every.where("bare")))]
    ids = ids.union(lacking[0]).union(lacking[1])
    return beside(whole, store(ids.distinct()))


def paired(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """Pairs (a_*, b_*) of prepared facts for given ids (a, b)."""
    return beside(prepared(facts), ids)


def beside(p: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select("a", "b").join(side(p, "a"), F.col("a") == F.col("a_fact_id")).join(side(p, "b"), F.col("b") == F.col("b_fact_id")).drop("a", "b")


def ranked(facts: DataFrame, queries: DataFrame, vectors: DataFrame | None = None, include_same_document: bool = False, k: int = TOP_K, floor: float = FLOOR) -> DataFrame:
    """(a, b, score): the k best candidates of each query, by vector where both sides have one, else by words. vectors: fact_id, v."""
    if vectors is None:
        return unordered(by_words(facts, queries, k, floor, include_same_document))
    own = facts.select("fact_id", "document_id").join(vectors.select("fact_id", "v"), "fact_id").select(F.col("fact_id").alias("id"), "document_id", "v")
    have = vectors.select("fact_id")
    asking, wordy = queries.join(have, "fact_id", "left_semi"), queries.join(have, "fact_id", "left_anti")
    near = by_vector(own, own.join(asking.select(F.col("fact_id").alias("id")), "id", "left_semi"), k, floor, include_same_document=include_same_document)
    worded = by_words(facts.join(have, "fact_id", "left_anti"), asking, k, floor, include_same_document).unionByName(by_words(facts, wordy, k, floor, include_same_document))
    return unordered(mixed(near, worded, k))


def every_pair(up_to: int):
    """How all pairs are found, with the same verdicts either way: a few at most by any shared word, at one join; where more are allowed for, by what a verdict needs."""
    return related if up_to > EXHAUSTIVE_UP_TO else blocked


def chosen(facts: DataFrame, document_id: str | None = None, vectors: DataFrame | None = None, include_same_document: bool = False, up_to: int = EXHAUSTIVE_UP_TO, k: int = TOP_K, floor: float = FLOOR) -> tuple[DataFrame, str]:
    """(pairs, mode): all pairs that can have a verdict while there are `up_to` pairs at most ("exhaustive"), else the best of each fact ("ranked").

    document_id: pairs with a fact of this document."""
    if document_id is None:
        pairs, queries = space(facts, include_same_document).first().pairs, facts
    else:
        own, every = facts.agg(F.count_if(F.col("document_id") == document_id), F.count("*")).first()
        pairs = own * (every - own) + (own * (own - 1) // 2 if include_same_document else 0)
        queries = facts.where(F.col("document_id") == document_id)
    if pairs <= up_to:
        return every_pair(up_to)(facts, include_same_document, document_id=document_id), "exhaustive"
    return paired(facts, ranked(facts, queries, vectors, include_same_document, k, floor)), "ranked"


def top(scored: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k best (score, then id) of each query."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "candidate_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def by_vector(vectors: DataFrame, queries: DataFrame, k: int = TOP_K, floor: float = FLOOR, include_same_document: bool = False) -> DataFrame:
    """vectors and queries: id, document_id, v (double). The k nearest of other documents for each query, by cosine in double precision;
    include_same_document: and of later facts of the same one."""
    return neighbours(vectors, queries, k, floor, include_same_document)


def word_sets(facts: DataFrame) -> DataFrame:
    return facts.select("fact_id", "document_id", tokens(F.concat_ws(" ", effective("canonical_subject", "subject"), effective("canonical_predicate", "predicate"))).alias("words"))


def rarest_first(sets: DataFrame, among: DataFrame) -> DataFrame:
    """sets (fact_id, document_id, words) with the words by how many of `among` hold them, the rarest first."""
    often = among.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    each = sets.select("fact_id", "document_id", F.explode("words").alias("w")).join(often, "w", "left")
    return each.groupBy("fact_id", "document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w"))), lambda x: x["w"]).alias("words"))


def needed(n: Column, m: Column, floor: float) -> Column:
    """How many words sets of n and m words share at least if they are similar enough."""
    return F.greatest(F.lit(1), F.ceil((n + m) * (floor / (1 + floor)) - 1e-9)).cast("int")


def meeting(q: DataFrame, sets: DataFrame, floor: float, apart: bool = False) -> DataFrame:
    """q and sets: fact_id, document_id, words, the rarest first. query_id, candidate_id, qd, cd, qw, cw, n, m of pairs that may be similar enough.

    Sets of n and m words that share `needed` words share one of their rarest, all but needed - 1 of each: only these meet, size by
    size, so that the words which most facts have bring few together. A pair is made for the first rare word that it shares.
    apart: only pairs of different documents; those of one document, however many share a word, are then never put together."""
    sizes = [F.lit(r[0]) for r in sets.select(F.size("words")).union(q.select(F.size("words"))).distinct().collect()]  # as many as the longest name has words, at most

    def rare(df: DataFrame) -> DataFrame:
        n, m = F.size("words"), F.col("m")
        fits = F.filter(F.array(*sizes) if sizes else F.array().cast("array<int>"), lambda x: (x >= floor * n - 1e-9) & (n >= floor * x - 1e-9))
        return df.withColumn("n", n).withColumn("m", F.explode(fits)).withColumn("w", F.explode(F.slice("words", F.lit(1), n - needed(n, m, floor) + 1)))

    left = rare(q).select(F.col("fact_id").alias("query_id"), F.col("document_id").alias("qd"), F.col("words").alias("qw"), "n", "m", "w")
    right = rare(sets).select(F.col("fact_id").alias("candidate_id"), F.col("document_id").alias("cd"), F.col("words").alias("cw"), F.col("m").alias("n"), F.col("n").alias("m"), "w")
    first = F.get(F.array_intersect(*(F.slice(c, F.lit(1), F.size(c) - needed(F.col("n"), F.col("m"), floor) + 1) for c in ("qw", "cw"))), F.lit(0))
    key = ["w", "n", "m"]
    if apart:
        documents = right.select(*key, "cd").distinct()
        left, key = left.join(documents, key).where("qd <> cd"), [*key, "cd"]
    return left.join(right, key).where(first == F.col("w"))


def by_words(facts: DataFrame, queries: DataFrame | None = None, k: int = TOP_K, floor: float = FLOOR, include_same_document: bool = False) -> DataFrame:
    """Jaccard of words of subject and predicate, scored on the whole sets."""
    other = "qd <> cd or candidate_id > query_id" if include_same_document else "qd <> cd"
    plain = word_sets(facts)
    sets = rarest_first(plain, plain)
    met = meeting(sets if queries is None else rarest_first(word_sets(queries), plain), sets, floor, not include_same_document).where(other)
    scored = met.select("query_id", "candidate_id", F.size(F.array_intersect("qw", "cw")).alias("both"), (F.col("n") + F.col("m")).alias("all"))
    return top(scored.select("query_id", "candidate_id", (F.col("both") / (F.col("all") - F.col("both"))).alias("score")).where(F.col("score") >= floor), k)


def mixed(ranked: DataFrame, worded: DataFrame, k: int = TOP_K) -> DataFrame:
    """Vector ranks first; candidates without a vector fill, by words, what is left of k. worded: only such candidates for queries that have ranks."""
    have = ranked.groupBy("query_id").agg(F.count("*").alias("n"))
    rest = worded.join(have, "query_id", "left").where(F.col("rank") <= k - F.coalesce("n", F.lit(0))).drop("n")
    return ranked.select("query_id", "candidate_id", "score").union(rest.select("query_id", "candidate_id", "score"))


def unordered(scored: DataFrame) -> DataFrame:
    """The best score of each unordered pair."""
    return scored.groupBy(F.least("query_id", "candidate_id").alias("a"), F.greatest("query_id", "candidate_id").alias("b")).agg(F.max("score").alias("score"))
