"""Names that the corpus itself defines: abbreviations, and what a document calls itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.text import canonical_name

# Nouns and pronouns by which an organisation means itself.
SELF_NOUNS = "authority bank company corporation firm fund group issuer parent partnership society trust".split()
SELF_PRONOUNS = ("we", "us", "our", "ours")
# Fixed values: 'Long Form (ABBR)' with up to nine words, and 'Name (the "Company")'.
DEFINITION = r"([A-Za-z][A-Za-z&.\-]*(?:\s+[A-Za-z&.\-]+){0,8})\s*\(\s*[“‘\"']?([A-Z][A-Za-z&.\-]{1,9})[”’\"']?\s*\)"
SELF_DEFINITION = r"(?i)([A-Z][A-Za-z&.,\-]*(?:\s+[A-Za-z&.,\-]+){0,6})\s*\(\s*(?:the\s+)?[“‘\"']?(" + "|".join(SELF_NOUNS) + r")[”’\"']?\s*(?:/|\))"


def clean(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def mined(texts: DataFrame, pattern: str) -> DataFrame:
    """One row for each match: the text's columns, left and right."""
    flat = F.regexp_replace("text", "\n", " ")
    hits = texts.where(F.contains("text", F.lit("("))).withColumn("hit", F.explode(F.regexp_extract_all(flat, F.lit(pattern), F.lit(0))))
    return hits.select("*", F.regexp_extract("hit", pattern, 1).alias("left"), F.regexp_extract("hit", pattern, 2).alias("right"))


def alias_mentions(texts: DataFrame) -> DataFrame:
    """The texts' columns with abbreviation and long_form, once for each definition: the last words whose initials spell the abbreviation, two at least."""
    letters = F.upper(F.regexp_replace("right", "[^A-Za-z]", ""))
    n = F.length(letters)
    words = F.split(F.trim(F.regexp_replace("left", r"\s+", " ")), " ")
    last = F.when((n >= 2) & (F.size(words) >= n), F.slice(words, F.greatest(F.lit(1), F.size(words) - n + 1), F.greatest(F.lit(1), n)))
    initials = F.upper(F.array_join(F.transform(F.filter(last, lambda w: w.rlike("^[A-Za-z]")), lambda w: F.substring(w, 1, 1)), ""))
    found = mined(texts, DEFINITION).where(last.isNotNull() & (initials == letters))
    return found.select(*texts.columns, clean(F.col("right")).alias("abbreviation"), clean(F.array_join(last, " ")).alias("long_form"))


def alias_pairs(texts: DataFrame) -> DataFrame:
    """(abbreviation, long_form, n): how often the texts define an abbreviation so."""
    return alias_mentions(texts).groupBy("abbreviation", "long_form").agg(F.count("*").alias("n"))


def alias_map(pairs: DataFrame) -> DataFrame:
    """(abbreviation, long_form): the most frequent, ties by name; abbreviations that are a chosen long form are left out."""
    w = Window.partitionBy("abbreviation").orderBy(F.desc("n"), "long_form")
    chosen = pairs.withColumn("r", F.row_number().over(w)).where("r = 1").select("abbreviation", "long_form")
    return chosen.join(chosen.select(F.col("long_form").alias("abbreviation")).distinct(), "abbreviation", "left_anti")


def self_mentions(texts: DataFrame) -> DataFrame:
    """The texts' columns with name, once for each place where a text says what it calls itself."""
    words = F.split(F.trim(F.regexp_replace("left", r"\s+", " ")), " ")
    # the run of capitalised words at the end: what follows the last word that isn't
    name = F.array_join(F.aggregate(words, F.array().cast("array<string>"), lambda acc, w: F.when(w.rlike(r"^\p{Lu}"), F.concat(acc, F.array(w))).otherwise(F.array().cast("array<string>"))), " ")
    return mined(texts, SELF_DEFINITION).where(name != "").select(*texts.columns, clean(name).alias("name"))


def issuers(counts: DataFrame) -> DataFrame:
    """counts: document_id, name, n. (document_id, issuer): the name that a document most often defines for itself, in canonical form; ties by name."""
    w = Window.partitionBy("document_id").orderBy(F.desc("n"), "name")
    return counts.withColumn("r", F.row_number().over(w)).where("r = 1").select("document_id", canonical_name(F.col("name")).alias("issuer"))


def self_references(texts: DataFrame) -> DataFrame:
    """(document_id, issuer) by what the texts say."""
    return issuers(self_mentions(texts).groupBy("document_id", "name").agg(F.count("*").alias("n")))


def self_reference_map(issuers: DataFrame) -> DataFrame:
    """(document_id, abbreviation, long_form): self-referring words of each document."""
    words = F.array(*map(F.lit, sorted([*SELF_NOUNS, *SELF_PRONOUNS])))
    return issuers.where(F.col("issuer").isNotNull()).select("document_id", F.explode(words).alias("abbreviation"), F.col("issuer").alias("long_form")).where("abbreviation <> long_form")


def collapse(tokens: list[str]) -> list[str]:
    """Without runs that repeat the run right before them; the longest runs go first, from the left, until none is left."""
    tokens = list(tokens)
    size = len(tokens) // 2
    while size:
        at = next((i for i in range(len(tokens) - 2 * size + 1) if tokens[i : i + size] == tokens[i + size : i + 2 * size]), None)
        if at is None:
            size -= 1
        else:
            del tokens[at + size : at + 2 * size]
            size = len(tokens) // 2
    return tokens


@F.udf(T.StringType(), useArrow=True)
def collapsed(words: list[str]) -> str:
    return " ".join(collapse(words or []))


def apply_aliases(names: DataFrame, aliases: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """names: id, name (canonical) and, with own, document_id. Gives id, name, resolved.

    Words are replaced one by one by their long form, what a document calls itself (own: document_id, abbreviation,
    long_form) before what the corpus defines, and repeats are collapsed. Names without any alias in reach stay."""
    of = ["id", "name", "document_id"] if own is not None else ["id", "name"]
    words = names.select(*of, F.posexplode_outer(F.regexp_extract_all(F.lower("name"), F.lit("[a-z0-9]+"), F.lit(0))).alias("p", "w"))
    swapped = words.join(aliases.select(F.col("abbreviation").alias("w"), F.col("long_form").alias("general")), "w", "left")
    long = F.coalesce("general", "w")
    if own is not None:
        swapped = swapped.join(own.select("document_id", F.col("abbreviation").alias("w"), F.col("long_form").alias("self")), ["document_id", "w"], "left")
        long = F.coalesce("self", "general", "w")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("p", long.alias("x")))), lambda s: s["x"])
    back = swapped.groupBy(*of).agg(F.split(F.trim(F.array_join(listed, " ")), " +").alias("words"), F.count("w").alias("n"))
    # Only what repeats a word can repeat a run of words: few names, each looked at once.
    again = back.where(F.size(F.array_distinct("words")) < F.size("words")).select("words").distinct().select("words", collapsed("words").alias("short"))
    back = back.join(again, "words", "left").join(F.broadcast(aliases.limit(1).agg((F.count("*") > 0).alias("any"))), F.lit(True))
    if own is not None:
        back = back.join(own.select("document_id").distinct().withColumn("own", F.lit(True)), "document_id", "left").withColumn("any", F.col("any") | F.col("own").isNotNull())
    out = F.when(F.trim(F.coalesce("name", F.lit(""))) == "", None).when((F.col("n") == 0) | ~F.col("any"), F.col("name")).otherwise(F.coalesce(F.nullif(F.coalesce("short", F.array_join("words", " ")), F.lit("")), "name"))
    return back.select("id", "name", out.alias("resolved"))


NAMES = ("canonical_subject", "canonical_predicate")


def resolved_names(facts: DataFrame, texts: DataFrame, columns: tuple[str, ...] = NAMES) -> DataFrame:
    """facts (fact_id, document_id, columns) with these names rewritten by what the texts (document_id, text) define."""
    return renamed(facts, alias_map(alias_pairs(texts)), self_references(texts), columns)


def renamed(facts: DataFrame, general: DataFrame, issuers_of: DataFrame, columns: tuple[str, ...] = NAMES) -> DataFrame:
    """The same with what the texts define given: an alias map, and the issuers of documents."""
    own = self_reference_map(issuers_of)
    names = facts.select("document_id", F.explode(F.array(*(F.struct(F.struct("fact_id", F.lit(c).alias("c")).alias("id"), F.col(c).alias("name")) for c in columns))).alias("x")).select("document_id", "x.*")
    found = apply_aliases(names, general, own).groupBy(F.col("id.fact_id").alias("fact_id")).agg(*(F.max(F.when(F.col("id.c") == c, F.col("resolved"))).alias(c) for c in columns))
    return facts.drop(*columns).join(found, "fact_id", "left").select(facts.columns)
