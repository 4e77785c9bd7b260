"""Text functions: tokens, overlap, names, estimates. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Filler words that never make two claims alike.
STOPWORDS = (
    "a an the is are was were be been being has have had do does did of from in on at to for with by as and or it its "
    "this that these those value values amount amounts number numbers total totals status reported report stated"
).split()
# Endings of company names.
CORPORATE_SUFFIXES = "ltd limited inc corp corporation llc plc pvt private".split()
#: Page quality: characters and words of a full page, weights, the penalty for pictures, and the least good score.
FULL_CHARS, FULL_WORDS, CHAR_WEIGHT, WORD_WEIGHT, FEW_CHARS, PICTURE_FACTOR, GOOD_FROM = 500, 100, 0.6, 0.4, 50, 0.5, 0.35


def let(value: Column, body) -> Column:
    """body(value), where value is computed once however often body uses it, and cases of body that aren't taken cost nothing."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def present(c: Column) -> Column:
    """Not null and not blank; never null itself."""
    return F.coalesce(F.length(strip(c)) > 0, F.lit(False))


def folded(c: Column) -> Column:
    return F.lower(strip(c))


def squash(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def tokens(c: Column) -> Column:
    """Distinct lower-case alphanumeric tokens in order of first occurrence."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def content_tokens(c: Column) -> Column:
    return F.array_except(tokens(c), F.array(*map(F.lit, STOPWORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all tokens; 0 when there are none."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0))


def canonical_name(c: Column) -> Column:
    """Lower case, ASCII letters and digits, no leading 'the', no trailing company suffix; null when nothing is left."""
    plain = squash(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "))
    end = "|".join(CORPORATE_SUFFIXES)
    # Endings and articles may alternate until neither is left; both run to the end of their chain at once.
    short = F.regexp_replace(plain, rf"(?:(?:^| )(?:{end}))+$", "")
    return F.nullif(F.trim(F.regexp_replace(short, r"^(?:the(?: |$))+", "")), F.lit(""))


def estimate_tokens(c: Column) -> Column:
    """Half the UTF-8 bytes, rounded up, and 1 at least."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(F.coalesce(c, F.lit(""))) / 2)).cast("long")


def digits(c: Column, most: int = 50) -> Column:
    return F.least(F.lit(most), F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"\p{Nd}")))


def suspicious(c: Column) -> Column:
    """Count of control and replacement characters."""
    return F.regexp_count(c, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F�]"))


def words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda x: x != ""))


def quality(chars: Column, words: Column, suspect: Column, images: Column) -> Column:
    """Score of a page from its counts, its share of suspicious characters and whether it has pictures."""
    base = CHAR_WEIGHT * F.least(chars / FULL_CHARS, F.lit(1.0)) + WORD_WEIGHT * F.least(words / FULL_WORDS, F.lit(1.0))
    score = base * (1 - suspect) * (1 - suspect) * F.when(images & (chars < FEW_CHARS), PICTURE_FACTOR).otherwise(1.0)
    return F.when(chars == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID: a SHA-1 digest with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def unfenced(c: Column) -> Column:
    """A model's answer without code fences and without prose around the outermost object or array."""
    bare = strip(F.regexp_replace(strip(c), r"(?s)^```[A-Za-z]*\s*|\s*```$", ""))
    inner = F.regexp_extract(bare, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.when(bare.rlike(r"^[\[{]"), bare).when(inner != "", inner).otherwise(bare)
