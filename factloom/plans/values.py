"""Queries over texts of values, periods and names, with SQL that computes the same by other means."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import numbers as num
from factloom.functions.numbers import normalized, parse_number, resolved_kind
from factloom.functions.periods import parse_time
from factloom.functions.text import canonical_name, estimate_tokens
from factloom.operators import canonical, extract
from factloom.plans import reports
from factloom.plans.pairs import _FACTS, facts
from factloom.sources.views import DEFINITIONS, NAMES, PERIOD_TEXTS, VALUE_TEXTS, duck, view

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


WS = r"\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def lookup(x: str, pairs: dict) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {v!r}" + ("e0" if isinstance(v, float) and "e" not in repr(v) else "") if not isinstance(v, str) else f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


def listed(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_PREFIX = r"₹|rs\.|rs|\$|€|£|inr|usd"
_NUMBER = rf"""
v AS ({duck(VALUE_TEXTS)}),
n1 AS (SELECT *, regexp_replace(lower({strip("value_text")}), '[, ]', '', 'g') AS s FROM v),
n2 AS (SELECT *, starts_with(s, '(') AND ends_with(s, ')') AND length(s) > 1 AS wrapped FROM n1),
n3 AS (SELECT *, CASE WHEN wrapped THEN s[2:-2] ELSE s END AS inside FROM n2),
n4 AS (SELECT *, regexp_extract(inside, '(?s)^([+-]*)(?:{_PREFIX})?([+-]*)(.*)$', 1) || regexp_extract(inside, '(?s)^([+-]*)(?:{_PREFIX})?([+-]*)(.*)$', 2) AS signs,
  regexp_replace(regexp_extract(inside, '(?s)^([+-]*)(?:{_PREFIX})?([+-]*)(.*)$', 3), '(?:%|percent(?:age)?s?)$', '') AS rest FROM n3),
n5 AS (SELECT *, regexp_extract(rest, '(?s)[0-9].*?({num.SUFFIX_PATTERN})$', 1) AS suffix FROM n4),
n6 AS (SELECT *, CASE WHEN suffix = '' THEN rest ELSE rest[1:length(rest) - length(suffix)] END AS core FROM n5),
num AS (SELECT id, value_text, unit, drafted, CASE WHEN regexp_matches(core, '{num.NUMBER_PATTERN}') THEN TRY_CAST(replace(core, '_', '') AS DOUBLE) END * CASE WHEN wrapped <> (length(replace(signs, '+', '')) % 2 = 1) THEN -1e0 ELSE 1e0 END * coalesce({lookup("suffix", num.SUFFIXES)}, 1e0) AS x FROM n6)"""


@query(f"WITH {_NUMBER} SELECT id, value_text, CASE WHEN x = 0 THEN 0e0 ELSE x END AS number FROM num")
def parse_number_values(spark, sf_dir):
    x = parse_number(F.col("value_text"))
    return view(spark, sf_dir, VALUE_TEXTS).select("id", "value_text", F.when(x == 0, 0.0).otherwise(x).alias("number"))


_KIND = rf"""{_NUMBER}, k0 AS (SELECT *, coalesce(regexp_matches({strip("value_text")}, '(?i)(?:%|per\s?cent(?:age)?s?)\s*$'), false) AS pct FROM num),
kind AS (SELECT *, CASE WHEN pct THEN 'PERCENTAGE' WHEN x IS NOT NULL THEN 'NUMERIC' WHEN drafted IN ('NUMERIC', 'PERCENTAGE') THEN drafted ELSE 'TEXT' END AS kind,
  concat_ws(',', CASE WHEN pct AND drafted <> 'PERCENTAGE' THEN 'kind_corrected:' || drafted || '->PERCENTAGE' WHEN NOT pct AND x IS NOT NULL AND drafted = 'TEXT' THEN 'kind_corrected:TEXT->NUMERIC' END,
  CASE WHEN NOT pct AND x IS NULL AND drafted IN ('NUMERIC', 'PERCENTAGE') THEN 'value_unparseable' END) AS flags FROM k0)"""


@query(f"WITH {_KIND} SELECT id, kind, flags FROM kind")
def resolve_kind(spark, sf_dir):
    k = resolved_kind(F.col("value_text"), F.col("drafted"))
    return view(spark, sf_dir, VALUE_TEXTS).select("id", k["kind"].alias("kind"), F.array_join(k["flags"], ",").alias("flags"))


def _tokens(x: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({x}, '')), '[₹$€£¥₩₽¢₺]|[\p{{L}}\p{{M}}\p{{N}}_]+')"


def _first(tokens: str, words) -> str:
    return f"list_filter({tokens}, lambda t: list_contains({listed(words)}, t))[1]"


_MAG = "|".join(sorted(num.SUFFIXES, key=lambda s: (-len(s), s)))
# RE2 has no lookaround: a word is bounded by what it takes in, and stripping is repeated for words that share a bound.
_STRIPPED = rf"nullif(regexp_replace(regexp_replace(' ' || list_aggregate(list_filter(string_split(regexp_replace(unit, '([^A-Za-z0-9]+)', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda w: NOT regexp_full_match(w, '(?i)({_MAG})s?')), 'string_agg', '') || ' ', '\s+', ' ', 'g'), '^[ \t,;:.]+|[ \t,;:.]+$', '', 'g'), '')"
_UNITS = rf"""{_KIND},
u1 AS (SELECT *, CASE WHEN kind = 'TEXT' THEN NULL ELSE x END AS n, {_tokens("unit")} AS ut, {_tokens("value_text")} AS vt, lower(coalesce(unit, '')) AS low, lower(coalesce(unit, '') || ' ' || coalesce(value_text, '')) AS pair FROM kind),
u2 AS (SELECT *, n * CASE WHEN regexp_matches(coalesce(value_text, ''), '(?i)(^|[^A-Za-z])({_MAG})s?($|[^A-Za-z0-9])') THEN 1e0 ELSE coalesce({lookup(_first("ut", num.SUFFIXES), num.SUFFIXES)}, 1e0) END AS value,
  {lookup(f"coalesce({_first('ut', num.CURRENCIES)}, {_first('vt', num.CURRENCIES)})", num.CURRENCIES)} AS cur, {lookup(_first("ut", num.MASSES), num.MASSES)} AS mass,
  coalesce({_first("ut", num.UNKNOWN_CURRENCIES)}, {_first("vt", num.UNKNOWN_CURRENCIES)}) AS odd, {_first("ut", num.UNKNOWN_UNITS)} AS measure, {_STRIPPED} AS bare FROM u1),
u AS (SELECT *, CASE WHEN n IS NULL THEN 0 WHEN kind = 'PERCENTAGE' THEN CASE WHEN regexp_matches(pair, '(^|[^a-z0-9])(percentage points?|pp)($|[^a-z0-9])') THEN 1 WHEN regexp_matches(pair, '(^|[^a-z0-9])(basis points?|bps?)($|[^a-z0-9])') THEN 2 ELSE 3 END
  WHEN regexp_matches(low, '(^|[^a-z0-9])(percentage points?|pp)($|[^a-z0-9])') THEN 4 WHEN regexp_matches(low, '(^|[^a-z0-9])(basis points?|bps?)($|[^a-z0-9])') THEN 5 WHEN regexp_full_match(trim(low), '%|per ?cent(?:age)?|percent(?:age)?') THEN 6
  WHEN cur IS NOT NULL THEN 7 WHEN mass IS NOT NULL THEN 8 WHEN odd IS NOT NULL THEN 9 WHEN list_has_any(ut, ['t', 'ton', 'tons']) THEN 10 WHEN measure IS NOT NULL THEN 11
  WHEN (list_has_any(ut, {listed(num.INDIAN_SCALES)}) OR list_has_any(vt, {listed(num.INDIAN_SCALES)})) AND bare IS NULL THEN 12 ELSE 13 END AS c FROM u2),
norm AS (SELECT *, CASE c WHEN 1 THEN n WHEN 2 THEN n * 0.0001e0 WHEN 3 THEN n / 100 WHEN 4 THEN value WHEN 5 THEN value * 0.0001e0 WHEN 6 THEN value / 100 WHEN 7 THEN value / CASE cur WHEN 'INR' THEN 1e7 ELSE 1e6 END WHEN 8 THEN value / mass WHEN 12 THEN value / 1e7 WHEN 13 THEN value END AS nn,
  CASE WHEN c IN (1, 4) THEN 'percentage_point' WHEN c IN (2, 3, 5, 6) THEN 'fraction' WHEN c = 7 THEN cur || CASE cur WHEN 'INR' THEN ' crore' ELSE ' million' END WHEN c = 8 THEN 'million tonnes' WHEN c = 12 THEN 'INR crore' WHEN c = 13 THEN bare END AS nu,
  CASE c WHEN 9 THEN 'norm:currency_unknown:' || odd WHEN 10 THEN 'norm:unit_ambiguous:t' WHEN 11 THEN 'norm:unit_unknown:' || measure END AS flag FROM u)"""


def _normal(spark, sf_dir):
    v = view(spark, sf_dir, VALUE_TEXTS).withColumn("kind", resolved_kind(F.col("value_text"), F.col("drafted"))["kind"]).withColumn("n", F.when(F.col("kind") != "TEXT", parse_number(F.col("value_text"))))
    v = v.select("id", "value_text", "unit", "drafted", F.explode(F.array(F.struct("kind", "n"))).alias("k"))
    return v.select("id", "value_text", "unit", F.col("k.kind").alias("kind"), F.explode(F.array(normalized(F.col("k.kind"), F.col("k.n"), F.col("unit"), F.col("value_text")))).alias("z"))


@query(f"WITH {_UNITS} SELECT id, kind, round(nn, 9) + 0 AS number, nu AS canonical_unit, flag FROM norm")
def normalize_units(spark, sf_dir):
    return _normal(spark, sf_dir).select("id", "kind", (F.round("z.number", 9) + 0).alias("number"), F.col("z.unit").alias("canonical_unit"), F.col("z.flag").alias("flag"))


@query(f"WITH {_UNITS} SELECT id, concat_ws(',', 'time_unparsed', 'kept', flag) AS flags FROM norm")
def flag_replace(spark, sf_dir):
    """Old normalisation flags go, others stay in place, the fresh one comes last."""
    old = F.array(F.lit("time_unparsed"), F.lit("norm:unit_unknown:old"), F.lit("kept"), F.lit("norm:stale"))
    return _normal(spark, sf_dir).select("id", F.array_join(extract.replaced_flags(old, F.array_compact(F.array("z.flag"))), ",").alias("flags"))


@query(rf"""WITH RECURSIVE v AS ({duck(NAMES)}), p AS (SELECT id, name, trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9\s\x0b]', ' ', 'g'), '[\s\x0b]+', ' ', 'g')) AS s FROM v),
r(id, name, s, i) AS (SELECT id, name, s, 0 FROM p UNION ALL SELECT id, name, CASE WHEN s = 'the' THEN '' WHEN starts_with(s, 'the ') THEN s[5:] WHEN list_contains({listed(["ltd", "limited", "inc", "corp", "corporation", "llc", "plc", "pvt", "private"])}, string_split(s, ' ')[-1]) THEN array_to_string(string_split(s, ' ')[:-2], ' ') END, i + 1
FROM r WHERE s = 'the' OR starts_with(s, 'the ') OR list_contains({listed(["ltd", "limited", "inc", "corp", "corporation", "llc", "plc", "pvt", "private"])}, string_split(s, ' ')[-1]))
SELECT id, name, nullif(arg_max(s, i), '') AS canonical FROM (SELECT id, coalesce(name, chr(1)) AS name0, name, s, i FROM r) q GROUP BY id, name""")
def canonical_names(spark, sf_dir):
    return view(spark, sf_dir, NAMES).select("id", "name", canonical_name(F.col("name")).alias("canonical"))


_MONTHS = "['january', 'february', 'march', 'april', 'may', 'june', 'july', 'august', 'september', 'october', 'november', 'december']"


@query(rf"""WITH v AS ({duck(PERIOD_TEXTS)}), s AS (SELECT id, time_text, {strip("time_text")} AS s FROM v),
c AS (SELECT id, time_text, s, CASE WHEN coalesce(s, '') = '' THEN 'U' WHEN regexp_full_match(s, '(?i)(?:h[12]\s*(?:of\s*)?)?(?:fy|fiscal)\s?(\d{{2}}|\d{{4}})(?:\s*[-–/]\s*(\d{{2}}|\d{{4}}))?') THEN 'F'
  WHEN regexp_full_match(s, '(?i)q[1-4](?:\s*[:\s]\s*(?:of\s+)?(?:fy|fiscal)?\s*\d{{2,4}}(?:\s*[-–/]\s*\d{{2,4}})?)?') THEN 'Q' WHEN regexp_full_match(s, '\d{{4}}-\d{{2}}-\d{{2}}') THEN 'I'
  WHEN regexp_full_match(s, '\d{{1,2}}\s+[A-Za-z]+\s+\d{{4}}') AND list_contains({_MONTHS}, lower(regexp_extract(s, '[A-Za-z]+'))) THEN 'D'
  WHEN regexp_full_match(s, '(?i)(?:as\s+(?:of|on|at)\s+)?[A-Za-z]+\s+\d{{1,2}},\s*\d{{4}}') AND list_contains({_MONTHS}, lower(regexp_extract(s, '([A-Za-z]+)\s+\d', 1))) THEN 'M'
  WHEN regexp_full_match(s, '[A-Za-z]+\s+\d{{4}}') AND list_contains({_MONTHS}, lower(regexp_extract(s, '[A-Za-z]+'))) THEN 'Y'
  WHEN regexp_full_match(s, '\d{{4}}(\s*[-–/]\s*(\d{{2}}|\d{{4}}))?') OR regexp_full_match(s, '(?i)(?:for\s+the\s+)?(?:[a-z]+[-\s])*(?:year|quarter|half|months?|period)(?:\s+period)?\s+end(?:ed|ing).*\d{{4}}\s*') THEN 'R' ELSE 'U' END AS c FROM s),
d AS (SELECT *, CASE c WHEN 'I' THEN s WHEN 'D' THEN regexp_extract(s, '\d{{4}}$') || '-' || lpad(list_position({_MONTHS}, lower(regexp_extract(s, '[A-Za-z]+')))::VARCHAR, 2, '0') || '-' || lpad(regexp_extract(s, '^\d+'), 2, '0')
  WHEN 'M' THEN regexp_extract(s, '\d{{4}}$') || '-' || lpad(list_position({_MONTHS}, lower(regexp_extract(s, '([A-Za-z]+)\s+\d', 1)))::VARCHAR, 2, '0') || '-' || lpad(regexp_extract(s, '(\d{{1,2}}),', 1), 2, '0')
  WHEN 'Y' THEN regexp_extract(s, '\d{{4}}$') || '-' || lpad(list_position({_MONTHS}, lower(regexp_extract(s, '[A-Za-z]+')))::VARCHAR, 2, '0') || '-01' END AS iso FROM c),
e AS (SELECT *, CASE WHEN iso NOT LIKE '0000%' THEN TRY_CAST(iso AS DATE) END AS day FROM d)
SELECT id, time_text, CASE WHEN c = 'F' THEN 'FISCAL_YEAR' WHEN c = 'Q' THEN 'QUARTER' WHEN c = 'R' THEN 'RANGE' WHEN c IN ('I', 'D', 'M', 'Y') AND day IS NOT NULL THEN 'DATE' ELSE 'UNKNOWN' END AS kind,
  CAST(day AS VARCHAR) AS time_start, CAST(CASE WHEN c = 'Y' THEN last_day(day) ELSE day END AS VARCHAR) AS time_end FROM e""")
def parse_time_values(spark, sf_dir):
    t = parse_time(F.col("time_text"))
    p = view(spark, sf_dir, PERIOD_TEXTS).select("id", "time_text", F.explode(F.array(t)).alias("t"))
    return p.select("id", "time_text", "t.kind", F.col("t.start").cast("string").alias("time_start"), F.col("t.end").cast("string").alias("time_end"))


@query(f"WITH {_FACTS} SELECT comp AS comparability, count(*) AS n FROM f GROUP BY comp")
def comparability_classes(spark, sf_dir):
    return reports.comparability_histogram(facts(spark, sf_dir))


@query(f"""WITH {_FACTS} SELECT document_id, count(*) AS facts_processed, count(*) FILTER (normalized_number IS NOT NULL OR canonical_subject IS NOT NULL OR canonical_predicate IS NOT NULL) AS facts_normalized, 0::BIGINT AS facts_flagged,
count(*) FILTER (comp = 'COMPARABLE') AS comparable, count(*) FILTER (comp = 'PARTIAL') AS partially_comparable, count(*) FILTER (comp = 'NOT_COMPARABLE') AS not_comparable,
count(*) FILTER (miss LIKE '%number%') AS missing_number, count(*) FILTER (miss LIKE '%unit%') AS missing_unit, count(*) FILTER (miss LIKE '%period%') AS missing_period FROM f GROUP BY document_id""")
def missing_counts(spark, sf_dir):
    return extract.normalization_report(facts(spark, sf_dir).withColumn("ambiguity_flags", F.array().cast("array<string>"))).drop("missing_counts")


_DEFS = f"d AS ({duck(DEFINITIONS)}), m AS (SELECT document_id, unnest(regexp_extract_all(text, '{canonical.DEFINITION.replace(chr(39), chr(39) * 2)}')) AS hit FROM d WHERE contains(text, '('))"
_ALIAS = rf"""{_DEFS}, w AS (SELECT string_split(trim(regexp_replace(regexp_extract(hit, '^(.*?)\s*\(', 1), '\s+', ' ', 'g')), ' ') AS words, regexp_extract(hit, '\(\s*[“‘"'']?([A-Z][A-Za-z&.\-]{{1,9}})', 1) AS abbr FROM m),
x AS (SELECT abbr, words, upper(regexp_replace(abbr, '[^A-Za-z]', '', 'g')) AS l FROM w), y AS (SELECT abbr, l, words[len(words) - length(l) + 1:] AS tail FROM x WHERE length(l) >= 2 AND len(words) >= length(l)),
pairs AS (SELECT lower(abbr) AS abbreviation, lower(array_to_string(tail, ' ')) AS long_form, count(*) AS n FROM y WHERE upper(array_to_string(list_transform(list_filter(tail, lambda t: regexp_matches(t, '^[A-Za-z]')), lambda t: t[1]), '')) = l GROUP BY 1, 2),
best AS (SELECT abbreviation, long_form FROM (SELECT *, row_number() OVER (PARTITION BY abbreviation ORDER BY n DESC, long_form) AS r FROM pairs) q WHERE r = 1), map AS (SELECT * FROM best WHERE abbreviation NOT IN (SELECT long_form FROM best))"""


@query(f"WITH {_ALIAS} SELECT * FROM pairs")
def alias_pairs(spark, sf_dir):
    return canonical.alias_pairs(view(spark, sf_dir, DEFINITIONS))


@query(f"WITH {_ALIAS} SELECT * FROM map")
def alias_map(spark, sf_dir):
    return canonical.alias_map(canonical.alias_pairs(view(spark, sf_dir, DEFINITIONS)))


@query(rf"""WITH d AS ({duck(DEFINITIONS)}), m AS (SELECT document_id, unnest(regexp_extract_all(text, '{canonical.SELF_DEFINITION.replace(chr(39), chr(39) * 2)}')) AS hit FROM d WHERE contains(text, '(')),
n AS (SELECT document_id, lower(regexp_extract(trim(regexp_extract(hit, '^(.*?)\s*\(', 1)), '((?:^|\s)(?:[A-Z]\S*\s?)+)$')) AS name FROM m),
c AS (SELECT document_id, trim(name) AS name, count(*) AS n FROM n WHERE trim(name) <> '' GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY n DESC, name) AS r FROM c)
SELECT document_id, regexp_replace(name, '( (ltd|limited|inc|corp|corporation|llc|plc|pvt|private))+$', '') AS issuer FROM b WHERE r = 1""")
def self_reference(spark, sf_dir):
    return canonical.self_references(view(spark, sf_dir, DEFINITIONS))


#: Runs that repeat the run before them go, the longest first and from the left, until there is none. From table words (k, words).
_HIT = "(SELECT x FROM (SELECT unnest(list_filter(flatten(list_transform(range(len({0}) // 2, 0, -1), lambda n: list_transform(range(0, len({0}) - 2 * n + 1), lambda i: {{'n': n, 'i': i}}))), lambda x: {0}[x.i + 1 : x.i + x.n] = {0}[x.i + x.n + 1 : x.i + 2 * x.n])) AS x) q LIMIT 1)"
_COLLAPSE = f"""col AS (SELECT k, words, {_HIT.format("words")} AS hit FROM words UNION ALL SELECT k, new, {_HIT.format("new")} FROM (SELECT k, list_concat(words[1 : hit.i + hit.n], words[hit.i + 2 * hit.n + 1 :]) AS new FROM col WHERE hit IS NOT NULL) c),
short AS (SELECT k, array_to_string(words, ' ') AS resolved FROM col WHERE hit IS NULL)"""
_ENDINGS = "ltd|limited|inc|corp|corporation|llc|plc|pvt|private"
_CANONICAL = r"nullif(trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), '(?:(?:^| )(?:{1}))+$', ''), '^(?:the(?: |$))+', '')), '')"


@query(f"""WITH RECURSIVE {_ALIAS}, names AS (SELECT DISTINCT {_CANONICAL.format("text", _ENDINGS)} AS k FROM d), each_word AS (SELECT k, unnest(regexp_extract_all(k, '[a-z0-9]+')) AS w, generate_subscripts(regexp_extract_all(k, '[a-z0-9]+'), 1) AS p FROM names),
words AS (SELECT k, string_split(string_agg(coalesce(long_form, w), ' ' ORDER BY p), ' ') AS words FROM each_word LEFT JOIN map ON abbreviation = w GROUP BY k), {_COLLAPSE}
SELECT names.k AS name, resolved FROM names LEFT JOIN short ON short.k = names.k""")
def apply_aliases(spark, sf_dir):
    """Of distinct names, with the abbreviations that the whole corpus defines."""
    aliases = canonical.alias_map(canonical.alias_pairs(view(spark, sf_dir, DEFINITIONS)))
    names = view(spark, sf_dir, DEFINITIONS).select(canonical_name(F.col("text")).alias("name")).distinct()
    return canonical.apply_aliases(names.withColumn("id", F.col("name")), aliases).select("name", "resolved")


#: Names in the mouths of documents, of which some say what they call themselves.
_SAID = """SELECT 'doc-' || CAST(s_suppkey % 23 AS STRING) || '/' || CAST(s_suppkey AS STRING) AS fact_id, 'doc-' || CAST(s_suppkey % 23 AS STRING) AS document_id,
CASE s_suppkey % 5 WHEN 0 THEN 'our' WHEN 1 THEN 'company company' WHEN 2 THEN 'gfcf' WHEN 3 THEN 'cpi of company' ELSE NULL END AS canonical_subject,
CASE s_suppkey % 4 WHEN 0 THEN 'our revenue' WHEN 1 THEN 'company sales of the issuer' WHEN 2 THEN 'gross fixed capital formation gfcf' ELSE 'alpha company beta beta' END AS canonical_predicate FROM {supplier}"""
_OWN_WORDS = ", ".join(repr(w) for w in sorted([*canonical.SELF_NOUNS, *canonical.SELF_PRONOUNS]))
_SELF = rf"""sm AS (SELECT document_id, unnest(regexp_extract_all(text, '{canonical.SELF_DEFINITION.replace(chr(39), chr(39) * 2)}')) AS hit FROM d WHERE contains(text, '(')),
sn AS (SELECT document_id, lower(regexp_extract(trim(regexp_extract(hit, '^(.*?)\s*\(', 1)), '((?:^|\s)(?:[A-Z]\S*\s?)+)$')) AS name FROM sm),
sc AS (SELECT document_id, trim(name) AS name, count(*) AS n FROM sn WHERE trim(name) <> '' GROUP BY 1, 2), sb AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY n DESC, name) AS r FROM sc),
own AS (SELECT document_id, w AS abbreviation, issuer AS long_form FROM (SELECT document_id, regexp_replace(name, '( ({_ENDINGS}))+$', '') AS issuer FROM sb WHERE r = 1) s, (SELECT unnest([{_OWN_WORDS}]) AS w) v WHERE issuer <> w)"""


@query(f"""WITH RECURSIVE {_ALIAS}, {_SELF}, said AS ({duck(_SAID)}), named AS (SELECT document_id, fact_id || '|s' AS k, canonical_subject AS name FROM said UNION ALL SELECT document_id, fact_id || '|p', canonical_predicate FROM said),
each_word AS (SELECT document_id, k, unnest(regexp_extract_all(name, '[a-z0-9]+')) AS w, generate_subscripts(regexp_extract_all(name, '[a-z0-9]+'), 1) AS p FROM named WHERE name IS NOT NULL),
words AS (SELECT k, string_split(string_agg(coalesce(o.long_form, m.long_form, w), ' ' ORDER BY p), ' ') AS words FROM each_word e LEFT JOIN own o ON o.document_id = e.document_id AND o.abbreviation = w LEFT JOIN map m ON m.abbreviation = w GROUP BY k), {_COLLAPSE}
SELECT fact_id, document_id, s.resolved AS canonical_subject, p.resolved AS canonical_predicate FROM said LEFT JOIN short s ON s.k = fact_id || '|s' LEFT JOIN short p ON p.k = fact_id || '|p'""")
def normalize_names(spark, sf_dir):
    """What a document calls itself goes before what the corpus defines, word by word: 'our revenue', 'company sales'."""
    return canonical.resolved_names(view(spark, sf_dir, _SAID), view(spark, sf_dir, DEFINITIONS))


@query(f"WITH {_FACTS} SELECT fact_id, ent || ' | ' || claim || ' | ' || coalesce(eu, '') || ' | ' || coalesce(time_text, '') || ' | ' || coalesce(scope_text, '') || ' | ' || coalesce(value_text, '') AS text FROM f")
def embedding_text(spark, sf_dir):
    return facts(spark, sf_dir).select("fact_id", extract.embedding_text().alias("text"))


@query("SELECT doc_id, greatest(1, (octet_length(encode(text)) + 1) // 2)::BIGINT AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    from factloom.sources.views import read

    return read(spark, sf_dir, "documents").select("doc_id", estimate_tokens(F.col("text")).alias("tokens"))


