"""Numbers, value kinds and canonical units. Column expressions; nothing here raises on bad text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

# Magnitude suffixes of numbers and their factors.
SUFFIXES = {"trillion": 1e12, "billion": 1e9, "million": 1e6, "thousand": 1e3, "crore": 1e7, "lakh": 1e5, "lac": 1e5, "mn": 1e6, "cr": 1e7, "bn": 1e9, "b": 1e9, "m": 1e6, "k": 1e3, "t": 1e12}
# Currency marks before a number, of which the first that fits is dropped.
PREFIXES = ("₹", "rs.", "rs", "$", "€", "£", "inr", "usd")
# Currencies by token, and what their amounts are counted in.
CURRENCIES = {"₹": "INR", "rs": "INR", "re": "INR", "inr": "INR", "$": "USD", "usd": "USD", "€": "EUR", "eur": "EUR", "£": "GBP", "gbp": "GBP"}
CURRENCY_UNITS = {"INR": ("INR crore", 1e7), "USD": ("USD million", 1e6), "EUR": ("EUR million", 1e6), "GBP": ("GBP million", 1e6)}
# Scale words that imply rupees; masses in a million tonnes; masses that may mean several units.
INDIAN_SCALES = ("cr", "crore", "lakh", "lac")
MASSES = {"tonne": 1e6, "tonnes": 1e6} | dict.fromkeys("kg kgs kilogram kilograms kilogramme kilogrammes".split(), 1e9) | dict.fromkeys("g gram grams gramme grammes".split(), 1e12)
VAGUE_MASSES = ("t", "ton", "tons")
# Currency words without a canonical scale.
UNKNOWN_CURRENCIES = (
    "¥ ₩ ₽ ¢ ₺ jpy yen cny yuan rmb krw won rub ruble rouble chf aud cad hkd sgd nzd mxn peso pesos brl real reais zar rand aed "
    "dirham sar riyal riyals sek nok dkk kr krone kroner krona kronor pln zloty thb baht myr ringgit idr rupiah php pkr bdt taka "
    "lkr npr kes ngn naira egp try lira liras ils shekel shekels qar kwd bhd omr jod twd ars clp cop pen uah ron huf forint czk "
    "koruna vnd dong dollar dollars buck bucks cent cents pence penny pennies paise paisa rupee rupees pound pounds sterling euro "
    "euros franc francs"
).split()
# Units of measurement without a conversion.
UNKNOWN_UNITS = (
    "lb lbs oz ounce ounces quintal quintals mt kt megaton megatons megatonne megatonnes kiloton kilotons kilotonne kilotonnes gt "
    "gigatonne gigatonnes stone stones grain grains carat carats furlong furlongs mile miles km kilometre kilometres kilometer "
    "kilometers cm centimetre centimetres centimeter centimeters mm millimetre millimetres millimeter millimeters metre metres "
    "meter meters ft feet foot inch inches yard yards nm litre litres liter liters gallon gallons ml cl dl barrel barrels pint "
    "pints quart quarts acre acres hectare hectares sqm sqft joule joules watt watts kw kwh mw gw volt volts amp amps celsius "
    "fahrenheit kelvin degree degrees byte bytes bit bits kb mb gb tb pb ms msec millisecond milliseconds"
).split()

SUFFIX_PATTERN = "|".join(SUFFIXES)
PREFIX_PATTERN = "|".join(p.replace("$", r"\$").replace(".", r"\.") for p in PREFIXES)
NUMBER_PATTERN = r"^(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*)(?:e[+-]?[0-9]+)?$"
# Magnitude words that a unit may hold.
MAGNITUDES = "thousand|trillion|million|billion|crore|lakh|lac|mn|cr|bn|k|m|b|t"
TOLERANCE = 0.01


def table(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for item in pairs.items() for x in item))


def parse_number(c: Column) -> Column:
    """The number a text states: signs, one currency mark, thousands separators, percent words and one magnitude suffix.

    A text in parentheses as a whole is negative. NaN and infinities are no numbers here; null where it isn't one."""
    shape = rf"(?s)^([+-]*)(?:{PREFIX_PATTERN})?([+-]*)(.*)$"
    scaled = rf"(?s)^(.*[0-9].*?)({SUFFIX_PATTERN})$"

    def value(x: Column) -> Column:
        core = F.when(x["suffix"] != "", F.regexp_extract(x["rest"], scaled, 1)).otherwise(x["rest"])
        number = let(core, lambda t: F.when(t.rlike(NUMBER_PATTERN), F.regexp_replace(t, "_", "").try_cast("double")))
        sign = F.when(x["negative"], -1.0).otherwise(1.0)
        return number * sign * F.coalesce(F.try_element_at(table(SUFFIXES), x["suffix"]), F.lit(1.0))

    def suffixed(x: Column) -> Column:
        signs = F.regexp_count(F.concat(F.regexp_extract(x["inner"], shape, 1), F.regexp_extract(x["inner"], shape, 2)), F.lit("-"))
        rest = F.regexp_replace(F.regexp_extract(x["inner"], shape, 3), r"(?:%|percent(?:age)?s?)$", "")
        return let(rest, lambda r: let(F.struct(r.alias("rest"), F.regexp_extract(r, scaled, 2).alias("suffix"), (x["wrapped"] != (signs % 2 == 1)).alias("negative")), value))

    def unwrapped(s: Column) -> Column:
        wrapped = s.startswith("(") & s.endswith(")") & (F.length(s) > 1)
        inner = F.when(wrapped, F.regexp_replace(s, r"(?s)^\(|\)$", "")).otherwise(s)
        return let(F.struct(inner.alias("inner"), wrapped.alias("wrapped")), suffixed)

    s = F.regexp_replace(F.lower(strip(c)), "[, ]", "")
    return F.when(c.rlike("[0-9]"), let(s, unwrapped))


def says_percent(c: Column) -> Column:
    return strip(c).rlike(r"(?i)(?:%|per\s?cent(?:age)?s?)\s*$")


def resolved_kind(text: Column, drafted: Column, number: Column | None = None) -> Column:
    """struct(kind, flags): what the text is, whatever the draft says; corrections are flagged. number: parse_number(text), where it is at hand."""
    said = F.struct((parse_number(text) if number is None else number).isNotNull().alias("number"), F.coalesce(says_percent(text), F.lit(False)).alias("percent"), drafted.alias("drafted"))
    return let(said, lambda x: _kind(x["number"], x["percent"], x["drafted"]))


def _kind(number: Column, percent: Column, drafted: Column) -> Column:
    kind = F.when(percent, "PERCENTAGE").when(number, "NUMERIC").when(drafted.isin("NUMERIC", "PERCENTAGE"), drafted).otherwise("TEXT")
    corrected = F.when(percent & (drafted != "PERCENTAGE"), F.concat(F.lit("kind_corrected:"), drafted, F.lit("->PERCENTAGE"))).when(~percent & number & ~drafted.isin("NUMERIC", "PERCENTAGE"), F.concat(F.lit("kind_corrected:"), drafted, F.lit("->NUMERIC")))
    unparsed = F.when(~percent & ~number & drafted.isin("NUMERIC", "PERCENTAGE"), "value_unparseable")
    return F.struct(kind.alias("kind"), F.array_compact(F.array(corrected, unparsed)).alias("flags"))


def unit_tokens(c: Column) -> Column:
    """Words of any script and single currency signs, lower case, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)[₹$€£¥₩₽¢₺]|\w+"), F.lit(0))


#: What a token is, for the three sets of words without a conversion.
ODD_TOKENS = dict.fromkeys(UNKNOWN_CURRENCIES, "currency") | dict.fromkeys(UNKNOWN_UNITS, "unit")


def first_of(tokens: Column, known: dict) -> Column:
    """The first token that is a key."""
    return F.get(F.filter(tokens, lambda t: F.map_contains_key(table(dict.fromkeys(known, True)), t)), F.lit(0))


def first_odd(tokens: Column, kind: str) -> Column:
    return F.get(F.filter(tokens, lambda t: F.try_element_at(table(ODD_TOKENS), t) == kind), F.lit(0))


def strip_magnitudes(c: Column) -> Column:
    """A unit without its magnitude words; null when nothing else is left."""
    bare = F.regexp_replace(c, rf"(?i)(?<![A-Za-z0-9])(?:{MAGNITUDES})s?(?![A-Za-z0-9])", " ")
    return F.nullif(F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r"^[ \t,;:.]+|[ \t,;:.]+$", ""), F.lit(""))


def normalized(kind: Column, number: Column, unit: Column, text: Column) -> Column:
    """struct(number, unit, flag): the value in its canonical unit; a flag where the unit can't be resolved.

    The order of cases decides. Text and missing numbers are left alone, without a flag."""
    points, basis = r"(?<![a-z0-9])(?:percentage points?|pp)(?![a-z0-9])", r"(?<![a-z0-9])(?:basis points?|bps?)(?![a-z0-9])"
    none = F.lit(None)

    def out(n, name, flag=None):
        return F.struct(n.cast("double").alias("number"), (name if isinstance(name, Column) else F.lit(name)).cast("string").alias("unit"), (flag if isinstance(flag, Column) else F.lit(flag)).cast("string").alias("flag"))

    def percentage(x: Column) -> Column:
        both = F.lower(F.concat_ws(" ", F.coalesce(x["unit"], F.lit("")), F.coalesce(x["text"], F.lit(""))))
        return let(both, lambda b: F.when(b.rlike(points), out(x["number"], "percentage_point")).when(b.rlike(basis), out(x["number"] * 0.0001, "fraction")).otherwise(out(x["number"] / 100.0, "fraction")))

    def by_currency(x: Column) -> Column:
        currency = F.try_element_at(table(CURRENCIES), F.coalesce(first_of(x["u"], CURRENCIES), first_of(x["v"], CURRENCIES)))
        names, divisors = ({k: v[i] for k, v in CURRENCY_UNITS.items()} for i in (0, 1))
        return let(currency, lambda c: F.when(c.isNotNull(), out(x["value"] / F.try_element_at(table(divisors), c), F.try_element_at(table(names), c))))

    def by_mass(x: Column) -> Column:
        return let(F.try_element_at(table(MASSES), first_of(x["u"], MASSES)), lambda m: F.when(m.isNotNull(), out(x["value"] / m, "million tonnes")))

    def unresolved(x: Column) -> Column:
        strange = let(F.coalesce(first_odd(x["u"], "currency"), first_odd(x["v"], "currency")), lambda t: F.when(t.isNotNull(), out(none, None, F.concat(F.lit("norm:currency_unknown:"), t))))
        vague = F.when(F.exists(x["u"], lambda t: t.isin(*VAGUE_MASSES)), out(none, None, "norm:unit_ambiguous:t"))
        measure = let(first_odd(x["u"], "unit"), lambda t: F.when(t.isNotNull(), out(none, None, F.concat(F.lit("norm:unit_unknown:"), t))))
        return F.coalesce(strange, vague, measure)

    def plain(x: Column) -> Column:
        indian = F.exists(F.concat(x["u"], x["v"]), lambda t: t.isin(*INDIAN_SCALES))
        return let(strip_magnitudes(x["unit"]), lambda bare: F.when(indian & bare.isNull(), out(x["value"] / 1e7, "INR crore")).otherwise(out(x["value"], bare)))

    def numeric(x: Column) -> Column:
        carried = F.coalesce(x["text"], F.lit("")).rlike(rf"(?i)(?<![A-Za-z])(?:{MAGNITUDES})s?(?![A-Za-z0-9])")
        scale = F.when(carried, 1.0).otherwise(F.coalesce(F.try_element_at(table(SUFFIXES), first_of(x["u"], SUFFIXES)), F.lit(1.0)))
        scaled = F.struct(*(x[c].alias(c) for c in ("unit", "u", "v", "low")), (x["number"] * scale).alias("value"))
        return let(scaled, lambda y: F.when(y["low"].rlike(points), out(y["value"], "percentage_point")).when(y["low"].rlike(basis), out(y["value"] * 0.0001, "fraction"))
            .when(strip(y["low"]).rlike(r"^(?:%|per ?cent(?:age)?|percent(?:age)?)$"), out(y["value"] / 100.0, "fraction"))
            .otherwise(F.coalesce(by_currency(y), by_mass(y), unresolved(y), plain(y))))

    given = F.struct(kind.alias("kind"), number.alias("number"), unit.alias("unit"), text.alias("text"))
    tokens = lambda x: F.struct(*(x[c].alias(c) for c in ("number", "unit", "text")), unit_tokens(x["unit"]).alias("u"), unit_tokens(x["text"]).alias("v"), F.lower(F.coalesce(x["unit"], F.lit(""))).alias("low"))
    return let(given, lambda x: F.when((x["kind"] == "TEXT") | x["number"].isNull(), out(none, None)).when(x["kind"] == "PERCENTAGE", percentage(x)).otherwise(let(tokens(x), numeric)))


def relative_difference(x: Column, y: Column) -> Column:
    return F.when((x == 0) & (y == 0), 0.0).otherwise(F.try_divide(F.abs(x - y), F.greatest(F.abs(x), F.abs(y))))


def combine(lexical: Column, vector: Column) -> Column:
    """struct(score, match): the mean of two scores above 0, or the one there is; null when there is none."""
    a, b = F.coalesce(lexical, F.lit(0.0)) > 0, F.coalesce(vector, F.lit(0.0)) > 0

    def out(s, m):
        return F.struct(s.cast("double").alias("score"), F.lit(m).alias("match"))

    return F.when(a & b, out((lexical + vector) / 2, "hybrid")).when(a, out(lexical, "lexical")).when(b, out(vector, "vector"))
