"""Numbers, periods, units, names: small tables of cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from factloom.functions.numbers import combine, normalized, parse_number, relative_difference
from factloom.functions.periods import parse_time
from factloom.functions.text import canonical_name, estimate_tokens, jaccard, tokens, unfenced, uuid5
from factloom.functions.vectors import cosine, unit
from factloom.operators import canonical, extract


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


NUMBERS = {
    "81,415": 81415, "1,429K": 1429000, "1.6%": 1.6, "(1,234)": -1234, "6.4 per cent": 6.4, "13.6 percent": 13.6, "5 percentage": 5, "-2,500 Cr": -2.5e10, "-1.5 Mn": -1.5e6, "₹-5": -5, "-₹5": -5, "(₹5)": -5, "--3": 3, "n/a": None, "": None, "-": None,
    "(2.3)%": None, "(2.3%)": -2.3, "1,429K tonnes": None, "5 crores": None, "10 t": 1e13, "1 234": 1234, "$-5": -5, "€1.2bn": 1.2e9, "5d": None, "1_000": 1000, "1__0": None, "nan": None, "inf": None, "1e5": 1e5,
}


def test_numbers(spark):
    assert column(spark, list(NUMBERS), parse_number) == [None if v is None else pytest.approx(v, rel=1e-12) for v in NUMBERS.values()]


PERIODS = {"FISCAL_YEAR": ["FY24", "H1 FY25", "H1 of FY25", "Fiscal 2021"], "QUARTER": ["Q1", "Q4 FY24", "Q1 FY2025/26", "Q1:2024-25", "Q2 2024-25", "Q2 of FY25"], "RANGE": ["2024", "year ended March 31, 2024", "three months ended 30 June 2024", "for the year ended March 31, 2023"], "UNKNOWN": ["Quarterly", "Q5 FY24", "Q", "ended", "period", "ended 2024", "year", "End-December 2024", "", None, "30 February 2024"]}


def test_periods(spark):
    for kind, texts in PERIODS.items():
        assert [t["kind"] for t in column(spark, texts, parse_time)] == [kind] * len(texts)
    day = column(spark, ["2024-05-17", "13 January 2022", "January 13, 2022", "As of December 31, 2021", "May 2024", "February 2024"], parse_time)
    assert [(t["start"], t["end"]) for t in day] == [(dt.date(2024, 5, 17),) * 2, (dt.date(2022, 1, 13),) * 2, (dt.date(2022, 1, 13),) * 2, (dt.date(2021, 12, 31),) * 2, (dt.date(2024, 5, 1), dt.date(2024, 5, 31)), (dt.date(2024, 2, 1), dt.date(2024, 2, 29))]


UNITS = [
    ("NUMERIC", 81415.0, "units", "81,415", 81415, "units", None), ("NUMERIC", 8.1415e10, "Rs Mn", "Rs 81415 Mn", 8141.5, "INR crore", None), ("NUMERIC", 1429000.0, "K tonnes", "1,429K", 1.429, "million tonnes", None), ("NUMERIC", 5e6, "$", "5 million", 5, "USD million", None),
    ("NUMERIC", 14.0, "US$ billion", "14.0", 14000, "USD million", None), ("NUMERIC", 740.0, "Mn express parcels", "740", 7.4e8, "express parcels", None), ("PERCENTAGE", 6.5, "%", "6.5%", 0.065, "fraction", None), ("PERCENTAGE", 6.5, "pp", "6.5 pp", 6.5, "percentage_point", None),
    ("NUMERIC", 1.7, "bps", "1.7", 0.00017, "fraction", None), ("NUMERIC", 1.2, "% of GDP", "1.2", 1.2, "% of GDP", None), ("NUMERIC", 100.0, "JPY", "100", None, None, "norm:currency_unknown:jpy"), ("NUMERIC", 3.0, "t", "3", None, None, "norm:unit_ambiguous:t"),
    ("NUMERIC", 3.0, "furlongs", "3", None, None, "norm:unit_unknown:furlongs"), ("NUMERIC", 740.0, None, "740", 740, None, None), ("NUMERIC", None, "units", "n/a", None, None, None), ("TEXT", None, "units", "x", None, None, None), ("NUMERIC", 3.0, "millions", "3", 3, None, None),
]


def test_units(spark):
    df = spark.createDataFrame([(i, *u[:4]) for i, u in enumerate(UNITS)], "i int, k string, n double, u string, t string")
    got = [r.z for r in df.select("i", normalized(F.col("k"), F.col("n"), F.col("u"), F.col("t")).alias("z")).orderBy("i").collect()]
    for g, u in zip(got, UNITS):
        assert (g["unit"], g["flag"]) == u[5:], u
        assert g["number"] == (None if u[4] is None else pytest.approx(u[4])), u


def test_names(spark):
    cases = {"The Alpha Pvt. Ltd.": "alpha", "the The Beta": "beta", "The Ltd": None, "Theatre Limited": "theatre", "Société": "soci t", "": None, "A, Inc": "a"}
    assert column(spark, list(cases), canonical_name) == list(cases.values())


def test_small_functions(spark):
    assert column(spark, ["", "ab", "é", None, "abc"], estimate_tokens) == [1, 1, 1, 1, 2]
    assert column(spark, ['```json\n{"a": 1}\n```', 'so: {"a": [1]} ok', "[1] x"], unfenced) == ['{"a": 1}', '{"a": [1]}', "[1] x"]
    import uuid

    ns = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    assert column(spark, ["d:1:2:TEXT", "é"], lambda c: uuid5(ns, c)) == [str(uuid.uuid5(uuid.UUID(ns), x)) for x in ("d:1:2:TEXT", "é")]
    assert column(spark, ["Alpha beta", "", None], lambda c: jaccard(tokens(c), tokens(F.lit("beta gamma")))) == [1 / 3, 0, 0]
    v = column(spark, [[3.0, 4.0], [0.0, 0.0], [1.0], []], lambda c: cosine(c, F.array(F.lit(3.0), F.lit(4.0))), "array<double>")
    assert v == [1.0, 0.0, 0.0, 0.0]
    assert column(spark, [[3.0, 4.0], [0.0]], unit, "array<double>") == [[0.6, 0.8], [0.0]]
    df = spark.createDataFrame([(0.0, 0.0), (100.0, 101.0), (None, 1.0)], "x double, y double")
    assert [r.d for r in df.select(relative_difference(F.col("x"), F.col("y")).alias("d")).collect()] == [0.0, 1 / 101, None]
    df = spark.createDataFrame([(0.4, 0.6), (0.4, None), (0.0, 0.3), (0.0, 0.0)], "l double, v double")
    assert [tuple(r.s) if r.s else None for r in df.select(combine(F.col("l"), F.col("v")).alias("s")).collect()] == [(0.5, "hybrid"), (0.4, "lexical"), (0.3, "vector"), None]


def test_collapse():
    assert canonical.collapse("a b a b c c".split()) == "a b c".split()
    assert canonical.collapse([]) == []
    assert canonical.collapse("x y x".split()) == "x y x".split()


def test_repair():
    assert extract.repair('{"a": [1, 2') is not None
    assert extract.repair('{"a": "x", "b": "cut of') == '{"a": "x", "b": "cut of"}'
    assert extract.repair('{"a": {"b": 1}, "c"') == '{"a": {"b": 1}}'
    assert extract.repair('{"a"') == '{"a"'
    assert extract.repair(None) is None


def test_budget():
    assert extract.token_budget(16384, 4000, 500, 200) == 11684
    with pytest.raises(ValueError):
        extract.token_budget(1000, 600, 0, 0)
