"""Periods: what kind of time a text names, and its dates where they are certain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import folded, let, present, strip

MONTHS = "January February March April May June July August September October November December".split()
# The shapes of period texts.
FISCAL_YEAR = r"(?i)^(?:h[12]\s*(?:of\s*)?)?(?:fy|fiscal)\s?([0-9]{2}|[0-9]{4})(?:\s*[-–/]\s*([0-9]{2}|[0-9]{4}))?$"
QUARTER = r"(?i)^q[1-4](?:\s*[:\s]\s*(?:of\s+)?(?:fy|fiscal)?\s*[0-9]{2,4}(?:\s*[-–/]\s*[0-9]{2,4})?)?$"
ISO_DATE = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})$"
DAY_MONTH_YEAR = r"^([0-9]{1,2})\s+([A-Za-z]+)\s+([0-9]{4})$"
MONTH_DAY_YEAR = r"(?i)^(?:as\s+(?:of|on|at)\s+)?([A-Za-z]+)\s+([0-9]{1,2}),\s*([0-9]{4})$"
MONTH_YEAR = r"^([A-Za-z]+)\s+([0-9]{4})$"
YEARS = r"^([0-9]{4})\s*[-–/]\s*([0-9]{2}|[0-9]{4})$"
YEAR = r"^([0-9]{4})$"
PERIOD_ENDED = r"(?i)^(?:for\s+the\s+)?(?:[a-z]+[-\s])*(?:year|quarter|half|months?|period)(?:\s+period)?\s+end(?:ed|ing).*[0-9]{4}\s*$"


def month(name: Column) -> Column:
    """01 to 12 of a full English name; else null."""
    numbers = F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m.lower(), f"{i:02d}")))
    return F.try_element_at(numbers, F.lower(name))


def parse_time(c: Column) -> Column:
    """struct(kind, start, end). Fiscal years, quarters and ranges have no dates; impossible dates are UNKNOWN."""
    none = F.lit(None).cast("date")

    def out(kind, start=none, end=none):
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"))

    def day(y: Column, m: Column, d: Column) -> Column:
        return F.when(y != "0000", F.try_to_date(F.concat_ws("-", y, m, F.lpad(d, 2, "0")), "yyyy-MM-dd"))

    def dated(d: Column) -> Column:
        return let(d, lambda x: F.when(x.isNotNull(), out("DATE", x, x)).otherwise(out("UNKNOWN")))

    def named(s: Column, pattern: str, y: int, m: int, d: int | None, then, otherwise: Column) -> Column:
        """The shape with a month's name, if it is one; else what the later shapes give."""
        part = lambda i: F.regexp_extract(s, pattern, i)
        found = let(F.struct(part(y).alias("y"), month(part(m)).alias("m"), (F.lit("01") if d is None else part(d)).alias("d")), lambda x: F.when(x["m"].isNotNull(), then(day(x["y"], x["m"], x["d"]))))
        return F.coalesce(found, otherwise)

    def of(s: Column) -> Column:
        rest = F.when(s.rlike(YEARS) | s.rlike(YEAR) | s.rlike(PERIOD_ENDED), out("RANGE")).otherwise(out("UNKNOWN"))
        whole = lambda d: let(d, lambda x: F.when(x.isNotNull(), out("DATE", x, F.last_day(x))))
        # The three shapes exclude each other, so that one that fails goes on to the last cases alone.
        by_month = F.when(s.rlike(MONTH_YEAR), named(s, MONTH_YEAR, 2, 1, None, whole, rest)).otherwise(rest)
        by_name = F.when(s.rlike(DAY_MONTH_YEAR), named(s, DAY_MONTH_YEAR, 3, 2, 1, dated, rest)).when(s.rlike(MONTH_DAY_YEAR), named(s, MONTH_DAY_YEAR, 3, 1, 2, dated, rest)).otherwise(by_month)
        iso = dated(day(F.substring(s, 1, 4), F.substring(s, 6, 2), F.substring(s, 9, 2)))
        return F.when(s.rlike(FISCAL_YEAR), out("FISCAL_YEAR")).when(s.rlike(QUARTER), out("QUARTER")).when(s.rlike(ISO_DATE), iso).otherwise(by_name)

    return F.when(present(c), let(strip(c), of)).otherwise(out("UNKNOWN"))


def compare_time(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """COMPATIBLE, INCOMPATIBLE or UNKNOWN; a and b give kind, text, start and end."""
    has_a, has_b = present(a["text"]), present(b["text"])
    dates = a["start"].isNotNull() & a["end"].isNotNull() & b["start"].isNotNull() & b["end"].isNotNull()
    return (
        F.when((a["kind"] == "UNKNOWN") | (b["kind"] == "UNKNOWN"), "UNKNOWN")
        .when(a["kind"] != b["kind"], "INCOMPATIBLE")
        .when(has_a & has_b & (folded(a["text"]) == folded(b["text"])), "COMPATIBLE")
        .when(dates & (F.greatest(a["start"], b["start"]) <= F.least(a["end"], b["end"])), "COMPATIBLE")
        .when(dates | (has_a & has_b), "INCOMPATIBLE")
        .otherwise("UNKNOWN")
    )
