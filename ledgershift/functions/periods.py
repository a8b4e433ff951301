"""Calendar periods as Column functions: bounds, midpoints, parsing and validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Months in a period of each granularity.
MONTHS = {"month": 1, "quarter": 3, "year": 12}

# Beginnings of month names as reports write them, and what a dated order or minutes says.
MONTH_NAMES = {"янв": 1, "фев": 2, "мар": 3, "апр": 4, "май": 5, "мая": 5, "июн": 6, "июл": 7, "авг": 8, "сен": 9, "окт": 10, "ноя": 11, "дек": 12}
WHOLE_NAMES = ("май", "мая")
ORDERS = "утвержд|протокол|приказ|редакци"


def bounds(day: Column, granularity: str) -> tuple[Column, Column]:
    """First and last day of the calendar period that holds `day`."""
    start = F.trunc(day, granularity).cast("date")
    return start, F.last_day(F.add_months(start, MONTHS[granularity] - 1))


def is_full_period(start: Column, end: Column, granularity: str) -> Column:
    """Whether [start, end] is exactly one calendar period."""
    first, last = bounds(start, granularity)
    return (start == first) & (end == last)


def ordinal(day: Column) -> Column:
    """Days since 0001-01-01, counting that day as 1."""
    return F.datediff(day, F.to_date(F.lit("0001-01-01"))) + 1


def midpoint(start: Column, end: Column) -> Column:
    """The middle of a closed period as an ordinal; half days occur."""
    return (ordinal(start) + ordinal(end)) / 2.0


def parse_period(text: Column) -> Column:
    """A reporting period written in words -> struct(start date, end date, granularity string), or null.

    Quarters ("Q1 2023", "2023 q1", "1 кв. 2023", "1 quarter 2023"), months ("2023-12", "2023/1", "2023.12", a Russian
    month name and a year of two or four digits) and years ("2022", "отчет за 2023 год", "период 2023"). Full dates,
    approvals, orders and editions, and texts with two different years give null.
    """
    year, gap = r"((?:19|20)\d{2})", "[, ._/-]*"
    quarters = rf"(?:q\s*([1-4])\s*{gap}{year}|([1-4])\s*(?:кв(?:артал)?\.?|quarter)\s*{gap}{year}|{year}\s*{gap}q\s*([1-4]))"
    named = r"(?U)(" + "|".join(n if n in WHOLE_NAMES else rf"{n}\w*" for n in MONTH_NAMES) + r")[ ._-]*((?:19|20)?\d{2})(?!\d)"
    digits = rf"(?<!\d){year}[-/.](0?[1-9]|1[0-2])(?:[-/.]01)?(?!\d)"
    annual = rf"^(?:(?:отчет\s+за|за|год|период)\s*[:=|]?\s*)?{year}(?:\s*(?:г\.?|год(?:а|у)?))?$"
    dated = r"(?<!\d)\d{4}-\d{2}-\d{2}(?!\d)|(?<!\d)\d{1,2}[./]\d{1,2}[./]\d{4}(?!\d)"
    numbers = F.create_map(*(F.lit(x) for kv in MONTH_NAMES.items() for x in kv))

    def read(t: Column) -> Column:
        part = lambda pattern, i: F.nullif(F.regexp_extract(t, pattern, i), F.lit(""))
        first = lambda pattern, *groups: F.coalesce(*(part(pattern, i) for i in groups)).cast("int")
        short = part(named, 2).cast("int")
        return F.struct(
            (t.rlike(ORDERS) | t.rlike(dated) | (F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(rf"(?<!\d){year}(?!\d)"), 1))) > 1)).alias("other"),
            first(quarters, 1, 3, 6).alias("quarter"), first(quarters, 2, 4, 5).alias("quarter_year"),
            first(digits, 2).alias("month"), first(digits, 1).alias("month_year"),
            F.element_at(numbers, F.substring(part(named, 1), 1, 3)).alias("named"), (short + F.when(short < 100, 2000).otherwise(0)).alias("named_year"),
            first(annual, 1).alias("year"),
        )

    def first_day(x: Column) -> Column:
        one = F.lit(1)
        by_quarter, by_month, by_name = x["quarter"].isNotNull(), x["month"].isNotNull(), x["named"].isNotNull()
        start = F.when(by_quarter, F.make_date(x["quarter_year"], x["quarter"] * 3 - 2, one)).when(by_month, F.make_date(x["month_year"], x["month"], one)).when(by_name, F.make_date(x["named_year"], x["named"], one)).otherwise(F.make_date(x["year"], one, one))
        return F.struct(F.when(~x["other"], start).alias("start"), F.when(by_quarter, 3).when(by_month | by_name, 1).otherwise(12).alias("months"))

    def period(x: Column) -> Column:
        kind = F.when(x["months"] == 3, "quarter").when(x["months"] == 1, "month").otherwise("year")
        return F.when(x["start"].isNotNull(), F.struct(x["start"].alias("start"), F.last_day(F.add_months(x["start"], x["months"] - 1)).alias("end"), kind.alias("granularity")))

    plain = F.translate(F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")), "ё", "е")
    return let(let(let(plain, read), first_day), period)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use refers to it."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), 0)
