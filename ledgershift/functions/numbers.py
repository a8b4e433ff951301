"""Numbers in report cells as Column functions: parsing, literal checks, tolerances, score bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Score bands on whole percent, from the highest.
BANDS = ((90, "very_high"), (70, "high"), (40, "review"))
TOP_SCORE = 0.99


def close(a: Column, b: Column, relative: float = 1e-9, absolute: float = 0.0) -> Column:
    """Whether two numbers agree within a relative or an absolute tolerance."""
    return F.abs(a - b) <= F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def percent_change(before: Column, delta: Column) -> Column:
    """delta in percent of |before|; null where before is 0."""
    return F.when(before != 0, delta / F.abs(before) * 100)


# Units that may follow a number in a cell, and a number that could be grouped or a fraction.
CELL_UNITS = r"%|дн(?:ей|я)?\.?|день|дни|шт\.?|чел\.?|fte|балл\w*|(?:тыс\.?\s*)?(?:руб\.?|тенге|тг|₸|₽|usd|kzt|eur)"
EITHER_WAY = r"[1-9]\d{0,2}[,.]\d{3}"


def parse_number(text: Column, number_format: Column | None = None, number: Column | None = None) -> Column:
    """A cell -> struct(value double, unit string, reason string): reason is null for a number, else why it is none.

    text: spaces between digits group them, a comma is a decimal point, the minus sign counts, one known unit may follow.
    `1,234` and `1.234` could be either and are refused, as are formulas. number: the value of a numeric cell, which is
    taken as it is. A cell format with % multiplies by 100 what a numeric cell holds, or a text without any unit.
    """
    t = F.trim(F.translate(text, "\u00a0\u202f\u2212", "  -"))
    pattern = rf"(?iU)^([+-]?\d[\d ]*(?:[.,]\d+)?)\s*({CELL_UNITS})?$"
    digits, unit = F.replace(F.regexp_extract(t, pattern, 1), F.lit(" "), F.lit("")), F.lower(F.regexp_extract(t, pattern, 2))
    value = F.nullif(F.regexp_replace(digits, ",", "."), F.lit("")).try_cast("double")
    either = digits.rlike(rf"^{EITHER_WAY}$")
    if number is not None:
        value, unit, either = F.coalesce(number, value), F.when(number.isNull(), unit).otherwise(""), either & number.isNull()
        t = F.when(number.isNotNull(), "0").otherwise(t)
    if number_format is not None:
        shown = number_format.contains("%") & (unit == "")
        value, unit = F.when(shown, value * 100).otherwise(value), F.when(shown, "%").otherwise(unit)
    reason = F.when(t.isNull() | (t == ""), "empty").when(t.startswith("="), "formula").when(either, "ambiguous").when(value.isNull() | F.isnan(value), "not_a_number")
    return F.struct(F.when(reason.isNull(), value).alias("value"), F.when(reason.isNull(), unit).alias("unit"), reason.alias("reason"))


def literal_in(value: Column, quote: Column, grouped: bool = False) -> Column:
    """Whether one of the numbers written in quote, none inside a word, is the value (to 1e-9 of it); spaces may group thousands.

    grouped: for a human's answer, `1,234` and `1.234` may stand for 1234 too.
    """
    found = F.regexp_extract_all(quote, F.lit(r"(?U)(?<!\w)[-+]?\d+(?:[ \u00a0\u202f]\d{3})*(?:[.,]\d+)?"), 0)
    plain = lambda x: F.regexp_replace(F.regexp_replace(x, "[ \u00a0\u202f]", ""), ",", ".").try_cast("double")
    same = lambda x: close(plain(x), value, 1e-9, 1e-9)
    whole = lambda x: x.rlike(rf"^{EITHER_WAY}$") & close(F.regexp_replace(x, "[.,]", "").try_cast("double"), value)
    return F.exists(found, lambda x: F.coalesce(same(x) | whole(x) if grouped else same(x), F.lit(False)))


def clamp_score(score: Column, cap: float | Column = TOP_SCORE) -> Column:
    """A score between 0 and its cap, never over .99, to two digits."""
    top = cap if isinstance(cap, Column) else F.lit(float(cap))
    return F.round(F.greatest(F.lit(0.0), F.least(score, top, F.lit(TOP_SCORE))), 2)


def band(score: Column) -> Column:
    out = F.lit("weak")
    for least, name in reversed(BANDS):
        out = F.when(F.round(score * 100) >= least, name).otherwise(out)
    return out
