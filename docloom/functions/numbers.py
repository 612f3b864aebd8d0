"""Numbers, dates and small arithmetic as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"


def number(c: Column) -> Column:
    """The first number of a text, commas dropped; null if there is none."""
    return F.regexp_extract(F.translate(c, ",", ""), r"-?[0-9]+\.?[0-9]*", 0).try_cast("double")


def near(a: Column, b: Column, tolerance: float = 0.05) -> Column:
    """Whether two numbers differ by at most tolerance, relative to the larger."""
    top = F.greatest(F.abs(a), F.abs(b))
    return (top == 0) | (F.abs(a - b) / F.when(top > 0, top) <= tolerance)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def rounded(c: Column, digits: int) -> Column:
    """A double to so many digits as SQL engines on doubles do it: scaled, the nearest integer, halves away from zero.

    Spark's round() takes a double's shortest decimals, so 0.1234565 goes up even where the scaled double lies below the half."""
    scaled = F.abs(c) * 10.0**digits
    over = scaled % 1.0
    near_ = (scaled - over + F.when(over >= 0.5, 1.0).otherwise(0.0)) / 10.0**digits
    return F.when(scaled < 2.0**52, F.signum(c) * near_).otherwise(c)


def weighted(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the components that are present; 0 if none is."""
    top = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    below = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return F.when(below > 0, top / F.when(below > 0, below)).otherwise(0.0)


#: The four spellings in one pattern, and year, month and day of whichever matched; what matches none leaves "--".
_DATES = rf"^(?:([0-9]{{4}})-([0-9]{{1,2}})-([0-9]{{1,2}})|([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{4}})|([0-9]{{1,2}})\s+{_MONTH}\.?,?\s+([0-9]{{4}})|{_MONTH}\.?\s+([0-9]{{1,2}}),?\s+([0-9]{{4}}))$\R?|^[\s\S]*$"
_PARTS = "$1$6$9$12-$2$5$8$10-$3$4$7$11"


def flexible_date(c: Column) -> Column:
    """A date from Y-M-D, D/M/Y, D Month Y or Month D, Y; null for others and impossible ones. A text is matched once."""
    said = F.regexp_replace(F.lower(F.trim(c)), _DATES, _PARTS)
    month = F.substring_index(F.substring_index(said, "-", 2), "-", -1)
    number_ = ((F.call_function("locate", F.substring(month, 1, 3), F.lit("".join(MONTHS))) + 2) / 3).cast("int").cast("string")
    return F.concat_ws("-", F.substring_index(said, "-", 1), F.when(F.length(month) > 2, number_).otherwise(month), F.substring_index(said, "-", -1)).try_cast("date")


def recency(at: Column, now: Column, half_life_days: float = 90.0) -> Column:
    age = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(at)) / F.lit(86400e6))
    return F.pow(F.lit(0.5), age / half_life_days)


def half_up(c: Column) -> Column:
    """Rounded to an integer, halves upwards."""
    return F.floor(c + 0.5)


def shown(c: Column) -> Column:
    """A double as a plain decimal with at least one digit after the point."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e16)
    return F.when(whole, F.concat(c.cast("decimal(38,0)").cast("string"), F.lit(".0"))).otherwise(c.cast("string"))


def pdf_date(c: Column) -> Column:
    """The UTC instant of D:YYYYMMDD[HH[MM[SS]]]; null for others and impossible ones."""
    pattern = r"^D:([0-9]{4})([0-9]{2})([0-9]{2})([0-9]{2})?([0-9]{2})?([0-9]{2})?"
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(c, pattern, k), F.lit("")), F.lit("00"))
    said = F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit(" "), part(4), F.lit(":"), part(5), F.lit(":"), part(6))
    return F.when(F.rlike(c, F.lit(pattern)), F.try_to_timestamp(said, F.lit("yyyy-MM-dd HH:mm:ss")))


def ago(at: Column, now: Column) -> Column:
    """How long ago, in minutes, hours or days, each rounded from the one before, halves up."""
    minutes = half_up((F.unix_micros(now) - F.unix_micros(at)) / F.lit(60e6))
    hours = half_up(minutes / 60)
    said = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return F.when(minutes < 1, "just now").when(minutes < 60, said(minutes, "m")).when(hours < 24, said(hours, "h")).otherwise(said(half_up(hours / 24), "d"))


def signed(c: Column, decimals: int = 1) -> Column:
    return F.concat(F.when(c > 0, "+").otherwise(""), F.format_string(f"%.{decimals}f", c))
