"""Times as people write them, and rates: parsers give seconds as doubles or null, formats give text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WHOLE, _DECIMAL = r"^\s*[-+]?\d+\s*$", r"^\s*[-+]?(\d+\.?\d*|\.\d+)\s*$"


def flexible_seconds(x: Column) -> Column:
    """Seconds of `s`, `m:s` or `h:m:s`, a comma as decimal point allowed; null for anything else."""
    part = F.split(F.replace(F.trim(x), F.lit(","), F.lit(".")), ":")

    def number(i: int, pattern: str) -> Column:
        p = F.try_element_at(part, F.lit(i))
        return F.when(p.rlike(pattern), F.trim(p).try_cast("double"))

    one = number(1, _DECIMAL)
    two = number(1, _WHOLE) * 60 + number(2, _DECIMAL)
    three = number(1, _WHOLE) * 3600 + number(2, _WHOLE) * 60 + number(3, _DECIMAL)
    return F.when(F.size(part) == 1, one).when(F.size(part) == 2, two).when(F.size(part) == 3, three)


def clock_seconds(x: Column) -> Column:
    """Seconds of a clock of two or three parts, or of a plain number; 0 for anything else."""
    part = F.split(F.replace(F.trim(x), F.lit(","), F.lit(".")), ":")
    numbers = F.transform(part, lambda p: F.when(p.rlike(_DECIMAL), F.trim(p).try_cast("double")))
    at = [F.try_element_at(numbers, F.lit(i)) for i in (1, 2, 3)]
    value = F.when(F.size(part) == 3, at[0] * 3600 + at[1] * 60 + at[2]).when(F.size(part) == 2, at[0] * 60 + at[1]).when(F.size(part) == 1, at[0])
    return F.coalesce(value, F.lit(0.0))


def full_timestamp(x: Column) -> Column:
    """m:ss and h:mm:ss, with or without a fraction, as h:mm:ss.ff; other text stays as it is, trimmed."""
    text = F.trim(x)
    short, long = r"^(\d{1,2}):(\d{2})(\.\d+)?$", r"^(\d{1,2}):(\d{2}):(\d{2})(\.\d+)?$"

    def group(pattern: str, i: int) -> Column:
        return F.regexp_extract(text, pattern, i)

    def fraction(pattern: str, i: int) -> Column:
        return F.when(group(pattern, i) == "", ".00").otherwise(group(pattern, i))

    of_short = F.concat(F.lit("0:"), F.lpad(group(short, 1), 2, "0"), F.lit(":"), group(short, 2), fraction(short, 3))
    of_long = F.concat(group(long, 1).try_cast("int").cast("string"), F.lit(":"), group(long, 2), F.lit(":"), group(long, 3), fraction(long, 4))
    return F.when(text.rlike(short), of_short).when(text.rlike(long), of_long).otherwise(text)


def fraction(x: Column, default: float | None = None) -> Column:
    """A rate such as 30000/1001 or 25; the default for other text and for a denominator of 0."""
    part = F.split(F.trim(x), "/")
    numbers = F.transform(part, lambda p: F.when(p.rlike(_DECIMAL), p.try_cast("double")))
    under = F.when(F.size(part) == 1, F.lit(1.0)).otherwise(F.try_element_at(numbers, F.lit(2)))
    value = F.when((F.size(part) <= 2) & (under != 0), F.try_element_at(numbers, F.lit(1)) / under)
    return value if default is None else F.coalesce(value, F.lit(default))


def rational_time(seconds: Column, rate: Column) -> Column:
    """Frames at a rate, rounded, halves up."""
    return F.struct(F.floor(seconds * rate + 0.5).alias("value"), rate.alias("rate"))


def centisecond_clock(us: Column) -> Column:
    """h:mm:ss.cc of microseconds, cut to hundredths."""
    cs = F.floor(us / 10_000)
    return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360_000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100)


def instant(x: Column, zone: str) -> Column:
    """A timestamp in UTC: text that ends in Z or an offset says so itself, other text is the zone's wall clock; null if it isn't one."""
    stamped = x.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(stamped, F.try_to_timestamp(x)).otherwise(F.to_utc_timestamp(F.try_to_timestamp(x), zone))


def common_window(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """The time both spans have in common; null if there is none."""
    s, e = F.greatest(s1, s2), F.least(e1, e2)
    return F.when(e > s, F.struct(s.alias("s"), e.alias("e")))
