"""Date expressions. The reference moment is always an argument, so a re-run gives the same result."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .variants import let
from .vocab import EPOCH_MILLIS_FROM, RELATIVE_POSTED

_ISO = (r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?(?:[+-]\d{2}:?\d{2}(?::\d{2})?)?)?$")
_USUAL = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-]\d{2}:\d{2})?)?$"
_LAST_SECOND = 253402300799


def from_epoch(number: Column) -> Column:
    """Seconds, or milliseconds when the number is that large; NULL beyond the year 9999 or before the year 1."""
    seconds = F.when(number > EPOCH_MILLIS_FROM, number / 1000).otherwise(number.cast("double"))
    inside = (seconds <= _LAST_SECOND) & (seconds >= -62135596800)
    return F.when(inside, F.timestamp_micros(F.round(seconds * 1000000).cast("bigint")))


def relative_date(text: Column, as_of: Column) -> Column:
    """'Posted Today', 'Posted Yesterday', 'Posted 30+ Days Ago' -> midnight of that day, counted from `as_of`."""
    word = F.lower(F.regexp_extract(text, RELATIVE_POSTED, 1))
    days = (F.when(word == "today", F.lit(0)).when(word == "yesterday", F.lit(1))
            .when(word != "", F.regexp_extract(text, RELATIVE_POSTED, 2).try_cast("int")))
    return F.date_sub(as_of.cast("date"), days).cast("timestamp")


def _by_day(text: Column) -> Column:
    """20240102T0304 written as 2024-01-02T03:04."""
    text = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})(?=$|[T ])", "$1-$2-$3")
    text = F.regexp_replace(text, r"([T ]\d{2})(\d{2})(\d{2})(?=$|[.,Z+-])", "$1:$2:$3")
    return F.regexp_replace(text, r"([T ]\d{2})(\d{2})(?=$|[Z+-])", "$1:$2")


def _by_week(text: Column) -> Column:
    """2024-W05-1 written as 2024-01-29; NULL when that year has no such week."""
    pattern = r"^(\d{4})-?W(\d{2})(?:-?([1-7]))?(?=$|[T ])"
    year, week = F.regexp_extract(text, pattern, 1).try_cast("int"), F.regexp_extract(text, pattern, 2).try_cast("int")
    day = F.coalesce(F.regexp_extract(text, pattern, 3).try_cast("int"), F.lit(1))
    monday = F.date_add(F.trunc(F.make_date(year, F.lit(1), F.lit(4)), "week"), (week - 1) * 7)
    date = F.when(F.weekofyear(monday) == week, F.date_format(F.date_add(monday, day - 1), "yyyy-MM-dd"))
    return F.concat(date, F.regexp_replace(text, pattern, ""))


def _unusual(text: Column) -> Column:
    """The moment of an ISO text in a form that a cast does not take as it is."""
    day = let(text, _by_day)
    full = F.when(text.rlike(r"^\d{4}-?W\d{2}(?:-?[1-7])?(?:$|[T ])"), let(day, _by_week)).otherwise(day)

    def read(full: Column) -> Column:
        iso = F.regexp_replace(full, r"([.,]\d{6})\d+", "$1")
        iso = F.regexp_replace(iso, r"([+-]\d{2})(\d{2})$", "$1:$2")
        iso = F.regexp_replace(iso, r"([T ]\d{2})(?=$|[+-]\d{2}:\d{2}$)", "$1:00")
        iso = F.regexp_replace(iso, r"([T ]\d{2}:\d{2})(?=[+-]\d{2}:\d{2}$)", "$1:00")
        return F.when(full.rlike(_ISO), F.replace(iso, F.lit(","), F.lit(".")).try_cast("timestamp"))

    return let(F.replace(full, F.lit("Z"), F.lit("+00:00")), read)


def from_text(text: Column, as_of: Column | None = None) -> Column:
    """ISO date or date-time (no zone means UTC), or relative text when `as_of` is given; anything else is NULL.

    Basic and week forms are read too; fractions are cut to microseconds. Text in the usual form is only cast.
    """
    trimmed = F.trim(text)
    other = F.when(trimmed.rlike(r"^\d{4}"), _unusual(trimmed))
    if as_of is not None:
        other = F.coalesce(relative_date(trimmed, as_of), other)
    return F.when(trimmed.rlike(_USUAL), trimmed.try_cast("timestamp")).otherwise(other)


def within_days(posted: Column, days: int, as_of: Column) -> Column:
    """Posted at most `days` before `as_of` (cut to the second); unknown dates never match."""
    if not 1 <= days <= 3650:
        raise ValueError("days must be between 1 and 3650")
    since = F.date_trunc("second", as_of) - F.expr(f"INTERVAL {days} DAYS")
    return F.coalesce(posted >= since, F.lit(False))


def age_bucket(moment: Column, now: Column) -> Column:
    """'just now', '5m ago', '3h ago', '2d ago', '1w ago', '2mo ago', '4y ago'."""
    minutes = F.floor(F.timestamp_diff("SECOND", moment, now) / 60)
    hours, days = F.floor(minutes / 60), F.floor(F.floor(minutes / 60) / 24)

    def ago(count: Column, unit: str) -> Column:
        return F.concat(count.cast("string"), F.lit(f"{unit} ago"))

    return (F.when(moment.isNull(), F.lit("—")).when(minutes < 1, F.lit("just now"))
            .when(minutes < 60, ago(minutes, "m")).when(hours < 24, ago(hours, "h"))
            .when(days < 7, ago(days, "d")).when(days < 30, ago(F.floor(days / 7), "w"))
            .when(days < 365, ago(F.floor(days / 30), "mo")).otherwise(ago(F.floor(days / 365), "y")))
