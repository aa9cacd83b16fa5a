"""Dates: periods, deadlines, leads. Times are given, never the clock's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import text as T


def period(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def seconds(at: Column) -> Column:
    return F.unix_timestamp(at.cast("timestamp"))


def minutes_left(due: Column, now: Column, default: int = 7 * 24 * 60) -> Column:
    """Whole minutes to the deadline, none below zero; a week without a deadline."""
    return F.coalesce(F.greatest(F.lit(0), F.floor((seconds(due) - seconds(now)) / 60)), F.lit(default))


def hours_over(due: Column, now: Column) -> Column:
    return F.round(F.greatest(F.lit(0), seconds(now) - seconds(due)) / 3600.0, 1)


def deadline_lead(start: Column, due: Column) -> Column:
    """Seconds before the deadline at which open work is taken over: two hours, or a fifth of the time if that is less."""
    return F.least(F.lit(7200), (0.2 * F.greatest(F.lit(0), seconds(due) - seconds(start))).cast("long"))


# What the words of the days begin with, in English and Serbian, by Spark's names of the days.
WEEKDAYS = {"MON": ("monday", "ponedelj"), "TUE": ("tuesday", "utor"), "WED": ("wednesday", "sred"), "THU": ("thursday", "cetvrt"), "FRI": ("friday", "petak", "petk"), "SAT": ("saturday", "subot"), "SUN": ("sunday", "nedelj")}
BEFORE_DAYS = ("by", "before", "until", "on", "do", "za", "pre", "u")


def coming(day: Column, weekday: str) -> Column:
    """The first such weekday from ``day`` on, that day included."""
    return F.next_day(F.date_sub(day, 1), weekday)


def _day_of(year: Column, month: Column, day: Column) -> Column:
    """A date, or null where there is no such day."""
    return F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date")


def _without_year(day: Column, month: Column, year: Column, today: Column) -> Column:
    this, following = (_day_of((F.year(today) + n).cast("string"), month, day) for n in (0, 1))
    return F.when(year != "", _day_of(year, month, day)).when(this >= today, this).otherwise(F.when(this.isNotNull(), following))


def _phrases() -> list[tuple[str, Callable[..., Column]]]:
    """(phrase, its day from today and the phrase's groups): the first phrase that a text holds counts."""
    ahead = lambda today, n, days: F.date_add(today, n.cast("int") * days)
    rules: list[tuple[str, Callable[..., Column]]] = [
        (r"\b(\d{4})-(\d\d)-(\d\d)\b", lambda today, y, m, d: _day_of(y, m, d)),
        (r"\b(\d\d?)\.(\d\d?)\.(\d{4}|)", lambda today, d, m, y: _without_year(d, m, y, today)),
        (r"\b(?:today|danas)\b", lambda today: today),
        (r"\b(?:tomorrow|sutra)\b", lambda today: F.date_add(today, 1)),
        (r"\b(?:in|within|za) +(\d{1,3}) +(?:day|days|dan|dana)\b", lambda today, n: ahead(today, n, 1)),
        (r"\b(?:in|within|za) +(\d{1,3}) +(?:week|weeks|nedelj[aeu])\b", lambda today, n: ahead(today, n, 7)),
        (r"\b(?:next +week|(?:sledec|iduc)\w* +nedelj\w*)", lambda today: F.date_add(coming(today, "FRI"), 7)),
        (r"\b(?:end +of +(?:the +)?week|this +week|(?:kraja?|ove) +nedelj\w*)", lambda today: coming(today, "FRI")),
    ]
    for day, words in WEEKDAYS.items():
        rules.append((rf"\b(?:{'|'.join(BEFORE_DAYS)}) +(?:{'|'.join(words)})\w*", lambda today, day=day: coming(today, day)))
    return rules


def relative_date(phrase: Column, today: Column) -> Column:
    """The day that a phrase means, or null: a date, today, tomorrow, in so many days or weeks, by a weekday; weeks end on Friday."""
    said = F.regexp_replace(F.translate(T.latin(phrase), "čćšžđ", "ccszd"), r"\s+", " ")
    out = None
    for pattern, day in _phrases():
        n = day.__code__.co_argcount - 1 - len(day.__defaults__ or ())
        value = day(today, *(F.regexp_extract(said, pattern, i + 1) for i in range(n)))
        out = F.when(said.rlike(pattern), value) if out is None else out.when(said.rlike(pattern), value)
    return out
