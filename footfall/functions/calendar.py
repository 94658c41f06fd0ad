"""Time slots, holidays and opening hours as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _minutes(clock: str) -> int:
    hour, minute = clock.split(":")
    return int(hour) * 60 + int(minute)


def _clock(minute: Column) -> Column:
    return F.format_string("%02d.%02d", F.floor(minute / 60).cast("int"), (minute % 60).cast("int"))


def slot_auto(time: str | Column, first: str = "00:15", last: str = "23:59", step: int = 30) -> Column:
    """yyyyMMdd_HH.mm-HH.mm of the slot of ``step`` minutes from ``first``, cut at ``last``; residuals outside."""
    low, high = _minutes(first), _minutes(last)
    now = F.hour(time) * 60 + F.minute(time)
    begin = low + F.floor((now - low) / step) * step
    end = F.least(begin + step, F.lit(high))
    label = F.when((now >= low) & (now < high), F.concat(_clock(begin), F.lit("-"), _clock(end))).otherwise("residuals")
    return F.concat(F.date_format(time, "yyyyMMdd"), F.lit("_"), label)


def slot_manual(time: str | Column) -> Column:
    h = F.hour(time)
    label = (
        F.when((h < 8) | (h >= 23), "23-08").when(h < 12, "08-12").when(h < 16, "12-16").when(h < 20, "16-20").otherwise("20-23")
    )
    return F.concat(F.date_format(time, "yyyyMMdd"), F.lit("_"), label)


def slot_mini(time: str | Column) -> Column:
    h = F.hour(time)
    return F.when((h >= 7) & (h < 12), "07-12").when((h >= 12) & (h < 17), "12-17").when((h >= 17) & (h < 22), "17-22").otherwise("night")


def slot_list(first: str, last: str, step: int) -> Column:
    """All full slots between two clock times."""
    low, high = _minutes(first), _minutes(last)
    count = (high - low) // step
    return F.transform(
        F.sequence(F.lit(0), F.lit(count - 1)),
        lambda i: F.concat(
            _clock(F.lit(low) + i * step), F.lit("-"), _clock(F.least(F.lit(low + step) + i * step, F.lit(high)))
        ),
    )


def easter_monday(year: Column) -> Column:
    """The day after Easter Sunday of a Gregorian year, by the century's epact rather than a table."""
    century = F.floor(year / 100)
    golden = year % 19
    shift = century - F.floor(century / 4) - F.floor((century * 8 + 13) / 25) + golden * 19 + 15
    epact = shift % 30
    moon = epact - F.floor(epact / 28) * (1 - F.floor(F.lit(29) / (epact + 1)) * F.floor((F.lit(21) - golden) / 11))
    weekday = (year + F.floor(year / 4) + moon + 2 - century + F.floor(century / 4)) % 7
    days = (moon - weekday + 1).cast("int")
    return F.date_add(F.make_date(year.cast("int"), F.lit(3), F.lit(28)), days)


#: Fixed holidays, month-day. Fixed values.
HOLIDAYS = ("01-01", "01-06", "04-25", "05-01", "06-02", "08-15", "11-01", "12-08", "12-25", "12-26")


def is_holiday(time: str | Column) -> Column:
    """Sundays, fixed holidays and Easter Monday."""
    day = F.to_date(time)
    return (F.weekday(day) == 6) | F.date_format(day, "MM-dd").isin(*HOLIDAYS) | (day == easter_monday(F.year(day)))


def day_class(time: str | Column) -> Column:
    return F.when(F.weekday(time) < 5, "feriali").otherwise("festivi")


def opening_hours(spec: str | Column, capacity: Column, slots: int = 24) -> Column:
    """Capacity of each slot of a day from ``HH:mm-HH:mm|...``: a range holds its start, not its end."""
    ranges = F.transform(
        F.split(spec, r"\|"),
        lambda r: F.struct(
            _minute_of(F.substring_index(r, "-", 1)).alias("a"), _minute_of(F.substring_index(r, "-", -1)).alias("b")
        ),
    )
    step = 24 * 60 // slots
    return F.transform(
        F.sequence(F.lit(0), F.lit(slots - 1)),
        lambda i: F.when(F.exists(ranges, lambda r: (i * step >= r["a"]) & (i * step < r["b"])), capacity).otherwise(F.lit(0)),
    )


def _minute_of(clock: Column) -> Column:
    return F.substring_index(clock, ":", 1).cast("int") * 60 + F.substring_index(clock, ":", -1).cast("int")


def is_active(rules: str | Column, day: Column) -> Column:
    """Rules are joined by |: all, a weekday (Mon to Sun), a date or a range a:b; with ! in front it is closed then.

    A day is active if some open rule holds and no closed one does; without an open rule, all days are open.
    """
    parts = F.filter(F.split(rules, r"\|"), lambda r: r != "")

    def holds(rule: Column) -> Column:
        body = F.regexp_replace(rule, "^!", "")
        name, text = F.date_format(day, "E"), F.date_format(day, "yyyy-MM-dd")
        ranged = body.contains(":") & (text >= F.substring_index(body, ":", 1)) & (text <= F.substring_index(body, ":", -1))
        return (body == "all") | (body == name) | (body == text) | ranged

    closed = F.exists(parts, lambda r: r.startswith("!") & holds(r))
    opening = F.filter(parts, lambda r: ~r.startswith("!"))
    return ~closed & ((F.size(opening) == 0) | F.exists(opening, holds))


def on_day(time: str | Column, day: str) -> Column:
    """The time of day on another day."""
    return F.expr(f"timestamp_ntz'{day} 00:00:00'") + F.make_dt_interval(F.lit(0), F.hour(time), F.minute(time), F.second(time))
