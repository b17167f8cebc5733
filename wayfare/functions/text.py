"""Text and time helpers on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def merged_tags(*values: Column) -> Column:
    """Semicolon lists joined in order, each value once."""
    parts = F.flatten(F.array(*[F.transform(F.split(F.coalesce(v, F.lit("")), ";"), lambda x: F.trim(x)) for v in values]))
    return F.array_join(F.array_distinct(F.filter(parts, lambda x: x != "")), ";")


def vias(text: Column, most: int = 3) -> tuple[Column, Column]:
    """Points of "lat,lon;lat,lon" as an array, and an error naming the first bad one (null: fine)."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    point = lambda x: F.struct(F.get(F.split(x, ","), 0).try_cast("double").alias("lat"), F.get(F.split(x, ","), 1).try_cast("double").alias("lon"))
    points = F.transform(parts, point)
    bad = F.transform(parts, lambda x: (F.size(F.split(x, ",")) != 2) | point(x)["lat"].isNull() | point(x)["lon"].isNull() | (F.abs(point(x)["lat"]) > 90) | (F.abs(point(x)["lon"]) > 180))
    at = F.array_position(bad, True)
    return points, F.when(F.size(parts) > most, F.concat(F.lit("too many: "), F.size(parts))).when(at > 0, F.concat(F.lit("bad via "), at))


def ride_minutes(length_m: Column, kmh: Column, multiplier: float = 1.0) -> Column:
    return F.when((length_m <= 0) | (kmh <= 0), 0.0).otherwise(length_m / (kmh * max(multiplier, 0.01) / 3.6 * 60))


#: Names of the opening-hours grammar.
DAYS = ("Mo", "Tu", "We", "Th", "Fr", "Sa", "Su")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def _list_of(item: str) -> str:
    return rf"{item}(?:-{item})?(?:, ?{item}(?:-{item})?)*"


_MONTH, _DAY = f"(?:{'|'.join(MONTHS)})", f"(?:{'|'.join(DAYS)}|PH)"
_EVENT = "(?:sunrise|sunset|dawn|dusk)"
_TIME = rf"(?:\d\d:\d\d|{_EVENT}|\({_EVENT}[+-]\d\d:\d\d\))"
#: A part: months, days, times or off, of which some may be missing.
_PART = rf"^(?:({_list_of(_MONTH)}):? ?)?(?:({_list_of(_DAY)}) ?)?({_TIME}-{_TIME}(?:, ?{_TIME}-{_TIME})*|off|closed)?$"


def _any(listed: Column, test) -> Column:
    """Whether a span of a list (a-b or a) passes; test gets both ends."""
    ends = lambda x: F.split(x, r"-(?![^(]*\))")  # noqa: E731; not within brackets
    return F.exists(F.split(listed, ", ?"), lambda x: F.coalesce(test(F.get(ends(x), 0), F.coalesce(F.get(ends(x), 1), F.get(ends(x), 0))), F.lit(False)))


def _between(x: Column, first: Column, last: Column) -> Column:
    """Within a span of a cycle."""
    return F.when(first <= last, x.between(first, last)).otherwise((x >= first) | (x <= last))


def open_at(expression: Column, minute: Column, weekday: Column, dark: Column, month: Column | None = None, holiday: Column | None = None, sunrise: Column | None = None, sunset: Column | None = None) -> Column:
    """Opening hours at a local minute of a weekday (0: Monday) and month (1 to 12).

    A part has months, days (PH: public holidays) and times, each a list of spans, some of which may be missing; 24/7; off.
    A span of times that ends at or before its start, or after 24:00, reaches into the next day. Parts between ';' are
    or-ed. Without hours, or with a part of another form or one that needs what isn't given (month, sunrise, sunset), a
    place is open in daylight.
    """
    names = F.array(*map(F.lit, DAYS))
    month = F.lit(None).cast("int") if month is None else month
    rise, fall = (F.lit(None).cast("int") if x is None else x for x in (sunrise, sunset))
    is_holiday = F.lit(False) if holiday is None else holiday

    def clock(t: Column) -> Column:
        digits = lambda i: F.regexp_extract(t, r"(\d\d):(\d\d)", i).try_cast("int")
        span = digits(1) * 60 + digits(2)
        event = F.when(t.rlike("sunrise|dawn"), rise).when(t.rlike("sunset|dusk"), fall)
        return F.when(~t.rlike("[a-z]"), span).when(t.contains("+"), event + span).when(t.startswith("("), event - span).otherwise(event)

    def on(days: Column, day: Column, feast: Column) -> Column:
        at = lambda n: F.array_position(names, n) - 1
        return (days == "") | _any(days, lambda a, b: F.when(a == "PH", feast).otherwise(_between(day, at(a), at(b))))

    def one(p: Column) -> Column:
        months, days, times = (F.regexp_extract(p, _PART, i) for i in (1, 2, 3))
        place = lambda n: F.array_position(F.array(*map(F.lit, MONTHS)), n)
        in_month = (months == "") | _any(months, lambda a, b: _between(month, place(a), place(b)))
        today, yesterday = on(days, weekday, is_holiday), on(days, (weekday + 6) % 7, F.lit(False))

        def span(a: Column, b: Column) -> Column:
            start, end = clock(a), clock(b)
            over = F.when(end > 1440, end - 1440).when(end <= start, end).otherwise(0)
            return (today & (minute >= start) & ((minute < end) | (over > 0) | (end <= start))) | (yesterday & (minute < over))

        known = ((months == "") | month.isNotNull()) & (~times.rlike("[a-z]") | times.isin("off", "closed") | (rise.isNotNull() & fall.isNotNull()))
        said = F.when(times.isin("off", "closed"), False).when(times == "", in_month & today).otherwise(in_month & _any(times, span))
        return F.when(p == "24/7", True).when(p == "dawn-dusk", ~dark).when(p.rlike(_PART) & known, said)

    parts = F.filter(F.transform(F.split(F.coalesce(expression, F.lit("")), ";"), lambda x: F.trim(x)), lambda p: p != "")
    said = F.transform(parts, one)
    fallback = ~dark
    return F.when(F.size(parts) == 0, fallback).otherwise(F.aggregate(said, F.lit(None).cast("boolean"), lambda s, x: F.when(s.isNotNull(), s).when(x.isNull(), fallback).when(x, True), lambda s: F.coalesce(s, F.lit(False))))
