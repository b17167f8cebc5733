"""What a rider reads: weather labels, warnings, durations, distances and their differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Label of each weather code; other codes are cloudy.
WEATHER = {
    0: "Clear", 1: "Mostly clear", 2: "Partly cloudy", 3: "Overcast", 45: "Fog", 48: "Fog",
    51: "Drizzle", 53: "Drizzle", 55: "Drizzle", 56: "Drizzle", 57: "Drizzle",
    61: "Rain", 63: "Rain", 65: "Heavy rain", 66: "Heavy rain", 67: "Heavy rain",
    71: "Snow", 73: "Snow", 75: "Snow", 77: "Snow", 80: "Showers", 81: "Showers", 82: "Showers",
    85: "Snow showers", 86: "Snow showers", 95: "Thunderstorm", 96: "Thunder + hail", 99: "Thunder + hail",
}
#: Compass points, limits of wind (m/s) and temperature, and the warnings by code, the gravest first.
COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")
CALM, STRONG, COLD, HOT = 1.5, 10, 5, 28
WARNINGS = (("thunderstorm", (95, 96, 99)), ("blackIce", (56, 57, 66, 67)), ("heavySnow", (75, 86)), ("violentRain", (65, 82)), ("denseFog", (45, 48)))
MILE_M, FOOT_M = 1609.344, 0.3048


def whole(x: Column) -> Column:
    """Rounded to the nearest whole number, halves up."""
    return F.floor(x + 0.5).cast("bigint")


def one_place(x: Column) -> Column:
    """A number of zero or more with one decimal place."""
    tenths = whole(x * 10)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def weather_label(code: Column) -> Column:
    out = F.when(F.lit(False), "")
    for k, v in WEATHER.items():
        out = out.when(code == k, v)
    return out.otherwise("Cloudy")


def compass(degrees: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, COMPASS)), (whole(F.pmod(degrees, F.lit(360)) / 45) % 8 + 1).cast("int"))


def wind_band(ms: Column) -> Column:
    return F.when(ms.isNull() | (ms < CALM), "calm").when(ms > STRONG, "extreme").otherwise("moderate")


def temperature_warning(c: Column) -> Column:
    return F.when(c <= COLD, "cold").when(c >= HOT, "hot")


def uv_caption(uv: Column, is_day: Column) -> Column:
    tenths = whole(uv * 10)
    shown = F.when(tenths % 10 == 0, F.floor(tenths / 10).cast("string")).otherwise(one_place(uv))
    return F.when(~is_day | uv.isNull() | (uv <= 0), "No UV").otherwise(F.concat(F.lit("UV "), shown))


def warning(code: Column, wind_ms: Column, temp_c: Column, is_day: Column) -> Column:
    """The gravest warning of a reading, or null."""
    out = F.when(F.lit(False), "")
    for kind, codes in WARNINGS:
        out = out.when(code.isin(*codes), kind)
    return out.when(wind_ms > STRONG, "strongWind").when(is_day & (temp_c >= HOT), "heat")


def duration(minutes: Column) -> Column:
    m = F.greatest(F.lit(0).cast("bigint"), whole(minutes))
    return F.when(m < 60, F.concat(m.cast("string"), F.lit(" min"))).otherwise(F.concat(F.floor(m / 60).cast("string"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"), F.lit(" h")))


def distance(metres: Column, imperial: bool = False) -> Column:
    if imperial:
        miles = metres / MILE_M
        return F.when(miles < 0.1, F.concat(whole(metres / FOOT_M).cast("string"), F.lit(" ft"))).when(miles < 10, F.concat(one_place(miles), F.lit(" mi"))).otherwise(F.concat(whole(miles).cast("string"), F.lit(" mi")))
    km = metres / 1000
    return F.when(metres < 1000, F.concat(whole(metres).cast("string"), F.lit(" m"))).when(km < 10, F.concat(one_place(km), F.lit(" km"))).otherwise(F.concat(whole(km).cast("string"), F.lit(" km")))


def time_delta(own: Column, other: Column, versus: str = "non-optimised") -> Column:
    d = whole(own - other)
    sign = F.when(d > 0, "+").otherwise("−")
    return F.when(d == 0, f"same as {versus}").otherwise(F.concat(sign, F.abs(d).cast("string"), F.lit(f" min vs {versus}")))


def distance_delta(own: Column, other: Column, versus: str = "non-optimised") -> Column:
    d = own - other
    sign = F.when(d > 0, "+").otherwise("−")
    size = F.when(F.abs(d) < 1000, F.concat(whole(F.abs(d)).cast("string"), F.lit(" m"))).otherwise(F.concat(one_place(F.abs(d) / 1000), F.lit(" km")))
    return F.when(F.abs(d) < 25, f"same as {versus}").otherwise(F.concat(sign, size, F.lit(f" vs {versus}")))


def walk_minutes(metres: Column) -> Column:
    """Walking time at 80 m a minute over 1.2 times the distance, whole minutes (halves to even), at least one."""
    return F.greatest(F.lit(1).cast("bigint"), F.bround(metres * 1.2 / 80).cast("bigint"))
