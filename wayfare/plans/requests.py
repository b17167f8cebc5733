"""Requests for routes: defaults and checks of weights, toggles, departure times, and what the time of day switches off."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfare.plans.cost import CAPS

#: Kinds of bicycle, the first is the default; kinds of programme.
BIKES = ("standard", "road", "ebike", "cargo")
FAST_FACTOR = 1.35
#: Seconds that each stop or metre of climb adds to a ride.
STOP_SECONDS = {"signal": 25.0, "give_way": 6.0, "stop_sign": 15.0, "junction": 10.0, "calming": 4.0, "barrier": 20.0, "climb_m": 1.0}


def weight_error(weights: Column) -> Column:
    """What is wrong with a map of weights: the first missing or outlying key in the order of CAPS, then unknown keys; null: nothing."""
    out = None
    for key, cap in CAPS.items():
        v = weights[key]
        step = ((v.isNull(), f"missing weight key: {key}"), ((v < 0) | (v > cap), f"{key} must be between 0.0 and {cap}"))
        for bad, text in step:
            out = F.when(bad, text) if out is None else out.when(bad, text)
    unknown = F.array_sort(F.array_except(F.map_keys(weights), F.array(*map(F.lit, CAPS))))
    return out.when(F.size(unknown) > 0, F.concat(F.lit("unknown weight keys: "), F.array_join(unknown, ", ")))


def weights_from(asked: Column, defaults: Column) -> Column:
    """A request's weights: what is asked for as text, else the default, else 0; each within its cap."""
    entries = []
    for key, cap in CAPS.items():
        said = F.nullif(F.trim(asked[key]), F.lit("")).try_cast("double")
        value = F.coalesce(said, defaults[key], F.lit(0.0))
        entries += [F.lit(key), F.greatest(F.lit(0.0), F.least(F.lit(cap), value))]
    return F.create_map(*entries)


def bike(kind: Column) -> Column:
    own = F.lower(F.trim(kind))
    return F.when(own.isin(*BIKES), own).otherwise(BIKES[0])


def toggles(given: Column) -> dict[str, Column]:
    """Toggles with their defaults; given is a map of names to booleans."""
    defaults = {"light_night": False, "surface": False, "jam_comfort": True, "shared_path": True, "bus_lane": True, "painted_lane": False}
    return {k: F.coalesce(given[k], F.lit(v)) for k, v in defaults.items()}


def depart_at(text: Column, now: Column) -> Column:
    """A time (UTC) from ISO text; without an offset the clock of London; now where it can't be read."""
    own = F.trim(text)
    clock = F.try_to_timestamp(F.regexp_replace(own, r"(Z|[+-]\d\d:?\d\d)$", ""))
    offset = F.regexp_extract(own, r"([+-])(\d\d):?(\d\d)$", 1)
    minutes = (F.regexp_extract(own, r"[+-](\d\d):?(\d\d)$", 1).try_cast("int") * 60 + F.regexp_extract(own, r"[+-](\d\d):?(\d\d)$", 2).try_cast("int")) * F.when(offset == "-", -1).otherwise(1)
    shifted = F.timestamp_micros(F.unix_micros(clock) - minutes.cast("bigint") * 60_000_000)
    said = F.when(own.rlike(r"[+-]\d\d:?\d\d$") & own.contains("T"), shifted).when(own.endswith("Z"), clock).otherwise(F.to_utc_timestamp(clock, "Europe/London"))
    return F.coalesce(said, now)


def is_future(at: Column, now: Column) -> Column:
    return F.unix_micros(at) - F.unix_micros(now) > 30 * 60 * 1_000_000


def gated(weights: Column, dark: Column, future: Column) -> Column:
    """No wish for lit streets by daylight, none for live traffic on a later ride."""
    return F.transform_values(weights, lambda k, v: F.when((k == "light_weight") & ~dark | (k == "tfl_live_weight") & future, 0.0).otherwise(v))


def ride_minutes_with_stops(length_m: Column, kmh: Column, stops: dict[str, Column]) -> Column:
    ride = F.when((length_m <= 0) | (kmh <= 0), 0.0).otherwise(length_m / (kmh / 3.6 * 60))
    out = F.lit(0.0)
    for k, n in stops.items():
        out = out + n * STOP_SECONDS[k]
    return ride + out / 60
