"""The parameterised edge cost as column expressions.

weights names the 13 request weights. A term whose weight is zero is left out of
the expression, so a plan holds only what the request asks for.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfare.functions import tags as t

#: Weight caps, and the floor and cap of each reward.
CAPS = {"signal_weight": 2.0, "speed_weight": 2.0, "junction_weight": 3.0, "risk_weight": 2.0, "hill_weight": 3.0, "calming_weight": 1.5, "barrier_weight": 1.5, "green_weight": 1.0, "vehicular_free_weight": 3.0, "tfl_cycleway_weight": 1.0, "light_weight": 1.0, "surface_weight": 1.0, "tfl_live_weight": 1.0}
REWARDS = {"tfl_cycleway_weight": (0.55, 1.0), "green_weight": (0.6, 1.0), "vehicular_free_weight": (0.55, 3.0)}
LEAST_M, LEAST_R = 0.1, 0.1
INCIDENTS = ("Collisions", "Emergency service incidents", "Traffic Incidents", "Network delays")


def reward(key: str, weight: float) -> float:
    floor, cap = REWARDS[key]
    return 1.0 - (1.0 - floor) * min(max(weight, 0.0), cap) / cap


def clamp_weights(weights: dict[str, float]) -> dict[str, float]:
    return {k: max(0.0, min(cap, float(weights.get(k, 0.0)))) for k, cap in CAPS.items()}


def per_metre_bound(weights: dict[str, float], floors: dict[str, float] | None = None) -> float:
    """A lower bound on the optimised cost of a metre."""
    m = 1.0 + sum(weights.get(k, 0.0) * (floors or {}).get(k, 0.0) for k in ("risk_weight", "light_weight", "surface_weight", "speed_weight"))
    r = 1.0
    for k in REWARDS:
        r *= reward(k, weights.get(k, 0.0))
    return max(LEAST_M, m) * max(LEAST_R, r)


def blocked(bike_type: str = "standard", live: bool = False, park_closed: Column | None = None) -> Column:
    out = t.service_denied() | t.barrier_hard(bike_type)
    if park_closed is not None:
        out = out | t.yes("is_park") & park_closed
    if live:
        out = out | F.coalesce(F.col("live_closed"), F.lit(False))
    return out


def fastest(bike_type: str = "standard", live: bool = False) -> Column:
    return F.when(blocked(bike_type, live), t.HARD_COST).otherwise(F.col("length_mm") / 1000 * t.highway_multiplier())


def optimised(weights: dict[str, float], bike_type: str = "standard", live: bool = False, node: str = "v_", **classes: bool) -> Column:
    """Cost of an edge that also carries its end node's terms as <node>crossing_m, mini_m, signal_m, danger_m."""
    w = lambda k: float(weights.get(k, 0.0))
    length = F.col("length_mm") / 1000
    mask, rewarded = t.vf_masks(**classes)
    flags = t.vf_flags()
    free = flags.bitwiseAND(F.lit(mask)) != 0
    m = F.lit(1.0)
    if w("risk_weight"):
        m = m + F.when(free, 0.0).otherwise(F.col("risk_milli") / 1000 * w("risk_weight"))
    if w("light_weight"):
        m = m + F.when(t.is_lit(), 0.0).otherwise(0.5 * w("light_weight"))
    if w("surface_weight"):
        m = m + F.when(~t.masks_surface_and_hill() & t.rough(), 3.0 * w("surface_weight")).otherwise(0.0)
    if w("speed_weight"):
        m = m + F.when(free, 0.0).otherwise(t.speed_stress(t.max_speed_kmh()) * w("speed_weight"))
    m = F.greatest(F.lit(LEAST_M), m)
    r = F.lit(1.0)
    if w("tfl_cycleway_weight"):
        r = r * F.when(t.text("programme") != "", reward("tfl_cycleway_weight", w("tfl_cycleway_weight"))).otherwise(1.0)
    if w("green_weight"):
        r = r * F.when(t.yes("is_park") | t.yes("is_river"), reward("green_weight", w("green_weight"))).otherwise(1.0)
    if w("vehicular_free_weight"):
        r = r * F.when(flags.bitwiseAND(F.lit(rewarded)) != 0, reward("vehicular_free_weight", w("vehicular_free_weight"))).otherwise(1.0)
    r = F.greatest(F.lit(LEAST_R), r)
    add = F.lit(0.0)
    if w("junction_weight"):
        add = add + (F.col(node + "crossing_m") + F.col(node + "mini_m") + F.col(node + "danger_m")) * w("junction_weight")
    if w("signal_weight"):
        add = add + F.col(node + "signal_m") * w("signal_weight")
    if w("barrier_weight"):
        add = add + t.barrier_penalty(F.col("conf_tenths") / 10) * w("barrier_weight")
    if w("calming_weight"):
        add = add + F.when(free, 0.0).otherwise(t.calming_m("both") * w("calming_weight"))
    if w("hill_weight"):
        add = add + t.hill_m(length, F.col("grade")) * w("hill_weight")
    if live and w("tfl_live_weight"):
        m = (m + F.coalesce(F.col("live_add"), F.lit(0.0)) * w("tfl_live_weight"))
        m = m * F.when(F.col("live_env"), 1 + 0.3 * min(w("tfl_live_weight"), 1.0)).otherwise(1.0)
        m = m * F.when(F.col("live_sev") > 1, 1 + (F.col("live_sev") - 1) * min(w("tfl_live_weight"), 1.0)).otherwise(1.0)
    return F.when(blocked(bike_type, live), t.HARD_COST).otherwise(length * m * t.highway_multiplier() * r + add)


def live_overlay() -> dict[str, Column]:
    """Overlay columns of a merged disruption record."""
    add = F.when(F.col("is_diversion"), 5.0).otherwise(0.0)
    add = add + F.when(F.col("category") == "Works", 3.0).when(F.col("category").isin(*INCIDENTS), 2.0).otherwise(0.0)
    add = add + F.when(F.col("temporary_bad_surface"), 3.0).otherwise(0.0)
    return {"live_closed": F.col("has_closure") | F.col("is_closed"), "live_add": add, "live_env": F.col("environmental_hazard"), "live_sev": F.col("severity_multiplier")}
