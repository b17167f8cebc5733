"""Preset clamps: an ordered fold over coupling rules, one pass for each request row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 0.0001
#: Fixed values, in file order: (id, ((weight, condition, threshold), (weight, condition, threshold)), dominant weight for fast, safe, leisure as 0 or 1).
COUPLINGS = (
    ("signal_risk_arterial", (("signal_weight", "gte", 0.6), ("risk_weight", "lt", 0.4)), (0, 1, 1)),
    ("signal_calming_rat_run", (("signal_weight", "gte", 0.4), ("calming_weight", "gte", 0.75)), (0, 0, 1)),
    ("signal_light_night", (("signal_weight", "gte", 0.4), ("light_weight", "lt", 0.4)), (0, 1, 1)),
    ("speed_risk_twickenham", (("speed_weight", "gte", 0.6), ("risk_weight", "lt", 0.4)), (1, 1, 0)),
    ("speed_calming_rat_run", (("speed_weight", "gte", 0.6), ("calming_weight", "gte", 0.4)), (1, 0, 0)),
    ("junction_risk_arterial", (("junction_weight", "gte", 1.0), ("risk_weight", "lt", 0.4)), (0, 1, 0)),
    ("hill_green_preset", (("hill_weight", "gte", 0.6), ("green_weight", "gte", 0.2)), (0, 1, 1)),
    ("hill_risk_valley", (("hill_weight", "gte", 1.0), ("risk_weight", "lt", 0.4)), (0, 1, 0)),
    ("hill_calming_tottenham", (("hill_weight", "gte", 0.2), ("calming_weight", "gte", 0.4)), (0, 0, 0)),
    ("barrier_risk_greenwich", (("barrier_weight", "gte", 0.6), ("risk_weight", "lt", 0.4)), (0, 1, 0)),
    ("calming_risk_arterial", (("calming_weight", "gte", 0.6), ("risk_weight", "lt", 0.4)), (0, 1, 0)),
    ("green_barrier_twickenham", (("green_weight", "gte", 0.2), ("barrier_weight", "gte", 0.6)), (1, 0, 0)),
    ("surface_green_parks", (("surface_weight", "gte", 0.2), ("green_weight", "gte", 0.2)), (0, 1, 1)),
    ("surface_speed_tottenham", (("surface_weight", "gte", 0.2), ("speed_weight", "gte", 0.6)), (0, 1, 1)),
    ("surface_risk_tottenham", (("surface_weight", "gte", 0.2), ("risk_weight", "lt", 0.4)), (0, 1, 1)),
    ("tfl_cycleway_calming_bromley", (("tfl_cycleway_weight", "gte", 0.2), ("calming_weight", "gte", 0.6)), (0, 0, 0)),
    ("tfl_live_risk_kings_cross", (("tfl_live_weight", "gte", 0.2), ("risk_weight", "lt", 0.4)), (0, 1, 0)),
    ("tfl_live_surface_earls", (("tfl_live_weight", "gte", 0.2), ("surface_weight", "gte", 0.2)), (0, 0, 0)),
    ("tfl_live_calming_wembley", (("tfl_live_weight", "gte", 0.2), ("calming_weight", "gte", 0.4)), (0, 0, 0)),
    ("vehicular_free_risk_accidents", (("vehicular_free_weight", "gte", 1.5), ("risk_weight", "lt", 0.4)), (0, 0, 0)),
    ("risk_light_floor", (("light_weight", "gte", 0.4), ("risk_weight", "lt", 0.4)), (1, 1, 1)),
    ("risk_surface_floor", (("risk_weight", "gte", 0.6), ("surface_weight", "lt", 0.2)), (1, 0, 0)),
    ("signal_junction_paradox", (("signal_weight", "gte", 0.6), ("junction_weight", "gte", 1.0)), (0, 1, 1)),
)
PRESETS = ("fast", "safe", "leisure")


def rule_array() -> Column:
    rules = []
    for _, conds, dominant in COUPLINGS:
        for preset, d in zip(PRESETS, dominant):
            (wk, wc, wt), (lk, lc, lt) = conds[d], conds[1 - d]
            rules.append(F.struct(F.lit(preset).alias("preset"), F.lit(wk).alias("win"), F.lit(wc == "gte").alias("win_gte"), F.lit(wt).alias("win_t"), F.lit(lk).alias("lose"), F.lit(lc == "gte").alias("lose_gte"), F.lit(lt).alias("lose_t")))
    return F.array(*rules)


def clamped(weights: Column, preset: Column) -> Column:
    """The weights (map string to double) after the preset's couplings, each seeing what the ones before left."""

    def met(v: Column, gte: Column, threshold: Column) -> Column:
        return F.when(gte, v >= threshold).otherwise(v < threshold)

    def step(w: Column, r: Column) -> Column:
        win, lose = F.coalesce(w[r["win"]], F.lit(0.0)), F.coalesce(w[r["lose"]], F.lit(0.0))
        trip = (r["preset"] == preset) & met(win, r["win_gte"], r["win_t"]) & met(lose, r["lose_gte"], r["lose_t"])
        value = F.when(r["lose_gte"], F.greatest(F.lit(0.0), r["lose_t"] - STEP)).otherwise(r["lose_t"])
        return F.when(trip, F.transform_values(w, lambda k, v: F.when(k == r["lose"], value).otherwise(v))).otherwise(w)

    return F.aggregate(rule_array(), weights, step)


def apply_clamps(requests: DataFrame, weights: str = "weights", preset: str = "preset") -> DataFrame:
    return requests.withColumn(weights, clamped(F.col(weights), F.col(preset)))


def within_window(hits: DataFrame, key: str, second: str, window_s: int, limit: int) -> DataFrame:
    """hits with `recent` (hits of the key in the window up to this one) and `allowed`."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(second).rangeBetween(-window_s + 1, 0)
    return hits.withColumn("recent", F.count("*").over(w)).withColumn("allowed", F.col("recent") <= limit)
