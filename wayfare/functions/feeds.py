"""Live feeds to columns: classification, severity, validity and merging of two sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Severity words of source a, icon groups and delay classes of source b.
SEVERITY = {"minimal": 1.1, "low": 1.15, "moderate": 1.3, "serious": 1.5, "severe": 2.0}
RECURRING = 1.08
INCIDENTS = ("Collisions", "Emergency service incidents", "Traffic Incidents", "Network delays")
CLOSED_ICON, WORKS_ICON = 8, 9
JAM_ICONS, WEATHER_ICONS = (1, 6, 7, 12, 13, 14), (2, 3, 4, 5, 10, 11)
DELAYS = {0: 1.1, 1: 1.1, 2: 1.3, 3: 1.5, 4: 2.0}


def _lookup(c: Column, table: dict, other) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(other)


def kind_a(closure: Column, diversion: Column, category: Column) -> Column:
    cat = F.trim(F.coalesce(category, F.lit("")))
    return F.when(closure, "closure").when(diversion, "diversion").when(cat == "Works", "works").when(cat.isin(*INCIDENTS), "incident").otherwise("other")


def severity_a(severity: Column, status: Column) -> Column:
    word = F.lower(F.trim(F.coalesce(F.nullif(severity, F.lit("")), F.lit("Moderate"))))
    return F.when(F.trim(F.coalesce(status, F.lit(""))) == "Recurring Works", RECURRING).otherwise(_lookup(word, SEVERITY, 1.3))


def kind_b(icon: Column) -> Column:
    return F.when(icon == CLOSED_ICON, "closure").when(icon == WORKS_ICON, "roadworks").when(icon.isin(*JAM_ICONS), "jam").when(icon.isin(*WEATHER_ICONS), "environmental").otherwise("other")


def severity_b(icon: Column, delay: Column) -> Column:
    """Delays outside the table count as its nearest class."""
    near = F.greatest(F.lit(0), F.least(F.lit(4), delay))
    return F.when(icon == CLOSED_ICON, 2.0).when(icon == WORKS_ICON, 1.2).when(icon.isin(*JAM_ICONS), _lookup(near, DELAYS, 1.3)).when(icon.isin(*WEATHER_ICONS), 1.3).otherwise(1.1)


def feed_time(text: Column) -> Column:
    """ISO time; whatever its offset says, the clock reading counts as UTC."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), r"(Z|[+-]\d\d:?\d\d)$", ""))


def in_force(now: Column, start: Column, end: Column) -> Column:
    """A missing bound doesn't bind."""
    return F.coalesce(start <= now, F.lit(True)) & F.coalesce(end >= now, F.lit(True))


def most_severe(records: DataFrame, keys: list[str], severity: str, order: str) -> DataFrame:
    """Of each key's records the one of highest severity; the first in order among equals."""
    rest = [c for c in records.columns if c not in keys]
    best = records.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(severity), -F.col(order))).alias("_x"))  # combines before the shuffle
    return best.select(*keys, "_x.*").select(*records.columns)


def merge_sources(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One record for each key of either source: flags or-ed, higher severity, first text that isn't empty.

    Both have closed, diversion, surface, weather (booleans), severity, category, description.
    """
    flags, texts = ("closed", "diversion", "surface", "weather"), ("category", "description")
    names = [*flags, "severity", *texts]
    both = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in names]).join(b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in names]), keys, "full")
    out = [(F.coalesce(f"a_{c}", F.lit(False)) | F.coalesce(f"b_{c}", F.lit(False))).alias(c) for c in flags]
    out += [F.coalesce(F.nullif(F.col(f"a_{c}"), F.lit("")), F.col(f"b_{c}"), F.lit("")).alias(c) for c in texts]
    source = F.when(F.col("a_severity").isNull(), "b").when(F.col("b_severity").isNull(), "a").otherwise("a+b")
    return both.select(*keys, *out, F.greatest("a_severity", "b_severity").alias("severity"), source.alias("source"))
