"""Street tags to numbers: Column factories, evaluated in the JVM.

Each takes the name of a tag column, with the defaults of the network's schema.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the cost model.
CYCLIST_KMH, SIGNAL_WAIT_S = 16.0, 20
SIGNAL_M = SIGNAL_WAIT_S * CYCLIST_KMH / 3.6
CROSSING_M = SIGNAL_M * 0.5
DANGER_M = 8.0
STEPS_M, PEDESTRIAN_M = 50.0, 4.0
HARD_COST = 1e9
UP, DOWN = 0.033, -0.033
YES = ("yes", "true", "1")
LIT = ("yes", "true", "24/7", "on", "designated")
BAD_SURFACES = ("grass", "dirt", "sand", "ground", "unpaved", "sett", "gravel", "wood", "fine_gravel", "earth", "mud", "woodchips", "cobblestone", "pebblestone", "clay", "grit", "grass_paver", "stone", "unhewn_cobblestone", "stepping_stones")
POSITIVE_BICYCLE = ("yes", "designated", "permissive")
SERVICE_DENIED = ("private", "no", "customers")
BARRIER_DENIED = ("private", "no")
PEDESTRIAN_TYPES = ("footway", "pedestrian", "path")
VEHICLE_FREE_TYPES = ("cycleway", "path", "pedestrian", "footway", "bridleway")
PHYSICAL_CYCLEWAY = ("track", "separate", "share_busway", "exclusive")
PHYSICAL_SEPARATION = ("bollard", "kerb")
NO_CARS = ("footway", "cycleway", "path", "pedestrian", "steps", "bridleway", "corridor", "proposed", "construction", "cycleway:left", "cycleway:right", "cycleway:both")
#: Barrier tags of each cluster; 1 free flow, 2 permeable, 3 stop or push, 4 hostile, 5 impassable.
BARRIERS = {
    1: ("height_restrictor", "lift_gate", "width_restrictor", "automatic lifting gate", "toll_booth", "sump_buster", "gap"),
    2: ("bollard", "kerb", "block", "planter", "cattle_grid", "wedge", "checkpoint", "bump", "pinch point", "rock", "stone", "artwork", "bench", "choker", "post", "motorcycle_barrier"),
    4: ("step", "log", "horse_stile", "spikes", "rising_kerb", "debris", "tree", "rocks"),
    5: ("stile", "turnstile", "full-height_turnstile", "full_height_turnstile", "kissing_gate", "fence", "wall", "jersey_barrier", "barricade", "embankment", "hoarding", "log;kissing_gate"),
}
CARGO_BLOCKED = ("cycle_barrier", "motorcycle_barrier", "wicket_gate", *BARRIERS[4])
BARRIER_M = {2: 15.0, 3: 35.0, 4: 90.0}
#: Cycleway values of each overlay cluster; 1 segregated, 2 with buses, 3 with cars.
CYCLEWAYS = {1: ("track", "separate", "separate track", "sidepath"), 2: ("share_busway",), 3: ("lane", "shared_lane", "shared", "advisory", "opposite_lane", "permissive")}


def text(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))


def yes(c: str) -> Column:
    return text(c).isin(*YES)


def is_lit(c: str = "lit") -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit(""))).isin(*LIT)


def tokens(c: str) -> Column:
    """Tag values split at ';' without empty, 'no' and 'none'."""
    return F.filter(F.transform(F.split(text(c), ";"), lambda x: F.trim(x)), lambda t: ~t.isin("", "no", "none"))


def access_denied(access: str, bicycle: str, denied: tuple[str, ...]) -> Column:
    return ~text(bicycle).isin(*POSITIVE_BICYCLE) & text(access).isin(*denied)


def service_denied() -> Column:
    return (text("type") == "service") & access_denied("access", "bicycle", SERVICE_DENIED)


def highway_multiplier(cycle_keys: tuple[str, ...] = ("cycleway", "cycleway_left"), pedestrian: float = PEDESTRIAN_M) -> Column:
    kind = text("type")
    infra = kind == "cycleway"
    for c in cycle_keys:
        infra = infra | (F.trim(F.coalesce(c, F.lit(""))) != "")
    service = F.when(service_denied(), 1.0).when(text("service") == "alley", pedestrian).otherwise(STEPS_M)
    return F.when(kind == "steps", STEPS_M).when(kind == "service", service).when(kind.isin(*PEDESTRIAN_TYPES) & ~infra, pedestrian).otherwise(1.0)


def max_speed_kmh(c: str = "maxspeed", kind: str = "type") -> Column:
    raw = F.trim(F.coalesce(F.col(c), F.lit("")))
    digits = F.regexp_replace(F.split(raw, " ")[0], "[^0-9.]", "").try_cast("double")
    every = F.regexp_replace(raw, "[^0-9.]", "").try_cast("double")
    k = F.lower(F.coalesce(F.col(kind), F.lit("")))
    inferred = F.when(k.contains("residential") | k.contains("living_street") | k.contains("unclassified"), 30.0).when(k.contains("primary") | k.contains("trunk"), 50.0).when(k.contains("secondary"), 48.0).otherwise(30.0)
    return F.coalesce(F.when(F.lower(raw).contains("mph"), digits * 1.60934), every, inferred)


def speed_stress(kmh: Column) -> Column:
    diff = kmh - CYCLIST_KMH
    return F.when(diff < 20, 0.0).when(diff <= 30, 0.15).otherwise(0.35)


def width_m(c: str) -> Column:
    s = F.regexp_replace(text(c), ",", ".")
    number = F.regexp_replace(s, "[^0-9.]", "").try_cast("double")
    return F.when(s.contains("ft") | s.contains("foot"), number * 0.3048).otherwise(number)


def _has(cols: tuple[str, ...], values: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | F.arrays_overlap(tokens(c), F.array(*map(F.lit, values)))
    return out


def superhighway(c: str = "programme") -> Column:
    return F.array_contains(F.transform(F.split(text(c), ";"), lambda x: F.trim(x)), "superhighway")


def separated(c: str = "separation") -> Column:
    return text(c).isin(*PHYSICAL_SEPARATION)


def vehicular_free(cols: tuple[str, ...] = ("cycleway", "cycleway_left")) -> Column:
    return text("type").isin(*VEHICLE_FREE_TYPES) | _has(cols, PHYSICAL_CYCLEWAY) | separated() | superhighway()


def segregated(cols: tuple[str, ...] = ("cycleway", "cycleway_left")) -> Column:
    return ~yes("is_park") & ((text("type") == "cycleway") | _has(cols, PHYSICAL_CYCLEWAY) | separated() | superhighway())


def routing_width_m() -> Column:
    own = F.trim(F.coalesce("cycleway_width", F.lit(""))) != ""
    return F.when(own, width_m("cycleway_width")).when(vehicular_free(), F.lit(None)).otherwise(width_m("width"))


def vf_flags(cols: tuple[str, ...] = ("cycleway", "cycleway_left")) -> Column:
    """Mask bits 1 core, 2 shared path, 4 bus lane, 32 painted lane; reward bits 8 core, 16 bus lane."""
    core = (text("type") == "cycleway") | _has(cols, ("track", "separate", "exclusive")) | separated() | superhighway()
    bus = ~core & _has(cols, ("share_busway",))
    path = ~core & text("type").isin("path", "pedestrian", "footway", "bridleway")
    painted = ~core & ~bus & F.array_contains(tokens("cycleway"), "lane") & (text("cycleway_lane") == "exclusive")
    bit = lambda c, b: F.when(c, b).otherwise(0)
    reward = F.when(yes("is_park"), 0).otherwise(bit(core, 8).bitwiseOR(bit(bus, 16)))
    return bit(core, 1).bitwiseOR(bit(path, 2)).bitwiseOR(bit(bus, 4)).bitwiseOR(bit(painted, 32)).bitwiseOR(reward)


def vf_masks(shared_path: bool = True, bus_lane: bool = True, painted_lane: bool = False) -> tuple[int, int]:
    return 1 | 2 * shared_path | 4 * bus_lane | 32 * painted_lane, 8 | 16 * bus_lane


def barrier_cluster(c: str = "barrier") -> Column:
    tag = text(c)
    out = F.when(tag == "", 1)
    for cluster, tags in BARRIERS.items():
        out = out.when(tag.isin(*tags), cluster)
    return out.otherwise(3)


def barrier_hard(bike_type: str = "standard") -> Column:
    tag = text("barrier")
    blocked = barrier_cluster() == 5
    if bike_type == "cargo":
        blocked = blocked | tag.isin(*CARGO_BLOCKED)
    return access_denied("barrier_access", "barrier_bicycle", BARRIER_DENIED) | (tag != "") & blocked


def barrier_penalty(confidence: Column) -> Column:
    cluster = barrier_cluster()
    base = F.when(cluster == 2, BARRIER_M[2]).when(cluster == 3, F.when(yes("is_park"), 0.0).otherwise(BARRIER_M[3])).when(cluster == 4, BARRIER_M[4]).otherwise(0.0)
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(1.0))))
    return F.when(access_denied("barrier_access", "barrier_bicycle", BARRIER_DENIED) | (text("barrier") == ""), 0.0).otherwise(base * sure)


def calming_m(source: str = "both") -> Column:
    def cost(c: str) -> Column:
        return F.when(text(c) == "", 0.0).when(text(c).isin("cushion", "choker"), 5.0).otherwise(10.0)

    return {"way": cost("calming"), "point": cost("calming_point"), "both": F.greatest(cost("calming"), cost("calming_point"))}[source]


def masks_surface_and_hill() -> Column:
    return (text("type") == "steps") | (text("type") == "service") & ~service_denied() & (text("service") != "alley")


def rough(c: str = "surface") -> Column:
    return F.lower(F.coalesce(c, F.lit(""))).isin(*BAD_SURFACES)


def hill_m(length_m: Column, grade: Column) -> Column:
    up = grade * 20 + F.when(grade > UP, F.pow(grade * 20, F.lit(2))).otherwise(0.0)
    return F.when(masks_surface_and_hill(), 0.0).when(grade > 0, length_m * up).when(grade < DOWN, length_m * 1.5).otherwise(0.0)


def cycleway_cluster(cols: tuple[str, ...] = ("cycleway", "cycleway_left")) -> Column:
    """The most segregated overlay cluster of an edge; null for none."""
    def of(c: str) -> Column:
        out = F.when(text(c).isin(*CYCLEWAYS[1]), 1)
        return out.when(text(c).isin(*CYCLEWAYS[2]), 2).when(text(c).isin(*CYCLEWAYS[3]), 3)

    return F.array_min(F.array(F.when(text("type") == "cycleway", 1), *[of(c) for c in cols]))


def node_crossing_m() -> Column:
    return F.when(text("crossing").isin("zebra", "uncontrolled"), CROSSING_M).otherwise(0.0)


def node_mini_m() -> Column:
    return F.when(text("signals") == "yes", 0.0).when(yes("mini"), CROSSING_M).otherwise(0.0)


def node_signal_m() -> Column:
    return F.when(text("signals") == "yes", SIGNAL_M).otherwise(0.0)
