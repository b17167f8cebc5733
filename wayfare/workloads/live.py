"""Queries over live feeds, quotas and hours, derived from the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfare import fixtures as net
from wayfare.functions import feeds
from wayfare.functions.text import merged_tags, open_at, slug
from wayfare.operators.ranking import rank_within
from wayfare.plans.rules import COUPLINGS, PRESETS, apply_clamps, within_window
from wayfare.session import shared_folder

NOW = "timestamp '2024-01-16 00:00:00'"
CATEGORIES = ("Works", "Collisions", "Network delays", "Asset issues", "")
WORDS = ("Minimal", "Low", "Moderate", "Serious", "Severe", "Unknown", "")


def _pick(values, i):
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    second = F.expr("timestampdiff(SECOND, timestamp_ntz '1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    return e.withColumn("second", second).withColumn("k", F.from_json("props", "k int")["k"]).withColumn("street", F.expr("event_id * 31 % 1500"))


def feed_a(spark: SparkSession, sf: str) -> DataFrame:
    """Source a: errors and views in force at the fixed time, classified."""
    e = _events(spark, sf).filter("event_type IN ('error', 'view')")
    start, end = F.col("ts"), F.when(F.col("k") % 4 == 0, None).otherwise(F.col("ts") + F.expr("make_interval(0, 0, 0, k)"))
    e = e.filter(feeds.in_force(F.expr(NOW), start, end))
    closure, diversion = F.col("k") % 10 == 0, F.col("k") % 7 == 0
    category, status = _pick(CATEGORIES, F.col("k")), F.when(F.col("k") % 9 == 0, "Recurring Works").otherwise("Active")
    return e.select("event_id", "street", feeds.kind_a(closure, diversion, category).alias("kind"), (feeds.severity_a(_pick(WORDS, F.col("k")), status) * 100 + 0.5).cast("int").alias("severity"), closure.alias("closed"), diversion.alias("diversion"), category.alias("category"))


def feed_b(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).filter("event_type = 'click'")
    icon, delay = F.col("k") % 16, F.col("k") % 6
    return e.select("event_id", "street", feeds.kind_b(icon).alias("kind"), (feeds.severity_b(icon, delay) * 100 + 0.5).cast("int").alias("severity"))


def street_a(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.most_severe(feed_a(spark, sf), ["street"], "severity", "event_id")


def merged(spark: SparkSession, sf: str) -> DataFrame:
    no = F.lit(False)
    a = street_a(spark, sf).withColumns({"surface": no, "weather": no, "description": F.col("kind")})
    b = feeds.most_severe(feed_b(spark, sf), ["street"], "severity", "event_id")
    b = b.withColumns({"closed": F.col("kind") == "closure", "diversion": no, "surface": F.col("kind") == "roadworks", "weather": F.col("kind") == "environmental", "category": F.col("kind"), "description": F.col("kind")})
    return feeds.merge_sources(a, b, ["street"])


def rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).select("event_id", "user_id", "second")
    return within_window(e, "user_id", "second", 24 * 3600, 5)


def monthly_quota(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).filter("event_type = 'view'")
    first = e.groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "user_id").agg(F.min("event_id").alias("event_id"))
    first = rank_within(first, "month", ["event_id"], "rank")
    return first.select("month", "user_id", F.col("rank").cast("int").alias("rank"), (F.col("rank") <= 40).alias("granted"))


def nearest_hour(spark: SparkSession, sf: str) -> DataFrame:
    """Each purchase with the hourly reading nearest in time, however far; the earlier of two as near.

    Readings are of whole hours, so the last one before and the first one after are the same for all purchases of an
    hour: they come from one ordered pass over the hours of each day; days without a reading take the one at their
    edge from a small table of days.
    """
    e = _events(spark, sf)
    hourly = e.filter("event_type = 'view' AND second div 3600 % 7 = 0").groupBy(F.expr("second div 3600 * 3600").alias("slot")).agg(F.max("k").alias("reading"))
    at = e.filter("event_type = 'purchase'").select("event_id", "second", F.expr("second - pmod(second, 3600)").alias("hour"))
    r = F.struct("slot", "reading")
    both = at.select("hour").distinct().join(hourly, F.col("hour") == F.col("slot"), "full").select(F.coalesce("hour", "slot").alias("hour"), F.when(F.col("slot").isNotNull(), r).alias("r"))
    both = both.withColumn("day", F.expr("hour div 86400"))
    w = Window.partitionBy("day").orderBy("hour")
    near = both.withColumns({"before": F.last("r", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "after": F.first("r", True).over(w.rowsBetween(1, Window.unboundedFollowing))})
    # one row for each day: its first and last reading, and those of the days around it
    days = both.groupBy("day").agg(F.max("r").alias("last_r"), F.min("r").alias("first_r"))
    d = Window.orderBy("day")
    days = days.select("day", F.last("last_r", True).over(d.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"), F.first("first_r", True).over(d.rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    hours = near.join(F.broadcast(days), "day").select("hour", F.coalesce("before", "earlier").alias("before"), F.coalesce("after", "later").alias("after"))
    out = at.join(hours, "hour")
    take = F.when(F.col("after").isNull() | (F.col("second") - F.col("before.slot") <= F.col("after.slot") - F.col("second")), F.col("before")).otherwise(F.col("after"))
    return out.withColumn("x", take).select("event_id", "x.slot", "x.reading")


def clamps(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of each order's request after the preset's couplings, in ten-thousandths."""
    from wayfare.plans.cost import CAPS

    names = list(CAPS)
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    o = o.withColumn("preset", _pick(PRESETS, F.col("id")))
    o = o.withColumn("weights", F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[(F.col("id") * (7 + 2 * i) % 11) * F.lit(0.2) for i in range(len(names))])))
    out = apply_clamps(o)
    return out.select("id", "preset", *[F.floor(F.col("weights")[n] * 10000 + 0.5).cast("bigint").alias(n) for n in names])


def coupling_degree(spark: SparkSession, sf: str) -> DataFrame:
    """For each weight: its couplings, the most that it loses under one preset, and how many requests trip one that it loses."""
    rules = spark.createDataFrame([(w, p, k, wins[i] != j) for k, conds, wins in COUPLINGS for j, (w, _, _) in enumerate(conds) for i, p in enumerate(PRESETS)], "weight string, preset string, id string, loses boolean")
    by = rules.groupBy("weight", "preset").agg(F.count("*").alias("n"), F.sum(F.col("loses").cast("int")).alias("lost"))
    asked = spark.read.parquet(f"{sf}/orders.parquet").groupBy(_pick(PRESETS, F.col("o_orderkey")).alias("preset")).agg(F.count("*").alias("requests"))
    # a handful of rows on both sides
    return by.join(asked, "preset").groupBy("weight").agg(F.max("n").alias("couplings"), F.max("lost").alias("most_lost"), F.sum(F.when(F.col("lost") > 0, F.col("requests")).otherwise(0)).alias("requests"))


def open_streets(spark: SparkSession, sf: str) -> DataFrame:
    """Opening hours over the distinct strings only, then joined to the streets."""
    w = net.ways(spark, sf)
    times = F.explode(F.array(*[F.struct(F.lit(m).alias("minute"), F.lit(d).alias("dark")) for m, d in ((300, True), (720, False), (1320, True))]))
    known = w.select("opening_hours").distinct().select("opening_hours", times.alias("t")).select("opening_hours", "t.*")
    known = known.withColumn("open", open_at(F.col("opening_hours"), F.col("minute"), F.lit(2), F.col("dark")))
    return w.select("way_id", "opening_hours").join(known, "opening_hours").select("way_id", "minute", "open")


def slugs(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", slug(F.col("p_name")).alias("s"))
    r = F.col("r")
    return rank_within(p, "s", ["p_partkey"], "r").select("p_partkey", F.when(r == 1, F.col("s")).otherwise(F.concat_ws("-", "s", r)).alias("slug"))


def tag_union(spark: SparkSession, sf: str) -> DataFrame:
    return net.ways(spark, sf).select("way_id", merged_tags(F.col("programme"), F.col("cycleway"), F.col("programme")).alias("tags"))


def stream_latest(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of the events table in snapshots: each source's last record of a street wins."""
    where = f"{shared_folder(spark)}/latest-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf}/events.parquet")
    rows = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    latest = rows.groupBy("event_type", "user_id").agg(F.max(F.struct("ts", "event_id")).alias("x"))
    q = latest.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{where}/out")).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{where}/out").select("event_type", "user_id", "x.event_id")


#: Settings of the live cost query.
LIVE = {"tfl_live_weight": 0.8}


def _live_costs(spark: SparkSession, sf: str, live: bool) -> DataFrame:
    """Edges with their end node's terms, the merged record of their street, and both costs."""
    from wayfare.plans import cost
    from wayfare.workloads import network as n

    m = merged(spark, sf).select(F.col("street").alias("way_id"), F.col("closed").alias("has_closure"), F.col("closed").alias("is_closed"), F.col("diversion").alias("is_diversion"), "category", F.col("surface").alias("temporary_bad_surface"), F.col("weather").alias("environmental_hazard"), (F.col("severity") / 100).alias("severity_multiplier"))
    over = m.select("way_id", *[c.alias(k) for k, c in cost.live_overlay().items()])
    danger = n.car_roads(spark, sf).select("node_id", F.col("danger_m").cast("double").alias("v_danger_m"))
    from wayfare.functions import tags as t

    at = net.nodes(spark, sf).select("node_id", t.node_crossing_m().alias("v_crossing_m"), t.node_mini_m().alias("v_mini_m"), t.node_signal_m().alias("v_signal_m")).join(danger, "node_id").withColumnRenamed("node_id", "v")
    e = net.edges(spark, sf).join(at, "v").join(over, "way_id", "left")
    return e.select("u", "v", "way_id", n.milli(cost.fastest(live=live)).alias("fastest_mm"), n.milli(cost.optimised(n.WEIGHTS | LIVE, live=live)).alias("optimised_mm"), F.col("live_sev").isNotNull().alias("disrupted"))


def live_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Costs with the live overlay: closures block whatever the weights; the rest counts by its weight."""
    return _live_costs(spark, sf, True).drop("way_id")


def later_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Costs of a later ride: no live records, but parks that are closed by then block."""
    from wayfare.functions import tags as t
    from wayfare.plans import cost
    from wayfare.workloads import network as n

    shut = ~open_at(F.col("opening_hours"), F.lit(1320), F.lit(2), F.lit(True))
    return net.edges(spark, sf).select("u", "v", F.when(cost.blocked(park_closed=shut), 10**12).otherwise(n.milli(F.col("length_mm") / 1000 * t.highway_multiplier())).cast("bigint").alias("fastest_mm"))


OVERRIDES = (("Mill Lane", "Mo-Fr 08:00-18:00"), ("Park Road", ""))


def park_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Opening hours by override where the name is the same, else the street's own."""
    own = spark.createDataFrame(OVERRIDES, "match string, hours string")
    name = F.when(F.lower(F.trim("name")).isin("", "nan", "none"), None).otherwise(F.trim("name"))
    return net.ways(spark, sf).select("way_id", name.alias("match"), F.trim("opening_hours").alias("own")).join(F.broadcast(own), "match", "left").select("way_id", F.coalesce("hours", "own").alias("hours"))


#: Hours, minute of a Wednesday, whether it is dark, and whether the place is open then; stated by hand.
HOURS_CASES = (
    ("24/7", 180, True, True), ("Mo-Su 06:00-20:00", 359, True, False), ("Mo-Su 06:00-20:00", 360, False, True), ("Mo-Su 06:00-20:00", 1200, True, False),
    ("Mo-Fr 07:30-16:00", 450, False, True), ("Sa-Su 10:00-16:00", 720, False, False), ("We 12:00-13:00", 740, False, True), ("Th-Tu 09:00-17:00", 600, False, False),
    ("Fr-We 09:00-17:00", 600, False, True), ("22:00-02:00", 60, True, True), ("22:00-02:00", 720, False, False), ("08:00-24:00", 1439, True, True),
    ("dawn-dusk", 1320, True, False), ("dawn-dusk", 720, False, True), ("", 1320, True, False), ("sunrise-sunset", 720, False, True),
    ("Sa 10:00-12:00; We 09:00-10:00", 570, False, True), ("Sa 10:00-12:00; We 09:00-10:00", 660, False, False), ("Mar-Oct 09:00-18:00", 1320, True, False),
)


def hours_cases(spark: SparkSession, sf: str) -> DataFrame:
    """The hours grammar on cases stated by hand, for each region."""
    rows = spark.createDataFrame([(i, h, m, d) for i, (h, m, d, _) in enumerate(HOURS_CASES)], "id int, hours string, minute int, dark boolean")
    return spark.read.parquet(f"{sf}/region.parquet").select("r_regionkey").crossJoin(F.broadcast(rows)).select("r_regionkey", "id", open_at(F.col("hours"), F.col("minute"), F.lit(2), F.col("dark")).alias("open"))


def hours_grammar(spark: SparkSession, sf: str) -> DataFrame:
    """Hours put together from lists of months, days and times for each customer, read at a moment of the customer's own."""
    from wayfare.functions.text import DAYS, MONTHS

    k = F.col("k")
    name = lambda names, i: F.element_at(F.array(*map(F.lit, names)), F.expr(f"cast({i} as int)") + 1)
    time = lambda n: F.format_string("%02d:%02d", F.expr(f"cast(k * {n} % 1440 div 60 as int)"), F.expr(f"cast(k * {n} % 60 as int)"))
    months = F.when(k % 4 == 0, F.concat(name(MONTHS, "k % 12"), F.lit("-"), name(MONTHS, "k div 12 % 12"), F.lit(" "))).otherwise("")
    days = F.when(k % 3 == 0, F.concat(name(DAYS, "k % 7"), F.lit("-"), name(DAYS, "k div 7 % 7"), F.lit(","), name(DAYS, "k div 49 % 7"), F.lit(" "))).when(k % 3 == 1, F.concat(name(DAYS, "k % 7"), F.lit(",PH "))).otherwise("")
    one = F.concat(time(37), F.lit("-"), time(53))
    times = F.when(k % 7 == 0, "sunrise-sunset").when(k % 11 == 0, F.concat(F.lit("(sunrise+01:00)-"), time(53))).when(k % 5 == 0, F.concat(one, F.lit(","), time(71), F.lit("-"), time(89))).otherwise(one)
    rows = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").cast("long").alias("k")).withColumns({"hours": F.concat(months, days, times), "minute": k * 97 % 1440, "day": F.expr("k * 5 div 3 % 7"), "month": F.expr("k * 3 div 5 % 12") + 1})
    dark = (F.col("minute") < 360) | (F.col("minute") >= 1080)
    return rows.select("k", "hours", open_at(F.col("hours"), F.col("minute"), F.col("day"), dark, F.col("month"), k % 13 == 0, F.lit(360), F.lit(1080)).alias("open"))


_SPAN = "(today AND minute >= {a} AND (minute < {b} OR {b} <= {a}) OR before AND {b} <= {a} AND minute < {b})"
_CYCLE = "(CASE WHEN {a} <= {b} THEN {x} BETWEEN {a} AND {b} ELSE {x} >= {a} OR {x} <= {b} END)"


def _grammar_sql() -> str:
    """Works the hours out from the numbers they are made of; the text is made for comparison only."""
    from wayfare.functions.text import DAYS, MONTHS

    names = lambda v, i: "([" + ", ".join(f"'{x}'" for x in v) + f"])[({i}) + 1]"
    time = lambda n: f"lpad((k * {n} % 1440 // 60)::VARCHAR, 2, '0') || ':' || lpad((k * {n} % 60)::VARCHAR, 2, '0')"
    one = f"{time(37)} || '-' || {time(53)}"
    on = lambda d: f"(CASE k % 3 WHEN 0 THEN {_CYCLE.format(x=d, a='k % 7', b='k // 7 % 7')} OR {d} = k // 49 % 7 WHEN 1 THEN {d} = k % 7 ELSE true END)"
    s1, s2 = _SPAN.format(a="k * 37 % 1440", b="k * 53 % 1440"), _SPAN.format(a="k * 71 % 1440", b="k * 89 % 1440")
    return f"""WITH c AS (SELECT c_custkey AS k, c_custkey * 97 % 1440 AS minute, c_custkey * 5 // 3 % 7 AS day, c_custkey * 3 // 5 % 12 + 1 AS month FROM customer),
d AS (SELECT *, {on('day')} OR k % 3 = 1 AND k % 13 = 0 AS today, {on('((day + 6) % 7)')} AS before, k % 4 <> 0 OR {_CYCLE.format(x='month', a='(k % 12 + 1)', b='(k // 12 % 12 + 1)')} AS in_month FROM c)
SELECT k, CASE WHEN k % 4 = 0 THEN {names(MONTHS, 'k % 12')} || '-' || {names(MONTHS, 'k // 12 % 12')} || ' ' ELSE '' END
  || CASE k % 3 WHEN 0 THEN {names(DAYS, 'k % 7')} || '-' || {names(DAYS, 'k // 7 % 7')} || ',' || {names(DAYS, 'k // 49 % 7')} || ' ' WHEN 1 THEN {names(DAYS, 'k % 7')} || ',PH ' ELSE '' END
  || CASE WHEN k % 7 = 0 THEN 'sunrise-sunset' WHEN k % 11 = 0 THEN '(sunrise+01:00)-' || {time(53)} WHEN k % 5 = 0 THEN {one} || ',' || {time(71)} || '-' || {time(89)} ELSE {one} END AS hours,
  in_month AND CASE WHEN k % 7 = 0 THEN today AND minute >= 360 AND minute < 1080 WHEN k % 11 = 0 THEN {_SPAN.format(a='420', b='k * 53 % 1440')} WHEN k % 5 = 0 THEN {s1} OR {s2} ELSE {s1} END AS open FROM d"""


QUERIES = {"x32_hours_grammar": hours_grammar, "x30_live_costs": live_costs, "l06_later_costs": later_costs, "r07_park_hours": park_hours, "x32_hours_cases": hours_cases, "x41_feed_a": feed_a, "x42_feed_b": feed_b, "w11_most_severe": street_a, "l04_merged_feeds": merged, "r08_rate_limit": rate_limit, "r09_monthly_quota": monthly_quota, "j22_nearest_hour": nearest_hour, "r01_preset_clamps": clamps, "a19_coupling_degree": coupling_degree, "x32_open_streets": open_streets, "x38_slugs": slugs, "x40_tag_union": tag_union, "l03_stream_latest": stream_latest}


def _list(values, i: str) -> str:
    return "([" + ", ".join(f"'{v}'" for v in values) + f"])[{i} % {len(values)} + 1]"


_E = "WITH e AS (SELECT *, cast(json_extract(props, '$.k') AS INTEGER) AS k, event_id * 31 % 1500 AS street FROM events)"
_W = _list(WORDS, "k")
_A = f"a AS (SELECT event_id, street, CASE WHEN k % 10 = 0 THEN 'closure' WHEN k % 7 = 0 THEN 'diversion' WHEN k % 5 = 0 THEN 'works' WHEN k % 5 IN (1, 2) THEN 'incident' ELSE 'other' END AS kind, CASE WHEN k % 9 = 0 THEN 108 ELSE CASE {_W} WHEN 'Minimal' THEN 110 WHEN 'Low' THEN 115 WHEN 'Serious' THEN 150 WHEN 'Severe' THEN 200 ELSE 130 END END AS severity, k % 10 = 0 AS closed, k % 7 = 0 AS diversion, {_list(CATEGORIES, 'k')} AS category FROM e WHERE event_type IN ('error', 'view') AND ts <= {NOW} AND (k % 4 = 0 OR ts + to_days(k) >= {NOW}))"
_B = "b AS (SELECT event_id, street, CASE WHEN i = 8 THEN 'closure' WHEN i = 9 THEN 'roadworks' WHEN i IN (1, 6, 7, 12, 13, 14) THEN 'jam' WHEN i IN (2, 3, 4, 5, 10, 11) THEN 'environmental' ELSE 'other' END AS kind, CASE WHEN i = 8 THEN 200 WHEN i = 9 THEN 120 WHEN i IN (1, 6, 7, 12, 13, 14) THEN ([110, 110, 130, 150, 200, 200])[k % 6 + 1] WHEN i IN (2, 3, 4, 5, 10, 11) THEN 130 ELSE 110 END AS severity FROM (SELECT *, k % 16 AS i FROM e WHERE event_type = 'click'))"
_TOP = "SELECT * FROM {0} QUALIFY row_number() OVER (PARTITION BY street ORDER BY severity DESC, event_id) = 1"


def _clamp_sql() -> str:
    from wayfare.plans.cost import CAPS

    names = list(CAPS)
    sql = "WITH s0 AS (SELECT o_orderkey AS id, " + _list(PRESETS, "o_orderkey") + " AS preset, " + ", ".join(f"(o_orderkey * {7 + 2 * i} % 11) * 0.2::DOUBLE AS {n}" for i, n in enumerate(names)) + " FROM orders)"
    for i, (_, conds, wins) in enumerate(COUPLINGS):
        trip = " AND ".join(f"{w} {'>=' if c == 'gte' else '<'} {v}::DOUBLE" for w, c, v in conds)
        new = []
        for k, (w, c, v) in enumerate(conds):
            loses = [p for p, x in zip(PRESETS, wins) if x != k]
            if loses:
                at = f"greatest(0, {v}::DOUBLE - 0.0001::DOUBLE)" if c == "gte" else f"{v}::DOUBLE"
                new.append(f"CASE WHEN {trip} AND preset IN ({', '.join(repr(p) for p in loses)}) THEN {at} ELSE {w} END AS {w}")
        sql += f", s{i + 1} AS (SELECT * REPLACE ({', '.join(new)}) FROM s{i})"
    return sql + " SELECT id, preset, " + ", ".join(f"cast(floor({n} * 10000 + 0.5) AS BIGINT) AS {n}" for n in names) + f" FROM s{len(COUPLINGS)}"


def _degree_sql() -> str:
    rows = ", ".join(f"('{w}', '{p}', {str(wins[i] != j).lower()})" for _, conds, wins in COUPLINGS for j, (w, _, _) in enumerate(conds) for i, p in enumerate(PRESETS))
    return f"WITH r(weight, preset, loses) AS (VALUES {rows}), a AS (SELECT {_list(PRESETS, 'o_orderkey')} AS preset, count(*) AS requests FROM orders GROUP BY 1), b AS (SELECT weight, preset, count(*) AS n, sum(loses::INTEGER)::BIGINT AS lost FROM r GROUP BY 1, 2) SELECT weight, max(n) AS couplings, max(lost) AS most_lost, coalesce(sum(requests) FILTER (WHERE lost > 0), 0)::BIGINT AS requests FROM b JOIN a USING (preset) GROUP BY 1"


def _live_sql() -> str:
    from wayfare.workloads import network as n

    w = LIVE["tfl_live_weight"]
    base = n._optimised_sql()
    cut = base.index(", costs AS (")
    m = base[base.index("greatest(0.1::DOUBLE, (1::DOUBLE") : base.index(f") * {n._MULT}")] + ")"
    live = f"(({m} + coalesce(live_add, 0) * {w}::DOUBLE) * CASE WHEN live_env THEN 1 + 0.3::DOUBLE * {w}::DOUBLE ELSE 1 END * CASE WHEN live_sev > 1 THEN 1 + (live_sev - 1) * {w}::DOUBLE ELSE 1 END)"
    rest = base[cut:].replace(m, live)
    hard = f"{n._DENIED} OR {n._HARD} THEN"
    rest = rest.replace(hard, f"{n._DENIED} OR {n._HARD} OR coalesce(live_closed, false) THEN").replace("SELECT edges.*", "SELECT edges.*, live_sev").replace("FROM edges JOIN ends ON ends.node_id = edges.v", "FROM edges JOIN ends ON ends.node_id = edges.v LEFT JOIN live ON live.street = edges.way_id")
    cats = "'Collisions', 'Emergency service incidents', 'Traffic Incidents', 'Network delays'"
    feed = ORACLE_SQL["l04_merged_feeds"].replace("WITH e AS", ", e AS", 1)
    at = feed.index(" SELECT coalesce(p.street")
    live_cte = f", mg AS ({feed[at:]}), live AS (SELECT street, closed AS live_closed, CASE WHEN diversion THEN 5 ELSE 0 END + CASE WHEN category = 'Works' THEN 3 WHEN category IN ({cats}) THEN 2 ELSE 0 END + CASE WHEN surface THEN 3 ELSE 0 END AS live_add, weather AS live_env, severity / 100::DOUBLE AS live_sev FROM mg)"
    return net.SQL + base[:cut] + feed[:at] + live_cte + rest + " SELECT u, v, fastest_mm, optimised_mm, live_sev IS NOT NULL AS disrupted FROM costs"


def _later_sql() -> str:
    from wayfare.workloads import network as n

    return net.SQL + f"SELECT u, v, CASE WHEN {n._DENIED} OR {n._HARD} OR is_park = 'yes' AND opening_hours <> '24/7' THEN 1000000000000 ELSE cast(floor(length_mm / 1000::DOUBLE * {n._MULT} * 1000 + 0.5) AS BIGINT) END AS fastest_mm FROM edges"


ORACLE_SQL = {
    "x41_feed_a": f"{_E}, {_A} SELECT * FROM a",
    "x42_feed_b": f"{_E}, {_B} SELECT * FROM b",
    "w11_most_severe": f"{_E}, {_A} {_TOP.format('a')}",
    "l04_merged_feeds": f"{_E}, {_A}, {_B}, p AS ({_TOP.format('a')}), q AS ({_TOP.format('b')}) SELECT coalesce(p.street, q.street) AS street, coalesce(p.closed, false) OR coalesce(q.kind = 'closure', false) AS closed, coalesce(p.diversion, false) AS diversion, coalesce(q.kind = 'roadworks', false) AS surface, coalesce(q.kind = 'environmental', false) AS weather, coalesce(nullif(p.category, ''), q.kind, '') AS category, coalesce(p.kind, q.kind) AS description, greatest(p.severity, q.severity) AS severity, CASE WHEN p.street IS NULL THEN 'b' WHEN q.street IS NULL THEN 'a' ELSE 'a+b' END AS source FROM p FULL JOIN q ON p.street = q.street",
    "r08_rate_limit": "WITH e AS (SELECT event_id, user_id, cast(floor(epoch(ts)) AS BIGINT) AS second FROM events) SELECT *, count(*) OVER w AS recent, count(*) OVER w <= 5 AS allowed FROM e WINDOW w AS (PARTITION BY user_id ORDER BY second RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW)",
    "r09_monthly_quota": "WITH f AS (SELECT strftime(ts, '%Y-%m') AS month, user_id, min(event_id) AS e FROM events WHERE event_type = 'view' GROUP BY 1, 2) SELECT month, user_id, cast(row_number() OVER (PARTITION BY month ORDER BY e) AS INTEGER) AS rank, row_number() OVER (PARTITION BY month ORDER BY e) <= 40 AS granted FROM f",
    "j22_nearest_hour": f"{_E}, h AS (SELECT cast(floor(epoch(ts)) AS BIGINT) // 3600 * 3600 AS slot, max(k) AS reading FROM e WHERE event_type = 'view' AND cast(floor(epoch(ts)) AS BIGINT) // 3600 % 7 = 0 GROUP BY 1) SELECT event_id, slot, reading FROM (SELECT event_id, cast(floor(epoch(ts)) AS BIGINT) AS second FROM e WHERE event_type = 'purchase'), h QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(second - slot), slot) = 1",
    "a19_coupling_degree": _degree_sql(),
    "l06_later_costs": _later_sql(),
    "r07_park_hours": net.SQL + "SELECT way_id, CASE name WHEN 'Mill Lane' THEN 'Mo-Fr 08:00-18:00' WHEN 'Park Road' THEN '' ELSE trim(opening_hours) END AS hours FROM ways",
    "x32_hours_grammar": _grammar_sql(),
    "x32_hours_cases": "SELECT r_regionkey, id, open FROM region, (VALUES " + ", ".join(f"({i}, {str(c[3]).lower()})" for i, c in enumerate(HOURS_CASES)) + ") AS v(id, open)",
    "r01_preset_clamps": _clamp_sql(),
    "x32_open_streets": net.SQL + "SELECT way_id, minute, CASE WHEN opening_hours = '24/7' THEN true WHEN opening_hours LIKE 'Mo%' THEN minute = 720 ELSE minute = 720 END AS open FROM ways, unnest([300, 720, 1320]) AS q(minute)",
    "x38_slugs": "SELECT p_partkey, CASE WHEN r = 1 THEN s ELSE s || '-' || r END AS slug FROM (SELECT p_partkey, s, row_number() OVER (PARTITION BY s ORDER BY p_partkey) AS r FROM (SELECT p_partkey, replace(p_name, ' ', '-') AS s FROM part))",
    "l03_stream_latest": "SELECT event_type, user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2",
    "x40_tag_union": net.SQL + "SELECT way_id, array_to_string(list_filter(list_distinct_in_order, lambda x: x <> ''), ';') AS tags FROM (SELECT way_id, list_concat(list_filter(string_split(programme, ';'), lambda x: x <> ''), list_filter(string_split(cycleway, ';'), lambda x: x <> '' AND NOT list_contains(string_split(programme, ';'), x))) AS list_distinct_in_order FROM ways)",
}
ORACLE_SQL["x30_live_costs"] = _live_sql()
