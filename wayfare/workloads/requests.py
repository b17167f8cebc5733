"""Queries over requests and what a rider reads, derived from orders, events and parts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions import display as d
from wayfare.functions import geo
from wayfare.functions.feeds import feed_time
from wayfare.functions.text import ride_minutes, vias
from wayfare.streaming.limits import budget_stream, lockout_stream
from wayfare.plans import cost, requests as rq

NOW = "timestamp '2024-03-31 00:45:00'"
NAMES = list(cost.CAPS)


def _pick(values, index: str):
    return F.element_at(F.array(*map(F.lit, values)), F.expr(f"cast(({index}) % {len(values)} + 1 as int)"))


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "event_type", "ts")


CODES = (0, 1, 2, 3, 45, 48, 51, 56, 61, 65, 66, 71, 75, 80, 82, 85, 86, 95, 96, 99, 7)


def weather(spark: SparkSession, sf: str) -> DataFrame:
    """Readings (by event) as a rider sees them."""
    e = _events(spark, sf).select("event_id", _pick(CODES, "event_id").alias("code"), F.expr("event_id * 7 % 130 / 10e0").alias("wind"), F.expr("event_id * 11 % 45 - 8").alias("temp"), F.expr("event_id % 95 / 10e0").alias("uv"), F.expr("event_id * 13 % 720 - 180").alias("deg"), F.expr("event_id % 3 <> 0").alias("day"))
    c = F.col
    return e.select("event_id", d.weather_label(c("code")).alias("label"), d.wind_band(c("wind")).alias("wind_band"), d.temperature_warning(c("temp")).alias("warn"), d.compass(c("deg")).alias("compass"), d.uv_caption(c("uv"), c("day")).alias("uv_caption"), d.warning(c("code"), c("wind"), c("temp"), c("day")).alias("warning"))


def formats(spark: SparkSession, sf: str) -> DataFrame:
    o = _orders(spark, sf).withColumns({"minutes": F.expr("id * 37 % 4000 / 10e0"), "metres": F.expr("id * 911 % 200000 / 10e0 + if(id % 3 = 0, 30000e0, 0e0)"), "other": F.expr("id * 917 % 200000 / 10e0")})
    c = F.col
    return o.select("id", d.duration(c("minutes")).alias("duration"), d.distance(c("metres")).alias("metric"), d.distance(c("metres"), True).alias("imperial"), d.time_delta(c("minutes"), F.expr("id * 41 % 4000 / 10e0")).alias("time_delta"), d.distance_delta(c("metres"), c("other")).alias("distance_delta"), d.walk_minutes(F.expr("id * 7 % 3000")).alias("walk_min"))


def _times():
    """Text of a departure time in six forms."""
    day = F.concat(F.lit("2024-03-"), F.lpad(F.expr("cast(id % 2 + 30 as string)"), 2, "0"))
    hour = F.lpad(F.expr("cast(id % 23 as string)"), 2, "0")
    clock = F.concat(day, F.lit("T"), hour, F.lit(":30:00"))
    return F.element_at(F.array(F.concat(clock, F.lit("Z")), clock, F.concat(clock, F.lit("+02:00")), F.concat(clock, F.lit("-0130")), F.lit(""), F.lit("soon")), F.expr("cast(id % 6 + 1 as int)"))


def departures(spark: SparkSession, sf: str) -> DataFrame:
    o = _orders(spark, sf).withColumn("raw", _times())
    at = rq.depart_at(F.col("raw"), F.expr(NOW))
    return o.select("id", F.unix_seconds(at).alias("second"), rq.is_future(at, F.expr(NOW)).alias("future"), F.unix_seconds(feed_time(F.col("raw"))).alias("feed_second"))


def sun(spark: SparkSession, sf: str) -> DataFrame:
    up = geo.solar_elevation_deg(F.col("ts").cast("timestamp"))
    return _events(spark, sf).select("event_id", F.floor(up * 100 + 0.5).cast("bigint").alias("centidegrees"), (up < -3).alias("dark"))


def ride_times(spark: SparkSession, sf: str) -> DataFrame:
    o = _orders(spark, sf).withColumns({"m": F.expr("id * 911 % 40000 - 50"), "kmh": F.expr("15e0 + id % 4 * 5")})
    stops = {k: F.expr(f"id * {i + 3} % 7") for i, k in enumerate(rq.STOP_SECONDS)}
    milli = lambda x: F.floor(x * 1000 + 0.5).cast("bigint")
    return o.select("id", milli(ride_minutes(F.col("m"), F.col("kmh"))).alias("plain"), milli(ride_minutes(F.col("m"), F.col("kmh"), rq.FAST_FACTOR)).alias("fast"), milli(rq.ride_minutes_with_stops(F.col("m"), F.col("kmh"), stops)).alias("stops"))


VIAS = ("", "51.5,-0.1", "51.5,-0.1; 51.6,-0.2", "51.5,-0.1;x,1", "91,0", "51.5", "1,2;3,4;5,6", "1,2;3,4;5,6;7,8", " 51.25 , 0.5 ;")


def parsed_vias(spark: SparkSession, sf: str) -> DataFrame:
    points, error = vias(_pick(VIAS, "id"))
    return _orders(spark, sf).select("id", F.size(points).alias("n"), F.floor(F.get(points, 0)["lat"] * 1000000 + 0.5).cast("bigint").alias("first_lat_u"), error.alias("error"))


NODES = ("(-0.123456, 51.5)", "[0.5,51.25]", "n17", "( -0.1234567 ,51.0 )")


def node_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Node names "(lon, lat)" as whole microdegrees; other names stay text."""
    form = r"^[\(\[]\s*(-?[0-9.]+)\s*,\s*(-?[0-9.]+)\s*[\)\]]$"
    raw = F.col("raw")
    micro = lambda i: F.when(raw.rlike(form), F.bround(F.regexp_extract(raw, form, i).try_cast("decimal(20,10)") * 1000000, 0).cast("bigint"))
    return _orders(spark, sf).withColumn("raw", _pick(NODES, "id")).select("id", micro(1).alias("lon_u"), micro(2).alias("lat_u"), F.when(~raw.rlike(form), raw).alias("name"))


def _weights():
    """Weights of a request; some lack a key or have one too many."""
    key = F.array(*[F.lit(n) for n in NAMES])
    value = F.array(*[F.expr(f"id * {7 + 2 * i} % 11 * 0.1e0") for i in range(len(NAMES))])
    all_of = F.map_filter(F.map_from_arrays(key, value), lambda k, v: F.array_position(key, k) - 1 != F.expr("id % 40"))
    return F.when(F.expr("id % 19 = 0"), F.map_concat(all_of, F.create_map(F.lit("zoom"), F.lit(1.0), F.lit("glide"), F.lit(2.0)))).otherwise(all_of)


def weight_errors(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).withColumn("w", _weights()).select("id", rq.weight_error(F.col("w")).alias("error"))


def default_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Weights from text, with a default where none is given, each within its cap."""
    text = F.create_map(*[x for i, n in enumerate(NAMES) for x in (F.lit(n), F.expr(f"if(id % {i + 2} = 0, '', cast(id * {3 + i} % 50 / 10e0 - 1 AS string))"))])
    out = rq.weights_from(text, F.create_map(F.lit("risk_weight"), F.lit(0.5), F.lit("hill_weight"), F.lit(9.0)))
    return _orders(spark, sf).withColumn("w", out).select("id", *[F.floor(F.col("w")[n] * 1000 + 0.5).cast("bigint").alias(n) for n in NAMES])


def normalised(spark: SparkSession, sf: str) -> DataFrame:
    o = _orders(spark, sf)
    given = F.map_filter(F.create_map(*[x for i, n in enumerate(("light_night", "jam_comfort", "bus_lane", "painted_lane")) for x in (F.lit(n), F.expr(f"id % {i + 3} = 0"))]), lambda k, v: F.length(k) % 2 == F.expr("id % 2"))
    return o.select("id", rq.bike(_pick(("Cargo ", "road", None, "tandem", " EBIKE"), "id")).alias("bike"), *[c.alias(k) for k, c in rq.toggles(given).items()])


def gated(spark: SparkSession, sf: str) -> DataFrame:
    w = F.create_map(F.lit("light_weight"), F.expr("id % 11 / 10e0"), F.lit("tfl_live_weight"), F.expr("id % 7 / 10e0"), F.lit("risk_weight"), F.lit(1.0))
    out = rq.gated(w, F.expr("id % 2 = 0"), F.expr("id % 3 = 0"))
    return _orders(spark, sf).withColumn("w", out).select("id", *[F.floor(F.col("w")[k] * 1000 + 0.5).cast("bigint").alias(k) for k in ("light_weight", "tfl_live_weight", "risk_weight")])


def cost_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """The least cost of a metre under the weights of each of 200 requests, as the search's heuristic uses it."""
    rows = []
    for k in range(200):
        w = {n: (k * (5 + i)) % 13 * 0.1 for i, n in enumerate(NAMES)}
        rows.append((k, int(math.floor(cost.per_metre_bound(w, {"risk_weight": 0.25, "speed_weight": 0.15}) * 1_000_000 + 0.5))))
    return spark.createDataFrame(rows, "id int, bound long")


def visible_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles that user 7 may see, their own and the system's, in order of name."""
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("id"), "c_name", F.expr("c_custkey % 10").alias("user_id"), F.expr("c_custkey % 97 = 0").alias("is_system"))
    return c.filter("is_system OR user_id = 7").select("id", "is_system", F.substring("c_name", 1, 22).alias("name"))


def request_budget(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of hits: a user has 5 in any 12 hours; a refused hit doesn't count."""
    return budget_stream(spark, sf, key="user_id", window_s=12 * 3600, limit=5)


def lockout(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of attempts (click) and failures (error): five failures in 10 days lock a user out for two days."""
    return lockout_stream(spark, sf, window_s=10 * 86400, failures=5, lock_s=2 * 86400)


QUERIES = {
    "x43_weather": weather, "x44_formats": formats, "x33_departures": departures, "x31_sun": sun, "x35_ride_times": ride_times, "x37_vias": parsed_vias,
    "x39_node_ids": node_ids, "r02_weight_errors": weight_errors, "r03_default_weights": default_weights, "r04_normalised": normalised, "r05_gated_weights": gated,
    "x27_cost_bounds": cost_bounds, "f18_visible_profiles": visible_profiles, "l08_request_budget": request_budget, "l08_lockout": lockout,
}


def _list(values, i: str) -> str:
    return "([" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values) + f"])[({i}) % {len(values)} + 1]"


def _whole(x: str) -> str:
    return f"cast(floor(({x}) + 0.5) AS BIGINT)"


def _one(x: str) -> str:
    return f"({_whole(f'({x}) * 10')} // 10 || '.' || {_whole(f'({x}) * 10')} % 10)"


def _cap_case(i: int, n: str) -> str:
    said = f"CASE WHEN id % {i + 2} = 0 THEN NULL ELSE (id * {3 + i} % 50 / 10::DOUBLE - 1) END"
    default = {"risk_weight": 0.5, "hill_weight": 9.0}.get(n, 0.0)
    return f"{_whole(f'greatest(0, least({cost.CAPS[n]}::DOUBLE, coalesce({said}, {default}::DOUBLE))) * 1000')} AS {n}"


_O = "WITH o AS (SELECT o_orderkey AS id FROM orders)"
_V = lambda i: f"(id * {7 + 2 * i} % 11 * 0.1::DOUBLE)"
_CLOCK = "('2024-03-' || (id % 2 + 30) || 'T' || lpad(cast(id % 23 AS VARCHAR), 2, '0') || ':30:00')"
_STAMP = f"strptime({_CLOCK}, '%Y-%m-%dT%H:%M:%S')"
_UP = (
    "WITH d AS (SELECT event_id, ((epoch_us(ts) / 1e6::DOUBLE) - 946728000.0::DOUBLE) / 86400.0::DOUBLE AS d FROM events), "
    "a AS (SELECT *, radians(m1 - floor(m1 / 360) * 360) AS g, m2 - floor(m2 / 360) * 360 AS q FROM (SELECT *, 357.529::DOUBLE + d * 0.98560028::DOUBLE AS m1, 280.459::DOUBLE + d * 0.98564736::DOUBLE AS m2 FROM d)), "
    "b AS (SELECT *, radians(q + 1.915::DOUBLE * sin(g) + 0.020::DOUBLE * sin(g * 2)) AS lam, radians(23.439::DOUBLE - d * 0.00000036::DOUBLE) AS e FROM a), "
    "c AS (SELECT *, atan2(cos(e) * sin(lam), cos(lam)) AS ra, asin(sin(e) * sin(lam)) AS dec, 18.697374558::DOUBLE + d * 24.06570982441908::DOUBLE AS s FROM b), "
    "h AS (SELECT *, (s - floor(s / 24) * 24) * 15 - 0.1278::DOUBLE AS w FROM c), "
    "u AS (SELECT event_id, degrees(asin(sin(radians(51.5074::DOUBLE)) * sin(dec) + cos(radians(51.5074::DOUBLE)) * cos(dec) * cos(radians(w - floor(w / 360) * 360) - ra))) AS up FROM h)"
)
_WMO = "CASE code WHEN 0 THEN 'Clear' WHEN 1 THEN 'Mostly clear' WHEN 2 THEN 'Partly cloudy' WHEN 3 THEN 'Overcast' WHEN 45 THEN 'Fog' WHEN 48 THEN 'Fog' WHEN 51 THEN 'Drizzle' WHEN 56 THEN 'Drizzle' WHEN 61 THEN 'Rain' WHEN 65 THEN 'Heavy rain' WHEN 66 THEN 'Heavy rain' WHEN 71 THEN 'Snow' WHEN 75 THEN 'Snow' WHEN 80 THEN 'Showers' WHEN 82 THEN 'Showers' WHEN 85 THEN 'Snow showers' WHEN 86 THEN 'Snow showers' WHEN 95 THEN 'Thunderstorm' WHEN 96 THEN 'Thunder + hail' WHEN 99 THEN 'Thunder + hail' ELSE 'Cloudy' END"
_WARN = "CASE WHEN code >= 95 THEN 'thunderstorm' WHEN code IN (56, 66) THEN 'blackIce' WHEN code IN (75, 86) THEN 'heavySnow' WHEN code IN (65, 82) THEN 'violentRain' WHEN code IN (45, 48) THEN 'denseFog' WHEN wind > 10 THEN 'strongWind' WHEN day AND temp >= 28 THEN 'heat' END"
_M, _K = "metres", "(metres / 1000)"
_MI = "(metres / 1609.344::DOUBLE)"


def _bound_sql() -> str:
    w = lambda n: f"((k * {5 + NAMES.index(n)}) % 13 * 0.1::DOUBLE)"
    lerp = lambda n, floor, cap: f"(1 - (1 - {floor}::DOUBLE) * least({w(n)}, {cap}::DOUBLE) / {cap}::DOUBLE)"
    m = f"greatest(0.1::DOUBLE, 1 + {w('risk_weight')} * 0.25::DOUBLE + {w('speed_weight')} * 0.15::DOUBLE)"
    r = f"greatest(0.1::DOUBLE, {lerp('tfl_cycleway_weight', 0.55, 1)} * {lerp('green_weight', 0.6, 1)} * {lerp('vehicular_free_weight', 0.55, 3)})"
    return f"SELECT cast(k AS INTEGER) AS id, {_whole(f'{m} * {r} * 1000000')} AS bound FROM range(200) AS q(k)"


ORACLE_SQL = {
    "x43_weather": f"WITH e AS (SELECT event_id, {_list(CODES, 'event_id')} AS code, event_id * 7 % 130 / 10::DOUBLE AS wind, event_id * 11 % 45 - 8 AS temp, event_id % 95 / 10::DOUBLE AS uv, event_id * 13 % 720 - 180 AS deg, event_id % 3 <> 0 AS day FROM events) SELECT event_id, {_WMO} AS label, CASE WHEN wind < 1.5 THEN 'calm' WHEN wind > 10 THEN 'extreme' ELSE 'moderate' END AS wind_band, CASE WHEN temp <= 5 THEN 'cold' WHEN temp >= 28 THEN 'hot' END AS warn, {_list(('N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'), _whole('((deg + 360) % 360) / 45::DOUBLE'))} AS compass, CASE WHEN NOT day OR uv <= 0 THEN 'No UV' WHEN {_whole('uv * 10')} % 10 = 0 THEN 'UV ' || {_whole('uv * 10')} // 10 ELSE 'UV ' || {_one('uv')} END AS uv_caption, {_WARN} AS warning FROM e",
    "x44_formats": f"{_O}, f AS (SELECT id, id * 37 % 4000 / 10::DOUBLE AS minutes, id * 911 % 200000 / 10::DOUBLE + CASE WHEN id % 3 = 0 THEN 30000 ELSE 0 END AS metres, id * 917 % 200000 / 10::DOUBLE AS other, {_whole('id * 37 % 4000 / 10::DOUBLE - id * 41 % 4000 / 10::DOUBLE')} AS td FROM o) SELECT id, CASE WHEN {_whole('minutes')} < 60 THEN {_whole('minutes')} || ' min' ELSE {_whole('minutes')} // 60 || ':' || lpad(cast({_whole('minutes')} % 60 AS VARCHAR), 2, '0') || ' h' END AS duration, CASE WHEN metres < 1000 THEN {_whole(_M)} || ' m' WHEN {_K} < 10 THEN {_one(_K)} || ' km' ELSE {_whole(_K)} || ' km' END AS metric, CASE WHEN {_MI} < 0.1 THEN {_whole('metres / 0.3048::DOUBLE')} || ' ft' WHEN {_MI} < 10 THEN {_one(_MI)} || ' mi' ELSE {_whole(_MI)} || ' mi' END AS imperial, CASE WHEN td = 0 THEN 'same as non-optimised' WHEN td > 0 THEN '+' || td || ' min vs non-optimised' ELSE '−' || -td || ' min vs non-optimised' END AS time_delta, CASE WHEN abs(metres - other) < 25 THEN 'same as non-optimised' ELSE CASE WHEN metres > other THEN '+' ELSE '−' END || CASE WHEN abs(metres - other) < 1000 THEN {_whole('abs(metres - other)')} || ' m' ELSE {_one('abs(metres - other) / 1000')} || ' km' END || ' vs non-optimised' END AS distance_delta, greatest(1, cast(round_even((id * 7 % 3000) * 1.2::DOUBLE / 80, 0) AS BIGINT)) AS walk_min FROM f",
    "x33_departures": f"{_O}, t AS (SELECT id, CASE (id % 6) WHEN 0 THEN {_STAMP} WHEN 1 THEN timezone('UTC', timezone('Europe/London', {_STAMP})) WHEN 2 THEN {_STAMP} - INTERVAL 2 HOUR WHEN 3 THEN {_STAMP} + INTERVAL 90 MINUTE ELSE {NOW} END AS place, CASE WHEN id % 6 < 4 THEN {_STAMP} END AS feed FROM o) SELECT id, cast(epoch(place) AS BIGINT) AS second, epoch(place) - epoch({NOW}) > 1800 AS future, cast(epoch(feed) AS BIGINT) AS feed_second FROM t",
    "x31_sun": _UP + f" SELECT event_id, {_whole('up * 100')} AS centidegrees, up < -3 AS dark FROM u",
    "x35_ride_times": f"{_O}, r AS (SELECT id, id * 911 % 40000 - 50 AS m, 15::DOUBLE + id % 4 * 5 AS kmh FROM o) SELECT id, {_whole('CASE WHEN m <= 0 THEN 0 ELSE m / (kmh / 3.6::DOUBLE * 60) END * 1000')} AS plain, {_whole('CASE WHEN m <= 0 THEN 0 ELSE m / (kmh * 1.35::DOUBLE / 3.6::DOUBLE * 60) END * 1000')} AS fast, {_whole('(CASE WHEN m <= 0 THEN 0 ELSE m / (kmh / 3.6::DOUBLE * 60) END + ((id * 3 % 7) * 25 + (id * 4 % 7) * 6 + (id * 5 % 7) * 15 + (id * 6 % 7) * 10 + (id * 7 % 7) * 4 + (id * 8 % 7) * 20 + (id * 9 % 7)) / 60::DOUBLE) * 1000')} AS stops FROM r",
    "x37_vias": f"{_O} SELECT id, ([0, 1, 2, 2, 1, 1, 3, 4, 1])[id % 9 + 1] AS n, ([NULL, 51500000, 51500000, 51500000, 91000000, 51500000, 1000000, 1000000, 51250000])[id % 9 + 1]::BIGINT AS first_lat_u, ([NULL, NULL, NULL, 'bad via 2', 'bad via 1', 'bad via 1', NULL, 'too many: 4', NULL])[id % 9 + 1] AS error FROM o",
    "x39_node_ids": f"{_O} SELECT id, ([-123456, 500000, NULL, -123457])[id % 4 + 1]::BIGINT AS lon_u, ([51500000, 51250000, NULL, 51000000])[id % 4 + 1]::BIGINT AS lat_u, CASE WHEN id % 4 = 2 THEN 'n17' END AS name FROM o",
    "r02_weight_errors": f"{_O} SELECT id, CASE " + " ".join(f"WHEN id % 40 = {i} THEN 'missing weight key: {n}' WHEN {_V(i)} > {cost.CAPS[n]}::DOUBLE THEN '{n} must be between 0.0 and {cost.CAPS[n]}'" for i, n in enumerate(NAMES)) + " WHEN id % 19 = 0 THEN 'unknown weight keys: glide, zoom' END AS error FROM o",
    "r03_default_weights": f"{_O} SELECT id, " + ", ".join(_cap_case(i, n) for i, n in enumerate(NAMES)) + " FROM o",
    "r04_normalised": f"{_O} SELECT id, (['cargo', 'road', 'standard', 'standard', 'ebike'])[id % 5 + 1] AS bike, CASE WHEN id % 2 = 1 THEN id % 3 = 0 ELSE false END AS light_night, false AS surface, CASE WHEN id % 2 = 1 THEN id % 4 = 0 ELSE true END AS jam_comfort, true AS shared_path, CASE WHEN id % 2 = 0 THEN id % 5 = 0 ELSE true END AS bus_lane, CASE WHEN id % 2 = 0 THEN id % 6 = 0 ELSE false END AS painted_lane FROM o",
    "r05_gated_weights": f"{_O} SELECT id, CASE WHEN id % 2 = 0 THEN {_whole('id % 11 / 10::DOUBLE * 1000')} ELSE 0 END AS light_weight, CASE WHEN id % 3 = 0 THEN 0 ELSE {_whole('id % 7 / 10::DOUBLE * 1000')} END AS tfl_live_weight, 1000::BIGINT AS risk_weight FROM o",
    "x27_cost_bounds": _bound_sql(),
    "f18_visible_profiles": "SELECT c_custkey AS id, c_custkey % 97 = 0 AS is_system, substr(c_name, 1, 22) AS name FROM customer WHERE c_custkey % 97 = 0 OR c_custkey % 10 = 7",
    "l08_request_budget": "WITH RECURSIVE e AS (SELECT event_id, user_id, cast(floor(epoch(ts)) AS BIGINT) AS s, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS n FROM events), r(event_id, user_id, n, hits, allowed) AS (SELECT event_id, user_id, n, [s], true FROM e WHERE n = 1 UNION ALL SELECT e.event_id, e.user_id, e.n, CASE WHEN len(list_filter(r.hits, lambda h: h > e.s - 43200)) < 5 THEN list_append(list_filter(r.hits, lambda h: h > e.s - 43200), e.s) ELSE list_filter(r.hits, lambda h: h > e.s - 43200) END, len(list_filter(r.hits, lambda h: h > e.s - 43200)) < 5 FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) SELECT event_id, user_id, allowed FROM r",
    "l08_lockout": "WITH RECURSIVE e AS (SELECT event_id, user_id, event_type = 'error' AS fail, cast(floor(epoch(ts)) AS BIGINT) AS s, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS n FROM events WHERE event_type IN ('error', 'click')), z AS (SELECT *, []::BIGINT[] AS f0 FROM e), r(event_id, user_id, n, fails, until, allowed) AS (SELECT event_id, user_id, n, CASE WHEN fail THEN [s] ELSE f0 END, 0::BIGINT, true FROM z WHERE n = 1 UNION ALL SELECT e.event_id, e.user_id, e.n, CASE WHEN NOT e.fail THEN r.fails WHEN len(list_filter(r.fails, lambda h: h > e.s - 864000)) >= 4 THEN e.f0 ELSE list_append(list_filter(r.fails, lambda h: h > e.s - 864000), e.s) END, CASE WHEN e.fail AND len(list_filter(r.fails, lambda h: h > e.s - 864000)) >= 4 THEN e.s + 172800 ELSE r.until END, r.until <= e.s FROM r JOIN z e ON e.user_id = r.user_id AND e.n = r.n + 1) SELECT event_id, user_id, allowed FROM r",
}
