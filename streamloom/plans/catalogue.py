"""All queries by name, with the DuckDB SQL that checks them.

Queries read whole tables; sizes that stand in the SQL (windows, thresholds)
are parameters of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.functions import geo
from streamloom.functions.scalar import erraticness_desc, safe_predicate, time_diff_ms
from streamloom.operators import events as ev
from streamloom.operators import trips as tr
from streamloom.operators.running import position
from streamloom.plans import adapter
from streamloom.plans.adapter import cars, fares, rides
from streamloom.sources import ingest

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _d(x: float | str) -> str:
    return f"CAST('{x}' AS DOUBLE)"


def _nyc(lon: str, lat: str) -> str:
    return f"(CAST({lon} AS DOUBLE) BETWEEN {_d(-74.05)} AND {_d(-73.7)} AND CAST({lat} AS DOUBLE) BETWEEN {_d(40.5)} AND {_d(41.0)})"


_X = lambda lon: f"floor(({_d(74.05)} - abs(CAST({lon} AS DOUBLE))) / {_d(0.0014)})"
_Y = lambda lat: f"floor(({_d(41.0)} - CAST({lat} AS DOUBLE)) / {_d(0.00125)})"
_CELL = lambda lon, lat: f"CAST({_X(lon)} + {_Y(lat)} * 250 AS INTEGER)"
_KM = lambda a, b, c, d: f"sqrt(power(CAST({b} - {d} AS DOUBLE), 2) + power(CAST({a} - {c} AS DOUBLE) * cos(CAST({d} AS DOUBLE)), 2)) * {_d(110.25)}"
_ANGLE = lambda a, b, c, d: f"CAST(trunc(degrees(atan2(CAST({d} - {b} AS DOUBLE), CAST({c} - {a} AS DOUBLE) * cos(CAST({b} AS DOUBLE))))) AS INTEGER) + 179"
_BOTH = f"{_nyc('start_lon', 'start_lat')} AND {_nyc('end_lon', 'end_lat')}"
_CELL_LON = lambda c: f"CAST(-CAST({_d(74.05)} - ({c} % 250) * {_d(0.0014)} - {_d(0.0007)} AS FLOAT) AS FLOAT)"
_CELL_LAT = lambda c: f"CAST({_d(41.0)} - ({c} // 250) * {_d(0.00125)} - {_d(0.000625)} AS FLOAT)"
_VIEWS = f"WITH rides AS ({adapter.RIDES}), fares AS ({adapter.FARES}), cars AS ({adapter.CARS})"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (_VIEWS + ("," if sql.lstrip().startswith(",") else " ") + sql.lstrip().lstrip(","))
        return f

    return add


_RIDE = "event_id, ride_id, is_start, event_time, taxi_id"


@query(f"SELECT {_RIDE}, start_lon, start_lat, end_lon, end_lat FROM rides WHERE {_BOTH}")
def ride_cleansing(spark: SparkSession, d: str) -> DataFrame:
    return tr.cleanse(rides(spark, d)).select(*_RIDE.split(", "), "start_lon", "start_lat", "end_lon", "end_lat")


@query("SELECT driver_id, count(*) AS n FROM rides GROUP BY driver_id")
def ride_count(spark: SparkSession, d: str) -> DataFrame:
    return tr.ride_count(rides(spark, d))


@query("SELECT event_id, driver_id, count(*) OVER (PARTITION BY driver_id ORDER BY event_id) AS n FROM rides")
def ride_count_trace(spark: SparkSession, d: str) -> DataFrame:
    return tr.ride_count_trace(rides(spark, d))


@query("SELECT event_id + 1 AS event_id FROM events")
def increment_map(spark: SparkSession, d: str) -> DataFrame:
    return tr.increment(spark.read.parquet(f"{d}/events.parquet").select("event_id"), "event_id")


@query("SELECT date_trunc('hour', event_time) + INTERVAL 1 HOUR AS window_end, driver_id, round(sum(tip), 6) AS tips FROM fares GROUP BY 1, 2")
def hourly_tip_sums(spark: SparkSession, d: str) -> DataFrame:
    return tr.tip_sums(fares(spark, d)).select(F.col("w.end").alias("window_end"), "driver_id", F.round("tips", 6).alias("tips"))


@query(""", s AS (SELECT date_trunc('hour', event_time) + INTERVAL 1 HOUR AS window_end, driver_id, sum(tip) AS tips FROM fares GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY window_end ORDER BY tips DESC, driver_id) AS k FROM s)
SELECT window_end, driver_id, round(tips, 6) AS tips FROM r WHERE k = 1""")
def hourly_tip_max(spark: SparkSession, d: str) -> DataFrame:
    return tr.max_tips(tr.tip_sums(fares(spark, d))).withColumn("tips", F.round("tips", 6))


_PLACES = dict(threshold=3, size="3 hours", slide="1 hour", coarse=50)
_PLACES_SQL = f""", c AS (SELECT *, CASE WHEN is_start THEN {_CELL('start_lon', 'start_lat')} ELSE {_CELL('end_lon', 'end_lat')} END AS c FROM rides WHERE {_BOTH}),
h AS (SELECT (c % 250 - c % 250 % 50) + (c // 250 - c // 250 % 50) * 250 AS cell, is_start, date_trunc('hour', event_time) - k * INTERVAL 1 HOUR AS window_start FROM c, (VALUES (0), (1), (2)) v(k)),
g AS (SELECT cell, is_start, window_start, window_start + INTERVAL 3 HOUR AS window_end, count(*) AS n FROM h GROUP BY 1, 2, 3)
"""


@query(_PLACES_SQL + f"SELECT {_CELL_LON('cell')} AS lon, {_CELL_LAT('cell')} AS lat, window_end, is_start, n FROM g WHERE n >= 3")
def popular_places_df(spark: SparkSession, d: str) -> DataFrame:
    return tr.popular_places(rides(spark, d), **_PLACES)


@query(_PLACES_SQL + "SELECT cell, is_start, window_start, window_end, n FROM g WHERE n > 3")
def popular_places_sql(spark: SparkSession, d: str) -> DataFrame:
    rides(spark, d).createOrReplaceTempView("rides")
    return tr.popular_places_sql(spark, "rides", **_PLACES)


@query(_PLACES_SQL + "SELECT cell, is_start, window_start, window_end, n FROM g WHERE n > 3")
def popular_places_fluent(spark: SparkSession, d: str) -> DataFrame:
    return tr.popular_places_fluent(rides(spark, d), **_PLACES)


@query(f"SELECT is_start, date_trunc('hour', event_time) AS window_start, count(is_start) AS n FROM rides WHERE {_BOTH} GROUP BY 1, 2")
def rides_per_hour(spark: SparkSession, d: str) -> DataFrame:
    rides(spark, d).createOrReplaceTempView("rides")
    return tr.rides_per_hour(spark, "rides")


_SUMMARY = "min(event_time) AS start_time, CAST(count(*) AS INTEGER) AS length, CAST(trunc(max(speed)) AS INTEGER) AS max_speed, round(stddev_pop(throttle), 6) AS erraticness"


@query(f""", g AS (SELECT *, CASE WHEN event_time - lag(event_time) OVER (PARTITION BY car_id ORDER BY event_time) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM cars),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY car_id ORDER BY event_time, event_id) AS session FROM g)
SELECT car_id, {_SUMMARY} FROM s GROUP BY car_id, session""")
def driving_sessions(spark: SparkSession, d: str) -> DataFrame:
    return ev.driving_sessions(cars(spark, d), "2 hours").withColumn("erraticness", F.round("erraticness", 6))


_STOPS = """, s AS (SELECT *, coalesce(sum(CASE WHEN speed = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY car_id ORDER BY event_time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stops,
 sum(CASE WHEN speed = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY car_id ORDER BY event_time, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead FROM cars)
"""


@query(_STOPS + f"SELECT car_id, {_SUMMARY} FROM s WHERE speed <> 0 AND ahead > 0 GROUP BY car_id, stops")
def stopped_segments_window(spark: SparkSession, d: str) -> DataFrame:
    return ev.stopped_segments(cars(spark, d)).withColumn("erraticness", F.round("erraticness", 6))


@query(_STOPS + f"SELECT car_id, {_SUMMARY} FROM s WHERE speed <> 0 AND ahead > 0 AND stops > 0 GROUP BY car_id, stops")
def stopped_segments_pattern(spark: SparkSession, d: str) -> DataFrame:
    return ev.stopped_segments_pattern(cars(spark, d)).withColumn("erraticness", F.round("erraticness", 6))


@query(""", s AS (SELECT *, CASE WHEN speed = 0 THEN NULL ELSE CAST(trunc(throttle / 2.5) AS INTEGER) END AS level FROM cars)
SELECT event_id, CASE WHEN trunc(throttle / 2.5) = 0 THEN 'calm' WHEN trunc(throttle / 2.5) = 1 THEN 'busy' ELSE 'crazy' END AS description FROM s""")
def erraticness(spark: SparkSession, d: str) -> DataFrame:
    return cars(spark, d).select("event_id", erraticness_desc(F.col("throttle")).alias("description"))


# Events arrive by a scrambled number, so that some are late.
_ARRIVAL = "(event_id - event_id % 50 + (event_id * 17 + 3) % 50)"
_LATE = f""", a AS (SELECT event_id, user_id, ts, {_ARRIVAL} AS arrival FROM events),
w AS (SELECT *, max(ts) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM a),
l AS (SELECT event_id, user_id, ts, coalesce(ts <= seen - INTERVAL 1 HOUR, false) AS late FROM w)
"""


def _arrived(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "ts", F.expr(_ARRIVAL).alias("arrival"))
    return ev.late_split(rows, "arrival", "ts", "1 hour")


def _late(spark: SparkSession, d: str) -> DataFrame:
    return _arrived(spark, d).drop("arrival")


@query(_LATE + "SELECT * FROM l")
def late_split(spark: SparkSession, d: str) -> DataFrame:
    return _late(spark, d)


@query(_LATE + "SELECT user_id, count(*) FILTER (NOT late) AS on_time, count(*) FILTER (late) AS late FROM l GROUP BY user_id")
def late_counts(spark: SparkSession, d: str) -> DataFrame:
    return _late(spark, d).groupBy("user_id").agg(F.count_if(~F.col("late")).alias("on_time"), F.count_if("late").alias("late"))


@query(_LATE + "SELECT user_id, date_trunc('hour', ts) AS window_start, count(*) AS n FROM l WHERE NOT late GROUP BY 1, 2")
def window_counts(spark: SparkSession, d: str) -> DataFrame:
    return ev.window_counts(_late(spark, d), "1 hour")


@query(_LATE.replace("SELECT event_id, user_id, ts, coalesce(", "SELECT event_id, user_id, ts, arrival, coalesce(") + "SELECT arrival - arrival % 1000 AS first_arrival, count(*) AS n FROM l WHERE late GROUP BY 1")
def late_window_counts(spark: SparkSession, d: str) -> DataFrame:
    return ev.late_window_counts(_arrived(spark, d), 1000)


@query("SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) AS position FROM events")
def event_time_sort(spark: SparkSession, d: str) -> DataFrame:
    return position(spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts"), "ts", "event_id", "position")


@query("SELECT r.ride_id, r.event_time, r.taxi_id, f.tip FROM rides r JOIN fares f USING (ride_id) WHERE r.is_start")
def rides_fares_join(spark: SparkSession, d: str) -> DataFrame:
    return tr.join_fares(rides(spark, d), fares(spark, d)).select("ride_id", "event_time", "taxi_id", "tip")


@query("SELECT r.ride_id, f.tip FROM rides r JOIN fares f USING (ride_id) WHERE r.is_start AND r.ride_id % 1000 <> 0")
def matched(spark: SparkSession, d: str) -> DataFrame:
    return tr.join_fares(tr.kept_starts(rides(spark, d)), fares(spark, d)).select("ride_id", "tip")


@query("SELECT ride_id, event_time FROM rides r WHERE is_start AND ride_id % 1000 <> 0 AND NOT EXISTS (SELECT 1 FROM fares f WHERE f.ride_id = r.ride_id)")
def unmatched_rides(spark: SparkSession, d: str) -> DataFrame:
    return tr.unmatched(tr.kept_starts(rides(spark, d)), fares(spark, d)).select("ride_id", "event_time")


@query("SELECT ride_id, tip FROM fares f WHERE NOT EXISTS (SELECT 1 FROM rides r WHERE r.ride_id = f.ride_id AND is_start AND ride_id % 1000 <> 0)")
def unmatched_fares(spark: SparkSession, d: str) -> DataFrame:
    return tr.unmatched(fares(spark, d), tr.kept_starts(rides(spark, d))).select("ride_id", "tip")


_LONG = f""", l AS (SELECT s.* FROM rides s LEFT JOIN (SELECT ride_id, min(event_time) AS ended FROM rides WHERE NOT is_start GROUP BY 1) e USING (ride_id)
WHERE s.is_start AND (e.ended IS NULL OR e.ended > s.event_time + INTERVAL 2 HOUR))
"""


@query(_LONG + f"SELECT {_RIDE} FROM l")
def long_rides(spark: SparkSession, d: str) -> DataFrame:
    return tr.long_rides(rides(spark, d)).select(*_RIDE.split(", "))


@query(_LONG.replace("FROM rides s", f"FROM (SELECT * FROM rides WHERE {_BOTH}) s").replace("FROM rides WHERE NOT", f"FROM rides WHERE {_BOTH} AND NOT") + f"SELECT {_RIDE} FROM l")
def long_rides_nyc(spark: SparkSession, d: str) -> DataFrame:
    return tr.long_rides(tr.cleanse(rides(spark, d))).select(*_RIDE.split(", "))


@query(_LONG + f"SELECT {_RIDE} FROM l")
def long_rides_pattern(spark: SparkSession, d: str) -> DataFrame:
    return tr.long_rides_pattern(rides(spark, d)).select(*_RIDE.split(", "))


def _trades(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").where(F.col("event_type") == kind).select("event_id", "user_id", "ts", "value")


_ASOF = "SELECT t.event_id, t.user_id, t.ts, c.value AS info, c.ts AS info_at FROM (SELECT * FROM events WHERE event_type = 'view') t ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') c ON t.user_id = c.user_id AND t.{0} >= c.{0}"


@query(_ASOF.format("ts"))
def asof_enrich(spark: SparkSession, d: str) -> DataFrame:
    customers = _trades(spark, d, "signup").select("user_id", "ts", F.col("value").alias("info"), F.col("ts").alias("info_at"))
    return tr.asof(_trades(spark, d, "view").drop("value"), customers, "user_id", "ts", ["info", "info_at"])


@query(_ASOF.format("event_id"))
def arrival_enrich(spark: SparkSession, d: str) -> DataFrame:
    customers = _trades(spark, d, "signup").select("user_id", "event_id", F.col("value").alias("info"), F.col("ts").alias("info_at"))
    return tr.asof(_trades(spark, d, "view").drop("value"), customers, "user_id", "event_id", ["info", "info_at"])


_RULES = "(VALUES ('view then click', 'view', 'click'), ('error then purchase', 'error', 'purchase'), ('two signups', 'signup', 'signup'))"


@query(f""", k AS (SELECT e.*, r.* FROM (SELECT event_id AS seq, user_id % 10 AS colour, event_type AS shape FROM events) e JOIN {_RULES} r(rule, f, s) ON e.shape IN (r.f, r.s)),
p AS (SELECT *, min(CASE WHEN shape = s THEN seq END) OVER (PARTITION BY colour, rule ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS closed_by FROM k)
SELECT rule, colour, seq AS opened_by, closed_by FROM p WHERE shape = f AND closed_by IS NOT NULL""")
def rule_matches(spark: SparkSession, d: str) -> DataFrame:
    items = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("seq"), (F.col("user_id") % 10).alias("colour"), F.col("event_type").alias("shape"))
    return ev.rule_matches(items, spark.sql(f"SELECT * FROM {_RULES} AS r(rule, first, second)"))


_ASKED = "(VALUES (1, CAST(-73.9 AS FLOAT), CAST(40.8 AS FLOAT), 0), (2, CAST(-74.0 AS FLOAT), CAST(40.6 AS FLOAT), 100), (3, CAST(-73.8 AS FLOAT), CAST(40.9 AS FLOAT), 500))"
_NEAR = f""", p AS (SELECT q.query_id, r.taxi_id, CAST({_KM('r.end_lon', 'r.end_lat', 'q.longitude', 'q.latitude')} AS FLOAT) AS km, r.event_id
FROM rides r JOIN {_ASKED} q(query_id, longitude, latitude, asked_at) ON r.event_id > q.asked_at WHERE NOT r.is_start)
"""


def _asked(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {_ASKED} AS q(query_id, longitude, latitude, asked_at)")


@query(_NEAR + "SELECT query_id, taxi_id, km FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY km, event_id) AS k FROM p) WHERE k = 1")
def nearest_taxi(spark: SparkSession, d: str) -> DataFrame:
    return ev.nearest_taxi(rides(spark, d), _asked(spark))


@query(_NEAR + "SELECT query_id, taxi_id, km, event_id FROM (SELECT *, min(km) OVER (PARTITION BY query_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM p) WHERE m IS NULL OR km < m")
def nearest_taxi_minima(spark: SparkSession, d: str) -> DataFrame:
    return ev.nearest_taxi_minima(rides(spark, d), _asked(spark))


@query(_NEAR + "SELECT query_id, event_id, taxi_id, km, min(km) OVER (PARTITION BY query_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS least FROM p")
def nearest_taxi_trace(spark: SparkSession, d: str) -> DataFrame:
    return ev.nearest_taxi_trace(rides(spark, d), _asked(spark))


_LATEST = ", l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ride_id ORDER BY event_time DESC, is_start) AS k FROM rides) WHERE k = 1)\n"
_AGES = "(VALUES (1, 60, TIMESTAMP '2024-01-10 00:00:00'), (2, 600, TIMESTAMP '2024-01-20 00:00:00'))"


@query(_LATEST + f"SELECT q.query_id, l.ride_id, l.event_time FROM l JOIN {_AGES} q(query_id, minutes, asked_at) ON floor((epoch_ms(q.asked_at) - epoch_ms(l.event_time)) / 60000) >= q.minutes WHERE l.is_start")
def ongoing_rides(spark: SparkSession, d: str) -> DataFrame:
    return ev.ongoing_rides(rides(spark, d), spark.sql(f"SELECT * FROM {_AGES} AS q(query_id, minutes, asked_at)"))


@query(_LATEST + "SELECT ride_id, event_time, is_start, taxi_id FROM l WHERE is_start AND taxi_id % 7 = 3 OR end_lat > CAST(41 AS DOUBLE)")
def adhoc_predicate(spark: SparkSession, d: str) -> DataFrame:
    return ev.matching(rides(spark, d), "is_start and taxi_id % 7 = 3 or end_lat > 41").select("ride_id", "event_time", "is_start", "taxi_id")


@query(f""", r AS (SELECT event_id, ride_id, is_start, {_CELL('end_lon', 'end_lat')} AS cell, CAST(trunc(({_ANGLE('end_lon', 'end_lat', 'start_lon', 'start_lat')}) / CAST(45 AS DOUBLE)) AS INTEGER) AS bucket,
 {_KM('start_lon', 'start_lat', 'end_lon', 'end_lat')} AS km, (epoch_ms(end_time) - epoch_ms(start_time)) / CAST(60000 AS DOUBLE) AS minutes FROM rides WHERE {_BOTH}),
s AS (SELECT *, sum(CASE WHEN NOT is_start THEN km * minutes END) OVER w AS xy, sum(CASE WHEN NOT is_start THEN km * km END) OVER w AS xx, count(CASE WHEN NOT is_start THEN 1 END) OVER w AS seen FROM r
 WINDOW w AS (PARTITION BY cell, bucket ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT ride_id, CASE WHEN seen < 2 OR xx = 0 THEN -1 ELSE CAST(trunc(xy / xx * km) AS INTEGER) END AS minutes FROM s WHERE is_start""")
def travel_time_prediction(spark: SparkSession, d: str) -> DataFrame:
    return tr.travel_time(rides(spark, d))


@query(f"SELECT event_id, round({_KM('start_lon', 'start_lat', 'end_lon', 'end_lat')}, 6) AS km FROM rides")
def euclid_km(spark: SparkSession, d: str) -> DataFrame:
    return rides(spark, d).select("event_id", F.round(geo.euclid_km("start_lon", "start_lat", "end_lon", "end_lat"), 6).alias("km"))


@query(f"SELECT event_id, {_ANGLE('start_lon', 'start_lat', 'end_lon', 'end_lat')} AS angle FROM rides")
def direction_angle(spark: SparkSession, d: str) -> DataFrame:
    return rides(spark, d).select("event_id", geo.direction_angle("start_lon", "start_lat", "end_lon", "end_lat").alias("angle"))


@query(f"SELECT event_id, {_CELL('start_lon', 'start_lat')} AS cell FROM rides")
def grid_cell(spark: SparkSession, d: str) -> DataFrame:
    return rides(spark, d).select("event_id", geo.grid_cell("start_lon", "start_lat").alias("cell"))


@query(f", c AS (SELECT event_id, {_CELL('start_lon', 'start_lat')} AS cell FROM rides WHERE {_BOTH}) SELECT event_id, {_CELL_LON('cell')} AS lon, {_CELL_LAT('cell')} AS lat FROM c")
def cell_center(spark: SparkSession, d: str) -> DataFrame:
    cells = tr.cleanse(rides(spark, d)).select("event_id", geo.grid_cell("start_lon", "start_lat").alias("cell"))
    return cells.select("event_id", geo.cell_lon("cell").alias("lon"), geo.cell_lat("cell").alias("lat"))


@query("SELECT event_id, epoch_ms(end_time) - epoch_ms(start_time) AS ms FROM rides")
def time_diff(spark: SparkSession, d: str) -> DataFrame:
    return rides(spark, d).select("event_id", time_diff_ms("start_time", "end_time").alias("ms"))


_TRIPS = "SELECT event_id AS trip_id, ts AS pickup, ts + INTERVAL '1' MINUTE * CAST(event_id % 90 + 1 AS INT) AS dropoff, user_id AS driver_id FROM events"


@query(f""", t AS ({_TRIPS})
SELECT trip_id, true AS is_start, pickup AS event_time, pickup AS start_time, TIMESTAMP '1970-01-01 00:00:00' AS end_time, driver_id FROM t
UNION ALL SELECT trip_id, false, dropoff, pickup, dropoff, driver_id FROM t""")
def trips_to_rides(spark: SparkSession, d: str) -> DataFrame:
    return ingest.trips_to_rides(adapter._view(spark, d, _TRIPS))


@query(f"""SELECT trip_id AS ride_id, driver_id, pickup AS start_time, CASE WHEN trip_id % 3 = 0 THEN 'CSH' ELSE 'CRD' END AS payment_type, round(tip, 6) AS tip, round(tolls, 6) AS tolls, round(fare + tip + tolls, 6) AS total_fare
FROM (SELECT event_id AS trip_id, ts AS pickup, user_id AS driver_id, value / 10 AS tip, value / 100 AS tolls, value AS fare FROM events)""")
def trips_to_fares(spark: SparkSession, d: str) -> DataFrame:
    trips = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("trip_id"), F.col("ts").cast("timestamp").alias("pickup"), F.col("user_id").alias("driver_id"), (F.col("value") / 10).alias("tip"), (F.col("value") / 100).alias("tolls"), F.col("value").alias("fare"), F.when(F.col("event_id") % 3 == 0, "CSH").otherwise("CRD").alias("payment_type"))
    out = ingest.trips_to_fares(trips)
    return out.select("ride_id", "driver_id", "start_time", "payment_type", *(F.round(c, 6).alias(c) for c in ("tip", "tolls", "total_fare")))


@query("SELECT event_id, is_start, CAST(start_lon AS FLOAT) AS start_lon, date_trunc('second', start_time) AS start_time, date_trunc('second', end_time) AS end_time, taxi_id FROM rides")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    lines = rides(spark, d).withColumn("passenger_cnt", F.lit(1)).withColumn("driver_id", F.col("event_id")).select(ingest.format_ride().alias("value"))
    return ingest.parse_rides(lines).select(F.col("driver_id").alias("event_id"), "is_start", "start_lon", "start_time", "end_time", "taxi_id")


@query("SELECT event_id, user_id, value FROM events WHERE value > 100 AND event_type IN ('click', 'view')")
def predicate_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet")
    return rows.where(safe_predicate("value > 100 and event_type in ('click', 'view')", rows.columns)).select("event_id", "user_id", "value")


_XY = lambda lon, lat: f"CAST({_X(lon)} AS BIGINT), CAST({_Y(lat)} AS BIGINT)"


@query(f""", c(event_id, x1, y1, x2, y2) AS (SELECT event_id, {_XY('start_lon', 'start_lat')}, {_XY('end_lon', 'end_lat')} FROM rides WHERE {_BOTH}),
l AS (SELECT event_id, least(x1, x2) AS x, CASE WHEN x1 > x2 THEN y2 ELSE y1 END AS y, abs(x2 - x1) AS dx, abs(y2 - y1) AS dy, CASE WHEN x1 > x2 THEN sign(y1 - y2) ELSE sign(y2 - y1) END AS s FROM c),
i AS (SELECT *, unnest(range(0, dx + 1)) AS i FROM l),
h AS (SELECT *, (2 * i + 1) * dy - dx AS h FROM i),
o AS (SELECT *, CASE WHEN i = dx THEN dy WHEN h <= 0 THEN 0 ELSE (h + 2 * dx - 1) // (2 * dx) END AS leaves, CASE WHEN dx > 0 AND h >= 0 AND h % (2 * dx) = 0 THEN 1 ELSE 0 END AS corner FROM h),
e AS (SELECT *, coalesce(lag(leaves + corner) OVER (PARTITION BY event_id ORDER BY i), 0) AS enters FROM o),
j AS (SELECT *, unnest(range(enters, leaves + 1)) AS j FROM e)
SELECT event_id, count(*) AS n_cells, string_agg(CAST(x + i + CAST(y + s * j AS BIGINT) * 250 AS VARCHAR), ',' ORDER BY i, j) AS cells FROM j GROUP BY event_id""")
def cells_on_way(spark: SparkSession, d: str) -> DataFrame:
    cells = tr.cleanse(rides(spark, d)).select("event_id", geo.cells_on_way("start_lon", "start_lat", "end_lon", "end_lat").alias("cells"))
    return cells.select("event_id", F.size("cells").cast("long").alias("n_cells"), F.array_join("cells", ",").alias("cells"))


@query()
def state_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Rides and fares that wait for each other in a stream's checkpoint, read offline."""
    from streamloom.streaming import jobs

    return jobs.snapshot_of_unmatched(spark, rides(spark, d).where("is_start"), fares(spark, d), jobs.shared_folder(spark))
