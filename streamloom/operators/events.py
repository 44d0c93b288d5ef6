"""Segments of driving, late data, order, rules and questions to the latest state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.functions import geo
from streamloom.functions.scalar import safe_predicate
from streamloom.operators.running import before


def _summary() -> list:
    return [F.min("event_time").alias("start_time"), F.count("*").cast("int").alias("length"), F.max("speed").cast("int").alias("max_speed"), F.stddev_pop("throttle").alias("erraticness")]


def driving_sessions(cars: DataFrame, gap: str = "15 seconds") -> DataFrame:
    """A summary of each car's events between gaps longer than ``gap``."""
    return cars.groupBy("car_id", F.session_window("event_time", gap).alias("s")).agg(*_summary()).drop("s")


def _closed(cars: DataFrame, least: int) -> DataFrame:
    """Driving events with the number of their car's stops before them, of segments that a stop ends and ``least`` stops precede."""
    stop = (F.col("speed") == 0).cast("long")
    counted = before(cars, ["car_id"], "event_time", {"stops": ("sum", stop)}, ties=("event_id",)).withColumn("stops", F.coalesce("stops", F.lit(0)))
    # the segment after k stops is closed if its car stops more often
    total = cars.groupBy(F.col("car_id").alias("__car")).agg(F.sum(stop).alias("__total"))
    moving = counted.where(F.col("speed") != 0).where(F.col("stops") >= least)
    return moving.join(total, F.col("car_id").eqNullSafe(F.col("__car"))).where("stops < __total").drop("__car", "__total")


def stopped_segments(cars: DataFrame) -> DataFrame:
    """A summary of the driving up to each stop; what has no stop after it is not yet a segment."""
    return _closed(cars, 0).groupBy("car_id", "stops").agg(*_summary()).drop("stops")


def stopped_segments_pattern(cars: DataFrame) -> DataFrame:
    """As stopped_segments, but only between two stops: stop, driving, stop."""
    return _closed(cars, 1).groupBy("car_id", "stops").agg(*_summary()).drop("stops")


def late_split(events: DataFrame, order: str, time: str, delay: str) -> DataFrame:
    """Adds ``late``: the time is not beyond the watermark, which is the largest time that came before less ``delay``."""
    seen = _before_all(events, order, time)
    return seen.withColumn("late", F.coalesce(F.col(time) <= F.col("__seen") - F.expr(f"interval {delay}"), F.lit(False))).drop("__seen")


def _before_all(events: DataFrame, order: str, time: str) -> DataFrame:
    return before(events.withColumn("__all", F.lit(0)), ["__all"], order, {"__seen": ("max", F.col(time))}).drop("__all")


def window_counts(split: DataFrame, size: str) -> DataFrame:
    """Of rows that late_split has parted: the number of each user's rows on time in each window."""
    counts = split.where("not late").groupBy("user_id", F.window("ts", size).alias("w")).agg(F.count("*").alias("n"))
    return counts.select("user_id", F.col("w.start").alias("window_start"), "n")


def late_window_counts(split: DataFrame, size: int) -> DataFrame:
    """The number of late rows among each ``size`` arrivals, of all users."""
    return split.where("late").groupBy((F.col("arrival") - F.col("arrival") % size).alias("first_arrival")).agg(F.count("*").alias("n"))


#: Control rows (queries) that are sent to all tasks, at most.
MAX_CONTROL_ROWS = 100_000


def control_rows(df: DataFrame) -> DataFrame:
    """``df`` to be sent to all tasks, after its rows are counted; more than people can type are refused."""
    if df.count() > MAX_CONTROL_ROWS:
        raise ValueError(f"more than {MAX_CONTROL_ROWS} control rows")
    return F.broadcast(df)


def ending_rides_near(rides: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, taxi_id, km, event_id) of each END with each query asked before it.

    ``queries`` are control rows: query_id, longitude, latitude, asked_at (an event_id).
    """
    ends = rides.where("not is_start")
    pairs = ends.join(control_rows(queries), F.col("event_id") > F.col("asked_at"))
    return pairs.select("query_id", "taxi_id", geo.euclid_km("end_lon", "end_lat", "longitude", "latitude").cast("float").alias("km"), "event_id")


def nearest_taxi(rides: DataFrame, queries: DataFrame) -> DataFrame:
    """The nearest END of each query, the earliest on ties."""
    best = ending_rides_near(rides, queries).groupBy("query_id").agg(F.min(F.struct("km", "event_id", "taxi_id")).alias("m"))
    return best.select("query_id", "m.taxi_id", "m.km")


def nearest_taxi_minima(rides: DataFrame, queries: DataFrame) -> DataFrame:
    """Every END that is nearer than all before it, per query, in the order of arrival."""
    seen = before(ending_rides_near(rides, queries), ["query_id"], "event_id", {"least": ("min", F.col("km"))})
    return seen.where("least is null or km < least").select("query_id", "taxi_id", "km", "event_id")


def nearest_taxi_trace(rides: DataFrame, queries: DataFrame) -> DataFrame:
    """The least distance so far after every END, per query, in the order of arrival."""
    return before(ending_rides_near(rides, queries), ["query_id"], "event_id", {"least": ("min", F.col("km"))}, inclusive=True)


def latest(rides: DataFrame) -> DataFrame:
    """The last record of each ride by time, an END after a START at the same time."""
    row = F.struct("event_time", (~F.col("is_start")).alias("ended"), F.struct(*rides.columns).alias("r"))
    return rides.groupBy("ride_id").agg(F.max(row).alias("m")).select("m.r.*")


def ongoing_rides(rides: DataFrame, queries: DataFrame) -> DataFrame:
    """For each query (query_id, minutes, asked_at time): rides whose latest record is a START of that many whole minutes ago or more."""
    age = F.floor((F.unix_millis("asked_at") - F.unix_millis("event_time")) / 60000)
    return latest(rides).where("is_start").join(control_rows(queries), age >= F.col("minutes")).select("query_id", "ride_id", "event_time")


def matching(rides: DataFrame, predicate: str) -> DataFrame:
    """Latest records that a user's predicate holds for; see safe_predicate for what it may say."""
    rows = latest(rides)
    return rows.where(safe_predicate(predicate, rows.columns))


def rule_matches(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Pairs of a colour's items that complete a rule (rule, first, second), each first with the next second.

    ``items`` has colour, shape and seq. All firsts since the last second are paired with the next second
    and cleared; where a rule's shapes are equal, an item completes those before it and waits again.
    """
    shapes = rules.select("rule", "first", "second", F.explode(F.array_distinct(F.array("first", "second"))).alias("shape"))
    keyed = items.join(shapes, "shape")
    closing = F.when(F.col("shape") == F.col("second"), F.col("seq"))
    paired = before(keyed, ["colour", "rule"], "seq", {"closed_by": ("min", closing)}, reverse=True)
    return paired.where("shape = first and closed_by is not null").select("rule", "colour", F.col("seq").alias("opened_by"), "closed_by")
