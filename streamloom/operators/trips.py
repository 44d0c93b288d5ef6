"""Cleansing, counting, windows and enrichment of trips.

Each function takes and returns DataFrames, batch or (where Structured
Streaming allows the operators used) streaming with a watermark set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streamloom.functions import geo
from streamloom.operators.running import before


def cleanse(rides: DataFrame) -> DataFrame:
    """Rides that start and end in the city."""
    return rides.where(geo.in_nyc("start_lon", "start_lat") & geo.in_nyc("end_lon", "end_lat"))


def ride_count(rides: DataFrame) -> DataFrame:
    return rides.groupBy("driver_id").agg(F.count("*").alias("n"))


def ride_count_trace(rides: DataFrame) -> DataFrame:
    """The count after each record of a driver, in order of arrival."""
    return before(rides.select("event_id", "driver_id"), ["driver_id"], "event_id", {"n": ("sum", F.lit(1).cast("long"))}, inclusive=True)


def increment(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.col(column) + 1)


def tip_sums(fares: DataFrame, size: str = "1 hour") -> DataFrame:
    return fares.groupBy(F.window("event_time", size).alias("w"), "driver_id").agg(F.sum("tip").alias("tips"))


def max_tips(sums: DataFrame) -> DataFrame:
    """The driver of the largest sum of each window, the smallest id on ties."""
    best = sums.groupBy("w").agg(F.max(F.struct("tips", (-F.col("driver_id")).alias("back"))).alias("m"))
    return best.select(F.col("w.end").alias("window_end"), (-F.col("m.back")).alias("driver_id"), F.col("m.tips").alias("tips"))


def max_tips_stream(fares: DataFrame, size: str = "1 hour") -> DataFrame:
    """Both aggregations chained on a stream, in append mode."""
    sums = fares.groupBy(F.window("event_time", size), "driver_id").agg(F.sum("tip").alias("tips"))
    timed = sums.select(F.window_time("window").alias("at"), "driver_id", "tips")
    best = timed.groupBy(F.window("at", size).alias("w")).agg(F.max(F.struct("tips", (-F.col("driver_id")).alias("back"))).alias("m"))
    return best.select(F.col("w.end").alias("window_end"), (-F.col("m.back")).alias("driver_id"), F.col("m.tips").alias("tips"))


def _cell(coarse: int):
    lon = F.when(F.col("is_start"), F.col("start_lon")).otherwise(F.col("end_lon"))
    lat = F.when(F.col("is_start"), F.col("start_lat")).otherwise(F.col("end_lat"))
    cell = geo.grid_cell(lon, lat)
    if coarse > 1:
        x, y = cell % geo.CELLS_X, F.floor(cell / geo.CELLS_X)
        cell = ((x - x % coarse) + (y - y % coarse) * geo.CELLS_X).cast("int")
    return cell


def popular_places(rides: DataFrame, threshold: int = 20, size: str = "15 minutes", slide: str = "5 minutes", coarse: int = 1) -> DataFrame:
    """Cells with ``threshold`` or more starts, or ends, in a sliding window; ``coarse`` joins cells into squares."""
    counts = cleanse(rides).groupBy(F.window("event_time", size, slide).alias("w"), _cell(coarse).alias("cell"), "is_start").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= threshold).select(geo.cell_lon("cell").alias("lon"), geo.cell_lat("cell").alias("lat"), F.col("w.end").alias("window_end"), "is_start", "n")


def popular_places_fluent(rides: DataFrame, threshold: int = 20, size: str = "15 minutes", slide: str = "5 minutes", coarse: int = 1) -> DataFrame:
    """As popular_places, but more than ``threshold``, and with the window's start."""
    counts = cleanse(rides).groupBy(F.window("event_time", size, slide).alias("w"), _cell(coarse).alias("cell"), "is_start").agg(F.count("is_start").alias("n"))
    return counts.where(F.col("n") > threshold).select("cell", "is_start", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def popular_places_sql(spark: SparkSession, rides: str, threshold: int = 20, size: str = "15 minutes", slide: str = "5 minutes", coarse: int = 1) -> DataFrame:
    """The same over a table or view, in SQL."""
    geo.register(spark)
    return spark.sql(f"""
        SELECT cell, is_start, w.start AS window_start, w.end AS window_end, n FROM (
          SELECT (x - x % {coarse}) + (y - y % {coarse}) * {geo.CELLS_X} AS cell, is_start, w, count(is_start) AS n FROM (
            SELECT c % {geo.CELLS_X} AS x, c div {geo.CELLS_X} AS y, is_start, window(event_time, '{size}', '{slide}') AS w FROM (
              SELECT CASE WHEN is_start THEN to_cell_id(start_lon, start_lat) ELSE to_cell_id(end_lon, end_lat) END AS c, is_start, event_time
              FROM {rides} WHERE is_in_nyc(start_lon, start_lat) AND is_in_nyc(end_lon, end_lat)))
          GROUP BY (x - x % {coarse}) + (y - y % {coarse}) * {geo.CELLS_X}, is_start, w)
        WHERE n > {threshold}""")


def rides_per_hour(spark: SparkSession, rides: str) -> DataFrame:
    geo.register(spark)
    return spark.sql(f"SELECT is_start, w.start AS window_start, n FROM (SELECT is_start, window(event_time, '1 hour') AS w, count(is_start) AS n FROM {rides} WHERE is_in_nyc(start_lon, start_lat) AND is_in_nyc(end_lon, end_lat) GROUP BY is_start, window(event_time, '1 hour'))")


def join_fares(rides: DataFrame, fares: DataFrame) -> DataFrame:
    """START rides with their fare. Both sides are keyed by ride; a repeated key joins with each."""
    return rides.where("is_start").join(fares.drop("event_time", "taxi_id", "driver_id", "event_id"), "ride_id")


def kept_starts(rides: DataFrame) -> DataFrame:
    """START rides less those whose number a thousand divides, which stand for lost ones."""
    return rides.where("is_start and ride_id % 1000 <> 0")


def unmatched(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right.select("ride_id"), "ride_id", "left_anti")


def long_rides(rides: DataFrame, limit: str = "2 hours") -> DataFrame:
    """STARTs without an END up to ``limit`` later, the limit itself included."""
    ends = rides.where("not is_start").groupBy("ride_id").agg(F.min("event_time").alias("ended"))
    starts = rides.where("is_start")
    return starts.join(ends, "ride_id", "left").where(F.col("ended").isNull() | (F.col("ended") > F.col("event_time") + F.expr(f"interval {limit}"))).drop("ended")


def long_rides_pattern(rides: DataFrame, limit: str = "2 hours") -> DataFrame:
    """START strictly followed by END within the limit, by a ride's own order of events; time-outs are the result."""
    order = Window.partitionBy("ride_id").orderBy("event_time", F.col("is_start").desc())
    following = rides.select("*", F.lead("is_start").over(order).alias("next"), F.lead("event_time").over(order).alias("at"))
    done = ~F.col("next") & (F.col("at") <= F.col("event_time") + F.expr(f"interval {limit}"))
    return following.where(F.col("is_start") & ~F.coalesce(done, F.lit(False))).drop("next", "at")


def asof(trades: DataFrame, customers: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Each trade with the columns of the latest customer record of its key whose ``order`` is not greater.

    One sort of both sides by ranges of a key's order: no pairs are made, and a hot key spreads.
    """
    value = F.struct(*columns)
    right = customers.select(key, F.col(order).alias("__at"), F.lit(0).alias("__side"), value.alias("__value"), F.lit(None).cast(trades.select(F.struct(*trades.columns).alias("s")).schema["s"].dataType).alias("__own"))
    left = trades.select(key, F.col(order).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(customers.select(value.alias("s")).schema["s"].dataType).alias("__value"), F.struct(*trades.columns).alias("__own"))
    both = before(right.unionByName(left), [key], "__at", {"__seen": ("last", F.col("__value"))}, ties=("__side",), inclusive=True).where("__side = 1")
    return both.select("__own.*", *(F.col(f"__seen.{c}").alias(c) for c in columns))


def travel_time(rides: DataFrame) -> DataFrame:
    """Predicted minutes of each START from the ENDs that came before it to its cell, by direction.

    The model is a regression without intercept, kept as running sums: sum(x*y) / sum(x*x) over
    preceding ENDs; fewer than two give -1.
    """
    own = cleanse(rides)
    distance = geo.euclid_km("start_lon", "start_lat", "end_lon", "end_lat")
    # seen from the destination, so that a ride and its model agree whichever end is known
    angle = geo.direction_angle("end_lon", "end_lat", "start_lon", "start_lat")
    rows = own.select("event_id", "ride_id", "is_start", geo.grid_cell("end_lon", "end_lat").alias("cell"), geo.direction_bucket(angle).alias("bucket"), distance.alias("km"), ((F.unix_millis("end_time") - F.unix_millis("start_time")) / 60000.0).alias("minutes"))
    end = ~F.col("is_start")
    rows = before(rows, ["cell", "bucket"], "event_id", {name: ("sum", F.when(end, e)) for name, e in (("xy", F.col("km") * F.col("minutes")), ("xx", F.col("km") * F.col("km")), ("seen", F.lit(1).cast("long")))})
    guess = F.when((F.col("seen") < 2) | F.col("seen").isNull() | (F.col("xx") == 0), -1).otherwise((F.try_divide("xy", "xx") * F.col("km")).cast("int"))
    return rows.where("is_start").select("ride_id", guess.cast("int").alias("minutes"))
