"""CSV records to columns and back, readers for batch and stream, and their options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Fixed value: the records' time pattern, in UTC.
TIME = "yyyy-MM-dd HH:mm:ss"


class InvalidOptions(ValueError):
    pass


def validate_options(options: dict[str, str]) -> dict[str, object]:
    """path is required; max_event_delay_secs is 0 or more; serving_speed_factor is 1 or more."""
    if not options.get("path"):
        raise InvalidOptions("path is required")
    out: dict[str, object] = {"path": options["path"]}
    for name, default, least in (("max_event_delay_secs", 0, 0), ("serving_speed_factor", 1, 1)):
        try:
            out[name] = int(options.get(name, default))
        except ValueError as e:
            raise InvalidOptions(f"{name} must be a whole number") from e
        if out[name] < least:
            raise InvalidOptions(f"{name} must be {least} or more")
    return out


def _tokens(value: Column, n: int, pattern: str = ",") -> Column:
    parts = F.split(value, pattern, -1)
    return F.when(F.size(parts) == n, parts)


def _number(c: Column) -> Column:
    return F.coalesce(F.when(c != "", c).try_cast("float"), F.lit(0.0).cast("float"))


def parse_rides(lines: DataFrame, value: str = "value") -> DataFrame:
    """Rides from 11 comma-separated fields; END rows give the end time first.

    ``malformed`` holds a line that is none: a wrong number of fields, or neither START nor END.
    """
    t = F.col("__t")
    start = t[1] == "START"
    good = t.isNotNull() & t[1].isin("START", "END")
    when = lambda i: F.try_to_timestamp(t[i], F.lit(TIME))
    number = lambda i: _number(t[i])
    return lines.withColumn("__t", _tokens(F.col(value), 11)).select(
        F.when(good, t[0].try_cast("long")).alias("ride_id"),
        F.when(good, start).alias("is_start"),
        F.when(good, F.when(start, when(2)).otherwise(when(3))).alias("start_time"),
        F.when(good, F.when(start, when(3)).otherwise(when(2))).alias("end_time"),
        *(F.when(good, number(i)).alias(c) for i, c in ((4, "start_lon"), (5, "start_lat"), (6, "end_lon"), (7, "end_lat"))),
        F.when(good, t[8].try_cast("short")).alias("passenger_cnt"),
        F.when(good, t[9].try_cast("long")).alias("taxi_id"),
        F.when(good, t[10].try_cast("long")).alias("driver_id"),
        F.when(~F.coalesce(good, F.lit(False)), F.col(value)).alias("malformed"),
    )


def parse_fares(lines: DataFrame, value: str = "value") -> DataFrame:
    t = F.col("__t")
    return lines.withColumn("__t", _tokens(F.col(value), 8)).select(
        *(t[i].try_cast("long").alias(c) for i, c in ((0, "ride_id"), (1, "taxi_id"), (2, "driver_id"))),
        F.try_to_timestamp(t[3], F.lit(TIME)).alias("start_time"),
        t[4].alias("payment_type"),
        *(F.when(t.isNotNull(), _number(t[i])).alias(c) for i, c in ((5, "tip"), (6, "tolls"), (7, "total_fare"))),
        F.when(t.isNull(), F.col(value)).alias("malformed"),
    )


def parse_car_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Vehicle telemetry from 23 fields between commas or semicolons."""
    t = F.col("__t")
    return lines.withColumn("__t", _tokens(F.col(value), 23, r"[,;]\s*")).select(
        t[1].alias("id"),
        t[0].alias("car_id"),
        t[22].try_cast("timestamp").alias("event_time"),
        *(t[i].try_cast("float").alias(c) for i, c in ((20, "longitude"), (21, "latitude"), (7, "consumption"), (9, "speed"), (12, "throttle"), (19, "engine_load"))),
        F.when(t.isNull(), F.col(value)).alias("malformed"),
    )


def parse_query(value: Column) -> Column:
    """struct(longitude, latitude) from 'lon, lat'."""
    t = F.split(value, r",\s*")
    return F.struct(t[0].try_cast("float").alias("longitude"), t[1].try_cast("float").alias("latitude"))


def format_ride() -> Column:
    """The CSV line that parse_rides reads back."""
    start, end = (F.date_format(c, TIME) for c in ("start_time", "end_time"))
    number = lambda c: F.col(c).cast("string")
    return F.concat_ws(",", number("ride_id"), F.when(F.col("is_start"), "START").otherwise("END"), F.when(F.col("is_start"), start).otherwise(end), F.when(F.col("is_start"), end).otherwise(start), *(number(c) for c in ("start_lon", "start_lat", "end_lon", "end_lat", "passenger_cnt", "taxi_id", "driver_id")))


def format_fare() -> Column:
    return F.concat_ws(",", *(F.col(c).cast("string") for c in ("ride_id", "taxi_id", "driver_id")), F.date_format("start_time", TIME), "payment_type", *(F.col(c).cast("string") for c in ("tip", "tolls", "total_fare")))


def ride_event_time() -> Column:
    return F.when(F.col("is_start"), F.col("start_time")).otherwise(F.col("end_time"))


def read_rides(spark: SparkSession, **options: str) -> DataFrame:
    return parse_rides(spark.read.text(validate_options(options)["path"])).withColumn("event_time", ride_event_time())


def read_fares(spark: SparkSession, **options: str) -> DataFrame:
    return parse_fares(spark.read.text(validate_options(options)["path"])).withColumn("event_time", F.col("start_time"))


def stream_rides(spark: SparkSession, *, files_per_batch: int = 1, **options: str) -> DataFrame:
    """Rides as files arrive (plain or gzip), with the watermark that the delay asks for."""
    checked = validate_options(options)
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(checked["path"])
    return parse_rides(lines).withColumn("event_time", ride_event_time()).withWatermark("event_time", f"{checked['max_event_delay_secs']} seconds")


def stream_fares(spark: SparkSession, *, files_per_batch: int = 1, **options: str) -> DataFrame:
    checked = validate_options(options)
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(checked["path"])
    return parse_fares(lines).withColumn("event_time", F.col("start_time")).withWatermark("event_time", f"{checked['max_event_delay_secs']} seconds")


def stream_car_events(spark: SparkSession, path: str) -> DataFrame:
    return parse_car_events(spark.readStream.text(path)).withWatermark("event_time", "30 seconds")


def control_lines(spark: SparkSession, host: str = "localhost", port: int = 9999) -> DataFrame:
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def random_longs(spark: SparkSession, rows_per_second: int = 100) -> DataFrame:
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select("timestamp", F.xxhash64("value").alias("value"))


def jittered_events(spark: SparkSession, rows_per_second: int = 100, jitter_ms: int = 1000, partitions: int = 3, skew_ms: int = 0, users: int = 6) -> DataFrame:
    """Events out of order: each up to jitter_ms late, each partition skew_ms later than the one before."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    part = F.col("value") % partitions
    late = F.floor(F.rand() * jitter_ms) + part * skew_ms
    return rows.select(F.timestamp_millis(F.unix_millis("timestamp") - late).alias("event_time"), F.concat(F.lit("U"), (F.col("value") % users).cast("string")).alias("user_id"), part.alias("partition"))


def trips_to_rides(trips: DataFrame) -> DataFrame:
    """A START and an END record of each trip; a START's end time is the epoch."""
    epoch = F.timestamp_seconds(F.lit(0))
    kinds = F.array(F.struct(F.lit(True).alias("is_start"), F.col("pickup").alias("event_time"), epoch.alias("end_time")), F.struct(F.lit(False).alias("is_start"), F.col("dropoff").alias("event_time"), F.col("dropoff").alias("end_time")))
    return trips.withColumn("e", F.explode(kinds)).select("trip_id", "e.is_start", "e.event_time", F.col("pickup").alias("start_time"), "e.end_time", "driver_id")


def trips_to_fares(trips: DataFrame) -> DataFrame:
    """The fare of each trip; the total is fare, tip and tolls."""
    return trips.select(F.col("trip_id").alias("ride_id"), "driver_id", F.col("pickup").alias("start_time"), "payment_type", "tip", "tolls", (F.col("fare") + F.col("tip") + F.col("tolls")).alias("total_fare"))


def simulated_customers(spark: SparkSession) -> DataFrame:
    """Scripted updates of one customer, as (seconds, info)."""
    rows = [(0, 0, "Customer A, updated at 0"), (0, 500, "Customer A, updated at 500"), (0, 1500, "Customer A, updated at 1500"), (0, 1600, "Customer A, updated at 1600"), (0, 2100, "Customer A, updated at 2100")]
    return spark.createDataFrame(rows, "customer_id long, ms long, customer_info string").select(F.timestamp_millis("ms").alias("event_time"), "customer_id", "customer_info")


def simulated_trades(spark: SparkSession) -> DataFrame:
    """Scripted trades of the same customer."""
    rows = [(0, ms, f"trade at {ms}") for ms in (1000, 1200, 1500, 1700, 1800, 2000)]
    return spark.createDataFrame(rows, "customer_id long, ms long, trade_info string").select(F.timestamp_millis("ms").alias("event_time"), "customer_id", "trade_info")
