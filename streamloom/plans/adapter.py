"""Trips, fares and vehicle events as views of the ``events`` table, in SQL that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _coordinate(origin: str, factor: int, cells: int) -> str:
    return f"CAST(CAST({origin} AS DOUBLE) + ((event_id * {factor}) % {cells}) * CAST(0.001 AS DOUBLE) AS FLOAT)"


RIDES = f"""
SELECT event_id, CAST((event_id - event_id % 64) / 2 AS BIGINT) + event_id % 32 AS ride_id, event_id % 64 < 32 AS is_start, ts AS event_time,
  {_coordinate("-74.06", 37, 400)} AS start_lon, {_coordinate("40.45", 53, 600)} AS start_lat,
  {_coordinate("-74.06", 41, 400)} AS end_lon, {_coordinate("40.45", 59, 600)} AS end_lat,
  user_id AS taxi_id, user_id AS driver_id, ts AS start_time, ts + INTERVAL '1' MINUTE * CAST(event_id % 90 + 1 AS INT) AS end_time
FROM events WHERE event_id % 64 < 32 OR event_type <> 'error'"""
FARES = """
SELECT event_id, CAST((event_id - event_id % 64) / 2 AS BIGINT) + event_id % 32 AS ride_id, user_id AS taxi_id, user_id AS driver_id, ts AS event_time, value AS tip
FROM events WHERE event_id % 64 < 32 AND event_id % 10 <> 3"""
CARS = """
SELECT event_id, user_id AS car_id, ts AS event_time, CASE WHEN event_type = 'error' THEN CAST(0 AS DOUBLE) ELSE value END AS speed, value AS throttle
FROM events"""


def _view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))


def rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, RIDES)


def fares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, FARES)


def cars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, CARS)
