import pytest
from pyspark.sql import functions as F

from streamloom.functions import geo
from streamloom.functions.scalar import safe_predicate
from streamloom.sources import ingest


def test_ride_lines(spark):
    lines = spark.createDataFrame([
        ("1,START,2013-01-01 00:00:00,1970-01-01 00:00:00,-73.9,40.7,,40.8,2,11,12",),
        ("1,END,2013-01-01 00:10:00,2013-01-01 00:00:00,-73.9,40.7,-73.8,40.8,2,11,12",),
        ("1,STOP,2013-01-01 00:10:00,2013-01-01 00:00:00,-73.9,40.7,-73.8,40.8,2,11,12",),
        ("too,short",),
        (None,),
    ], "value string")
    start, end, *bad = ingest.parse_rides(lines).collect()
    assert start.is_start and start.end_lon == 0 and start.end_time.year == 1970
    assert not end.is_start and end.end_time > end.start_time
    assert [b.ride_id for b in bad] == [None] * 3 and bad[1].malformed == "too,short"


def test_fare_lines(spark):
    good, bad = ingest.parse_fares(spark.createDataFrame([("1,2,3,2013-01-01 00:00:00,CSH,,1.5,10",), ("1,2,3",)], "value string")).collect()
    assert (good.tip, good.tolls, good.total_fare) == (0, 1.5, 10) and bad.malformed == "1,2,3"


def test_options():
    assert ingest.validate_options({"path": "x"}) == {"path": "x", "max_event_delay_secs": 0, "serving_speed_factor": 1}
    for bad in ({}, {"path": "x", "max_event_delay_secs": "-1"}, {"path": "x", "serving_speed_factor": "0"}, {"path": "x", "serving_speed_factor": "fast"}):
        with pytest.raises(ingest.InvalidOptions):
            ingest.validate_options(bad)


def test_predicates():
    for bad in ("reflect('java.lang.System', 'exit')", "java_method('a', 'b')", "unknown > 1", "is_start; drop", "x in (select 1)", "`x` = 1", "x = '\\\\' or java_method('java.lang.System', 'nanoTime') > '0'", "x = r'\\\\'", "x = '\\\\'"):
        with pytest.raises(ValueError):
            safe_predicate(bad, ["is_start", "x"])


def test_predicates_hold_no_comment(spark):
    df = spark.createDataFrame([(5, 1)], "x int, y int")
    assert df.where(safe_predicate("x --1 = 6 and y == 1", df.columns)).count() == 1
    assert df.where(safe_predicate("x /2 * 2 = 5 and 'it''s' <> '--'", df.columns)).count() == 1


def test_sql_functions_agree(spark):
    geo.register(spark)
    df = spark.createDataFrame([(-73.99, 40.75), (-73.0, 40.75), (-74.0, 41.0)], "lon float, lat float")
    both = df.select(geo.in_nyc("lon", "lat").alias("a"), F.expr("is_in_nyc(lon, lat)").alias("b"), geo.grid_cell("lon", "lat").alias("c"), F.expr("to_cell_id(lon, lat)").alias("d"))
    assert all(r.a == r.b and r.c == r.d for r in both.collect())
    assert [r.a for r in both.collect()] == [True, False, True]
