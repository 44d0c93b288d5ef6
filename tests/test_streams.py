"""The same questions asked of streams; a record far ahead on a key of its own closes what is open."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from streamloom.operators import events as ev
from streamloom.operators import trips as tr
from streamloom.streaming import jobs
from streamloom.streaming import processors as pr

T0 = datetime(2020, 1, 1, 12)
FAR = T0 + timedelta(days=30)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


@pytest.fixture
def stream(spark, tmp_path):
    def make(name, batches, schema):
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")

    return make


def result(spark, df, tmp_path, name):
    jobs.run_once(df, name, f"{tmp_path}/check_{name}")
    return spark.table(name)


RIDES = "ride_id long, is_start boolean, event_time timestamp"


def test_long_rides_equal_batch(spark, stream, tmp_path):
    rows = [(1, True, at(0)), (2, True, at(1)), (2, False, at(120)), (3, True, at(2)), (3, False, at(123)), (4, False, at(30)), (4, True, at(3)), (5, False, at(60)), (5, True, at(0))]
    s = stream("rides", [rows, [(99, False, FAR)]], RIDES).withWatermark("event_time", "0 seconds")
    got = result(spark, jobs.with_processor(s, ["ride_id"], pr.LongRides()), tmp_path, "long_rides")
    want = tr.long_rides(spark.createDataFrame(rows, RIDES))
    assert sorted(r.ride_id for r in got.collect()) == sorted(r.ride_id for r in want.collect()) == [1, 3]


def test_pairs_expire(spark, stream, tmp_path):
    schema = "ride_id long, event_time timestamp, tip double"
    rides = stream("r", [[(1, at(0), None), (2, at(1), None)], [(98, FAR, None)]], schema).withWatermark("event_time", "0 seconds")
    fares = stream("f", [[(1, at(0), 5.0), (3, at(1), 6.0)], [(99, FAR, 1.0)]], schema).withWatermark("event_time", "0 seconds")
    got = result(spark, jobs.ride_fare_stream(rides, fares, expires=True), tmp_path, "pairs")
    assert sorted((r.ride_id, r.kind) for r in got.where("ride_id < 90").collect()) == [(1, "matched"), (2, "unmatched_ride"), (3, "unmatched_fare")]


def test_asof_takes_the_record_in_force(spark, stream, tmp_path):
    schema = "customer_id long, event_time timestamp, info string, side string"
    rows = [(0, at(0), "c0", "customer"), (0, at(10), "t10", "trade"), (0, at(12), "c12", "customer"), (0, at(12), "t12", "trade"), (1, at(5), "t5", "trade")]
    s = stream("asof", [rows, [(99, FAR, "x", "customer")]], schema).withWatermark("event_time", "0 seconds")
    got = result(spark, jobs.with_processor(s, ["customer_id"], pr.AsOf()), tmp_path, "asof")
    assert sorted((r.trade, r.customer) for r in got.collect()) == [("t10", "c0"), ("t12", "c12"), ("t5", None)]


def test_asof_answers_at_once_and_corrects(spark, stream, tmp_path):
    schema = "customer_id long, event_time timestamp, info string, side string"
    batches = [[(0, at(0), "c0", "customer"), (0, at(10), "t10", "trade")], [(0, at(5), "c5", "customer"), (0, at(12), "t12", "trade")], [(99, FAR, "x", "customer")], [(99, FAR + timedelta(days=1), "x", "customer")]]
    s = stream("updates", batches, schema).withWatermark("event_time", "1 hour")
    got = result(spark, jobs.with_processor(s, ["customer_id"], pr.AsOfUpdates()), tmp_path, "updates").where("customer_id = 0")
    assert sorted((r.trade, r.customer, r.is_final) for r in got.collect()) == [("t10", "c0", False), ("t10", "c5", True), ("t12", "c5", False)]


def test_sinks_and_plans(spark, stream, tmp_path):
    s = stream("sink", [[(1, True, at(0)), (2, False, at(1))]], RIDES)
    printed = jobs.print_stream(s, f"{tmp_path}/p")
    printed.processAllAvailable()
    assert any("Console" in p["sink"]["description"] and p["numInputRows"] for p in printed.recentProgress)
    folder = str(tmp_path)

    def sink(row):
        with open(f"{folder}/row{row.ride_id}", "w") as f:
            f.write("x")

    jobs.write_each(s, sink, f"{tmp_path}/w").awaitTermination()
    assert (tmp_path / "row1").exists() and (tmp_path / "row2").exists()
    jobs.run_once(jobs.counts_by_arrival(s, "1 hour"), "arrivals", f"{tmp_path}/a", mode="update")
    assert sum(r.n for r in spark.table("arrivals").collect()) == 2
    assert "Scan" in jobs.plan_of(spark.read.schema(RIDES).parquet(f"{tmp_path}/sink")) and jobs.rebalanced(spark.range(10).coalesce(1)).count() == 10
    for q in spark.streams.active:
        q.stop()


def test_parameters():
    assert jobs.parameters(["--input", "x", "-speed", "-5", "--fast"], {"output": "y"}) == {"input": "x", "speed": "-5", "fast": "true", "output": "y"}
    with pytest.raises(ValueError):
        jobs.parameters(["x"])


def test_segments_and_order(spark, stream, tmp_path):
    schema = "car_id string, event_time timestamp, speed double, throttle double, event_id long"
    rows = [("a", at(m), v, float(m), m) for m, v in ((3, 5.0), (1, 2.0), (2, 9.0), (4, 0.0), (5, 7.0), (6, 0.0), (7, 1.0))]
    s = stream("cars", [rows, [("z", FAR, 1.0, 0.0, 99)]], schema).withWatermark("event_time", "0 seconds")
    got = result(spark, jobs.with_processor(s, ["car_id"], pr.StoppedSegments()), tmp_path, "segments").collect()
    want = ev.stopped_segments(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.start_time, r.length, r.max_speed, round(r.erraticness, 9)) for r in got) == sorted((r.start_time, r.length, r.max_speed, round(r.erraticness, 9)) for r in want)
    ordered = result(spark, jobs.with_processor(s, ["car_id"], pr.TimeSort()), tmp_path, "ordered").where("car_id = 'a'").collect()
    assert [r.event_time for r in ordered] == [at(m) for m in range(1, 8)]


def test_tips_chain_two_aggregates(spark, stream, tmp_path):
    schema = "driver_id long, event_time timestamp, tip float"
    rows = [(1, at(1), 1.0), (1, at(2), 2.0), (2, at(3), 2.5), (2, at(61), 4.0), (1, at(62), 4.0)]
    s = stream("fares", [rows, [(9, FAR, 0.0)], [(9, FAR + timedelta(hours=3), 0.0)]], schema).withWatermark("event_time", "0 seconds")
    got = result(spark, tr.max_tips_stream(s), tmp_path, "tips").where(F.col("driver_id") < 9)
    assert sorted((r.window_end, r.driver_id, r.tips) for r in got.collect()) == [(at(60), 1, 3.0), (at(120), 1, 4.0)]


def test_late_rows_are_kept_apart(spark, stream, tmp_path):
    on_time, late = [], []
    split = lambda: jobs.LateSplitter(spark, f"{tmp_path}/marks", "event_time", 60_000, lambda df: on_time.extend(r.ride_id for r in df.collect()), lambda df: late.extend(r.ride_id for r in df.collect()))
    s = stream("late", [[(1, True, at(10))], [(2, True, at(5)), (3, True, at(11))]], RIDES)
    s.writeStream.foreachBatch(split()).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted(on_time + late) == [1, 2, 3] and set(late) <= {1, 2} and late
    # a new one goes on from the watermark that the last one wrote
    split()(spark.createDataFrame([(4, True, at(9)), (5, True, at(12))], RIDES), 7)
    assert 4 in late and 5 in on_time


def test_rules(spark, stream, tmp_path):
    rules = [("r1", "a", "b"), ("r2", "c", "c")]
    rows = [(0, "a", 1), (0, "a", 2), (0, "b", 3), (0, "b", 4), (0, "c", 5), (0, "c", 6), (0, "c", 7)]
    s = stream("items", [rows], "colour long, shape string, seq long")
    got = result(spark, jobs.with_processor(s, ["colour"], pr.RuleMatches(rules), "None"), tmp_path, "rules").collect()
    want = ev.rule_matches(spark.createDataFrame(rows, "colour long, shape string, seq long"), spark.createDataFrame(rules, "rule string, first string, second string")).collect()
    key = lambda r: (r.rule, r.opened_by, r.closed_by)
    assert sorted(map(key, got)) == sorted(map(key, want)) == [("r1", 1, 3), ("r1", 2, 3), ("r2", 5, 6), ("r2", 6, 7)]


def answers_of(spark, folder, answers):
    return jobs.ControlPlane(spark, folder, lambda p, kind, df: answers.append((kind, sorted(r[0] for r in df.collect()))), delay_ms=0)


def test_control_plane_outlives_a_restart(spark, stream, tmp_path):
    answers = []
    plane = answers_of(spark, f"{tmp_path}/latest", answers)
    s = stream("control", [[(1, True, at(0)), (2, True, at(0)), (2, False, at(5))]], RIDES)
    s.writeStream.foreachBatch(plane).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    plane.ask("is_start")
    plane(spark.createDataFrame([(3, True, at(6))], RIDES), 7)
    assert answers == [("asked", ["QUERY"]), ("stored", [1]), ("incoming", [3])]
    again = answers_of(spark, f"{tmp_path}/latest", answers := [])
    again.ask_ongoing(6)
    again(spark.createDataFrame([(4, True, at(7)), (3, False, at(8))], RIDES), 8)
    assert answers == [("asked", ["QUERY"]), ("stored", [1]), ("incoming", [4])]
    # the same batch again, after a failure, finds what it found before
    again(spark.createDataFrame([(4, True, at(7))], RIDES), 8)
    assert answers[3:] == [("incoming", [4])] and len(again.records.epochs()) == 2
    again.ask("unix_millis(event_time) > watermark")
    again(spark.createDataFrame([(5, True, at(9)), (6, True, at(1))], RIDES), 9)
    assert answers[-1] == ("incoming", [5]) and ("stored", []) in answers
    with pytest.raises(ValueError):
        again.ask("reflect('a')")
        again(spark.createDataFrame([(3, True, at(6))], RIDES), 10)


def test_ad_hoc_distance(spark, tmp_path):
    """A ride from Penn Station to MoMA; its END is within a kilometre of MoMA."""
    answers = []
    plane = answers_of(spark, f"{tmp_path}/latest", answers)
    plane.ask("not is_start and sqrt((end_lon + 73.9776) * (end_lon + 73.9776) + (end_lat - 40.7614) * (end_lat - 40.7614)) * 110.25 < 1.0")
    plane.ask("is_start")
    rides = [(1, True, at(0), -73.9776, 40.7614), (1, False, at(5), -73.9776, 40.7614)]
    plane(spark.createDataFrame(rides, RIDES + ", end_lon float, end_lat float"), 0)
    assert [x for x in answers if x[0] == "incoming"] == [("incoming", [1])] * 2


def test_nearest_taxis_forget(spark, tmp_path):
    reports = []
    new = lambda: jobs.NearestTaxis(spark, f"{tmp_path}/near", lambda df: reports.append(sorted((r.query_id, r.taxi_id) for r in df.collect())), delay_ms=0)
    schema = RIDES + ", taxi_id long, end_lon float, end_lat float"
    end = lambda ride, minute, taxi, lat: (ride, False, at(minute), taxi, -74.0, lat)
    plane = new()
    plane.ask(1, -74.0, 40.7)
    plane(spark.createDataFrame([end(1, 0, 11, 40.9), end(2, 1, 12, 40.8), end(3, 2, 13, 40.85), (4, True, at(2), 14, -74.0, 40.7)], schema), 0)
    plane = new()
    plane(spark.createDataFrame([end(5, 3, 15, 40.85), end(6, 4, 16, 40.75)], schema), 1)
    plane(spark.createDataFrame([end(7, 9 * 60, 17, 40.95)], schema), 2)
    # eight hours without a report: the least distance is forgotten, the query stands until a message comes
    plane(spark.createDataFrame([end(8, 9 * 60 + 1, 18, 40.99)], schema), 3)
    plane.collect()
    plane(spark.createDataFrame([end(9, 9 * 60 + 2, 19, 40.7)], schema), 4)
    assert reports == [[(1, 11), (1, 12)], [(1, 16)], [], [(1, 18)], []]


def test_retries_stop_at_other_errors():
    def broken():
        raise KeyError("the caller's")

    with pytest.raises(KeyError):
        jobs.run_with_retries(broken, attempts=3, wait_s=0)


def test_popular_places_of_the_city(spark):
    """Three starts at Penn Station and three ends at MoMA, in windows of 15 minutes every 5."""
    penn, moma = (-73.9947, 40.750626), (-73.9776, 40.7614)
    rows = [(i, True, at(m), *penn, *moma) for i, m in enumerate((0, 6, 14))] + [(i, False, at(15), *penn, *moma) for i in range(3)]
    rides = spark.createDataFrame(rows, "ride_id long, is_start boolean, event_time timestamp, start_lon float, start_lat float, end_lon float, end_lat float")
    got = sorted((r.is_start, r.window_end, r.n) for r in tr.popular_places(rides, threshold=2).collect())
    assert got == [(False, at(20), 3), (False, at(25), 3), (False, at(30), 3), (True, at(10), 2), (True, at(15), 3), (True, at(20), 2)]


def test_as_of_scripted_feeds(spark):
    from streamloom.sources import ingest

    got = tr.asof(ingest.simulated_trades(spark), ingest.simulated_customers(spark), "customer_id", "event_time", ["customer_info"])
    assert [r.customer_info.split()[-1] for r in got.orderBy("event_time").collect()] == ["500", "500", "1500", "1600", "1600", "1600"]


def test_state_snapshot_equals_the_batch_answer(spark):
    from streamloom.plans import catalogue

    d = "/root/testdata/sf0.001"
    got = catalogue.QUERIES["state_snapshot"](spark, d)
    rides, fares = (set(r.ride_id for r in f(spark, d).where(w).collect()) for f, w in ((catalogue.rides, "is_start"), (catalogue.fares, "true")))
    rows = got.collect()
    assert {r.ride_id for r in rows if r.saved_ride is not None} == rides - fares and {r.ride_id for r in rows if r.saved_fare is not None} == fares - rides
