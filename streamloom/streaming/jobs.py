"""Running streams: stateful queries, control planes, late rows, sinks and offline state."""

from __future__ import annotations

import contextlib
import io
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.functions import geo
from streamloom.functions.scalar import safe_predicate
from streamloom.operators.events import control_rows, latest
from streamloom.operators.running import before
from streamloom.streaming.processors import PairOnce

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a local one where that is unset, which only a local master can use."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if base is None and not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return f"{base or tempfile.mkdtemp(prefix='streams-')}/{uuid.uuid4()}"


def with_processor(df: DataFrame, keys: list[str], processor, time_mode: str = "EventTime", mode: str = "Append") -> DataFrame:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return df.groupBy(*keys).transformWithState(processor, processor.OUTPUT, mode, time_mode)


def sides(left: DataFrame, right: DataFrame, names: tuple[str, str], columns: list[str]) -> DataFrame:
    """Two inputs as one, each row tagged with its side; columns a side lacks are null."""
    parts = [df.select(*(F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns), F.lit(n).alias("side")) for df, n in ((left, names[0]), (right, names[1]))]
    return parts[0].unionByName(parts[1])


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there into a table in memory, for tests and small results."""
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def print_stream(df: DataFrame, checkpoint: str, mode: str = "append", rows: int = 20):
    """Start a query that prints each batch."""
    return df.writeStream.format("console").option("numRows", rows).option("truncate", False).outputMode(mode).option("checkpointLocation", checkpoint).start()


def write_each(df: DataFrame, sink: Callable, checkpoint: str, mode: str = "append"):
    """Start a query that gives each row to ``sink`` on the executors: a function, or an object with process and, if it likes, open and close."""
    return df.writeStream.foreach(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rebalanced(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly, whatever partitions they came in."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def counts_by_arrival(df: DataFrame, size: str = "1 second") -> DataFrame:
    """The number of rows that came in each window of processing time."""
    return df.withColumn("arrived", F.current_timestamp()).groupBy(F.window("arrived", size).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


def plan_of(df: DataFrame) -> str:
    """The physical plan, as text."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def parameters(arguments: list[str], defaults: dict[str, str] | None = None) -> dict[str, str]:
    """``--name value`` pairs of a command line; a name without a value is 'true'."""
    out, name = dict(defaults or {}), None
    for a in arguments:
        if a.startswith("--") and len(a) > 2 or a.startswith("-") and len(a) > 1 and not a[1].isdigit():
            name = a.lstrip("-")
            out[name] = "true"
        elif name is None:
            raise ValueError(f"a value without a name: {a}")
        else:
            out[name], name = a, None
    return out


def run_with_retries(start: Callable[[], object], attempts: int = 60, wait_s: float = 10.0) -> None:
    """Start a query again from its checkpoint when the stream fails, up to ``attempts`` times; other errors are the caller's."""
    for attempt in range(attempts):
        query = start()
        try:
            query.awaitTermination()
            return
        except StreamingQueryException:
            if attempt + 1 == attempts:
                raise
            time.sleep(wait_s)


class Versions:
    """Tables below a folder, one for each epoch, so that a batch that runs again finds what it found before."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def epochs(self) -> list[int]:
        path, files = self._files()
        if not files.exists(path):
            return []
        names = [s.getPath().getName() for s in files.listStatus(path)]
        new = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(n) for n in names if n.isdigit() and files.exists(new(f"{self.folder}/{n}/_SUCCESS")))

    def before(self, epoch: int) -> DataFrame | None:
        known = [e for e in self.epochs() if e < epoch]
        return self.spark.read.parquet(f"{self.folder}/{known[-1]}") if known else None

    def write(self, df: DataFrame, epoch: int) -> None:
        """Write an epoch's table and delete those that no batch can ask for any more."""
        df.write.mode("overwrite").parquet(f"{self.folder}/{epoch}")
        path, files = self._files()
        for old in [e for e in self.epochs() if e < epoch][:-1]:
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{old}"), True)


def _watermark(known: int | None, batch: DataFrame, time: str, delay_ms: int) -> int | None:
    newest = batch.agg(F.max(F.unix_millis(time))).first()[0]
    return known if newest is None else max(newest - delay_ms, known if known is not None else newest - delay_ms)


class LateSplitter:
    """foreachBatch function that parts rows at the watermark of all earlier batches.

    The engine drops late rows before user code sees them, so no watermark is set on the input; this one is the
    largest time of the batches before, less ``delay_ms``, and is written to ``folder`` with every batch, so it
    outlives a restart.
    """

    def __init__(self, spark: SparkSession, folder: str, time: str, delay_ms: int, on_time: Callable[[DataFrame], None], late: Callable[[DataFrame], None]):
        self.spark, self.versions, self.time, self.delay_ms, self.on_time, self.late = spark, Versions(spark, folder), time, delay_ms, on_time, late

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        known = self.versions.before(epoch)
        watermark = None if known is None else known.first()[0]
        batch = batch.persist()
        try:
            is_late = F.lit(False) if watermark is None else F.coalesce(F.unix_millis(self.time) <= watermark, F.lit(False))
            self.on_time(batch.where(~is_late))
            self.late(batch.where(is_late))
            now = _watermark(watermark, batch, self.time, self.delay_ms)
            if now is not None:
                self.versions.write(self.spark.createDataFrame([(now,)], "watermark long"), epoch)
        finally:
            batch.unpersist()


class ControlPlane:
    """foreachBatch function that keeps the latest record per ride as a table and answers questions to it.

    ``ask`` adds a predicate, checked by safe_predicate, over a record's columns and ``watermark``, in
    milliseconds: the largest time before the batch less ``delay_ms``. With the next batch, the stored records
    are tested once, and if it is ``standing`` the incoming ones from then on. Records, standing predicates and
    watermark are written with every batch, and a restart goes on with them. ``answer`` gets the predicate,
    'asked', 'stored' or 'incoming', and the rows.
    """

    def __init__(self, spark: SparkSession, folder: str, answer: Callable[[str, str, DataFrame], None], delay_ms: int = 60_000):
        self.spark, self.answer, self.delay_ms = spark, answer, delay_ms
        self.records, self.control = Versions(spark, f"{folder}/records"), Versions(spark, f"{folder}/control")
        self.fresh: list[tuple[str, bool]] = []

    def ask(self, predicate: str, standing: bool = True) -> None:
        self.fresh.append((predicate, standing))

    def ask_ongoing(self, minutes: int) -> None:
        """Rides whose latest record is a START of that many whole minutes before the watermark, or more."""
        self.ask(f"is_start and floor((watermark - unix_millis(event_time)) / 60000) >= {int(minutes)}", standing=False)

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        stored, control = self.records.before(epoch), self.control.before(epoch)
        known = [] if control is None else control.collect()
        watermark = next((r.watermark for r in known), None)
        standing = [r.predicate for r in known if r.predicate is not None]
        asked, self.fresh = self.fresh, []
        batch = batch.persist()
        try:
            def tested(rows: DataFrame, predicate: str) -> DataFrame:
                timed = rows.withColumn("watermark", F.lit(watermark).cast("long"))
                return timed.where(safe_predicate(predicate, timed.columns)).drop("watermark")

            for p, _ in asked:
                self.answer(p, "asked", self.spark.createDataFrame([("QUERY", p)], "kind string, query string"))
                if stored is not None:
                    self.answer(p, "stored", tested(stored, p))
            standing += [p for p, stands in asked if stands]
            for p in standing:
                self.answer(p, "incoming", tested(batch, p))
            self.records.write(latest(batch if stored is None else stored.unionByName(batch)), epoch)
            now = _watermark(watermark, batch, "event_time", self.delay_ms)
            self.control.write(self.spark.createDataFrame([(p, now) for p in standing or [None]], "predicate string, watermark long"), epoch)
        finally:
            batch.unpersist()


class NearestTaxis:
    """foreachBatch function that reports, for each standing query, every END nearer than all before it.

    ``ask`` adds a place; a query goes ``keep_query_ms`` of event time after it was asked, when another message
    comes (``collect`` is one that asks nothing). A query's least distance is forgotten ``keep_report_ms`` after
    its last report. Both tables are written with every batch. ``report`` gets query_id, taxi_id, km, event_time.
    """

    QUERY, LEAST = "query_id long, longitude float, latitude float, asked_ms long", "query_id long, least float, at_ms long"

    def __init__(self, spark: SparkSession, folder: str, report: Callable[[DataFrame], None], delay_ms: int = 60_000, keep_query_ms: int = 15 * 60_000, keep_report_ms: int = 8 * 3_600_000):
        self.spark, self.report, self.delay_ms, self.keep_query_ms, self.keep_report_ms = spark, report, delay_ms, keep_query_ms, keep_report_ms
        self.queries, self.least, self.clock = (Versions(spark, f"{folder}/{n}") for n in ("queries", "least", "clock"))
        self.fresh: list[tuple[int, float, float] | None] = []

    def ask(self, query_id: int, longitude: float, latitude: float) -> None:
        self.fresh.append((query_id, longitude, latitude))

    def collect(self) -> None:
        self.fresh.append(None)

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        queries, least, clock = (v.before(epoch) for v in (self.queries, self.least, self.clock))
        watermark = None if clock is None else clock.first()[0]
        queries = self.spark.createDataFrame([], self.QUERY) if queries is None else queries
        least = self.spark.createDataFrame([], self.LEAST) if least is None else least
        asked, self.fresh = self.fresh, []
        if asked:
            if watermark is not None:
                queries = queries.where(F.lit(watermark) - F.col("asked_ms") <= self.keep_query_ms)
            queries = queries.unionByName(self.spark.createDataFrame([(*q, watermark if watermark is not None else 0) for q in asked if q], self.QUERY))
        if watermark is not None:
            least = least.where(F.col("at_ms") + self.keep_report_ms > watermark)
        batch = batch.persist()
        try:
            queries = control_rows(queries)
            near = batch.where("not is_start").join(queries).select("query_id", "taxi_id", "event_time", "ride_id", geo.euclid_km("end_lon", "end_lat", "longitude", "latitude").cast("float").alias("km"))
            seen = before(near.join(least.withColumnRenamed("query_id", "known_id"), F.col("query_id") == F.col("known_id"), "left"), ["query_id"], "event_time", {"so_far": ("min", F.col("km"))}, ties=("ride_id",))
            minima = seen.where("km < least(coalesce(so_far, float('infinity')), coalesce(least, float('infinity')))").select("query_id", "taxi_id", "km", "event_time")
            minima = minima.persist()
            self.report(minima)
            last = minima.groupBy("query_id").agg(F.min("km").alias("least"), F.max(F.unix_millis("event_time")).alias("at_ms"))
            kept = least.join(last, "query_id", "left_anti").unionByName(last)
            self.least.write(kept, epoch)
            self.queries.write(queries, epoch)
            now = _watermark(watermark, batch, "event_time", self.delay_ms)
            if now is not None:
                self.clock.write(self.spark.createDataFrame([(now,)], "watermark long"), epoch)
            minima.unpersist()
        finally:
            batch.unpersist()


def ride_fare_stream(rides: DataFrame, fares: DataFrame, expires: bool = False) -> DataFrame:
    both = sides(rides, fares, ("ride", "fare"), ["ride_id", "event_time", "tip"])
    return with_processor(both.withColumn("tip", F.col("tip").cast("double")), ["ride_id"], PairOnce(expires), "EventTime" if expires else "None")


def read_state(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    return spark.read.format("statestore").option("stateVarName", variable).load(checkpoint)


def snapshot_of_unmatched(spark: SparkSession, rides: DataFrame, fares: DataFrame, folder: str) -> DataFrame:
    """Run the pairing over stored tables as a stream, then read what waits in its checkpoint."""
    for name, df in (("rides", rides.select("ride_id", "event_time")), ("fares", fares.select("ride_id", "event_time", F.col("tip").cast("double").alias("tip")))):
        df.write.parquet(f"{folder}/{name}")
    streams = {n: spark.readStream.schema(spark.read.parquet(f"{folder}/{n}").schema).parquet(f"{folder}/{n}") for n in ("rides", "fares")}
    out = ride_fare_stream(streams["rides"], streams["fares"])
    out.writeStream.format("parquet").option("path", f"{folder}/matched").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    ride = read_state(spark, f"{folder}/state", "saved_ride").select(F.col("key.ride_id").alias("ride_id"), F.col("value.event_time").alias("saved_ride"))
    fare = read_state(spark, f"{folder}/state", "saved_fare").select(F.col("key.ride_id").alias("ride_id"), F.col("value.tip").alias("saved_fare"))
    return ride.join(fare, "ride_id", "full")
