"""Streams over the events table, run until all of it is read, with what they have written as the result.

The table's times have no zone and can't carry a watermark, so they are cast to
timestamps of the session, which must be in UTC. In append mode a window is
written once the watermark has passed it; the queries here use complete mode, or
a second input that closes the last window, so that the result doesn't hang on
where the data ends.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkloom.plans.registry import query, table
from sparkloom.sources.formats import scratch


def stream(spark: SparkSession, d: str) -> DataFrame:
    """events as a stream with a watermark of an hour."""
    schema = table(spark, d, "events").schema
    raw = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")


def finished(df: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all there is: of complete and update mode the last state of the result, of append all rows."""
    spark = df.sparkSession
    out, last = scratch(spark, "stream"), {}

    def put(batch: DataFrame, number: int) -> None:
        if mode != "complete":
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        elif not batch.isEmpty():
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
            last["batch"] = number

    df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", scratch(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    path = f"{out}/batch={last['batch']}" if mode == "complete" and last else f"{out}/batch=*"
    return spark.read.schema(df.schema).parquet(path)


def windowed(df: DataFrame, window) -> DataFrame:
    return df.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"))


def ends(df: DataFrame) -> DataFrame:
    return df.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return ends(finished(windowed(stream(spark, d), F.window("ts", "1 day")), "complete"))


@query("stream_sliding", "SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 12 HOURS, ts), time_bucket(INTERVAL 12 HOURS, ts) - INTERVAL 12 HOURS]) AS s FROM events) GROUP BY ALL")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    return ends(finished(windowed(stream(spark, d), F.window("ts", "1 day", "12 hours")), "complete"))


@query("stream_session", "SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(g) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS g FROM events)) GROUP BY ALL) GROUP BY user_id")
def stream_session(spark: SparkSession, d: str) -> DataFrame:
    sessions = stream(spark, d).groupBy(F.session_window("ts", "12 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return finished(sessions, "complete").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


@query("stream_complete", "SELECT event_type, count(*) AS n, round(max(value), 6) AS m FROM events GROUP BY event_type")
def stream_complete(spark: SparkSession, d: str) -> DataFrame:
    return finished(stream(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.max("value"), 6).alias("m")), "complete")


@query("stream_dedup", "SELECT DISTINCT user_id FROM events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    return finished(stream(spark, d).select("user_id").dropDuplicates(), "append")


@query("stream_static_join", "SELECT event_id, c_mktsegment FROM events JOIN customer ON user_id = c_custkey")
def stream_static_join(spark: SparkSession, d: str) -> DataFrame:
    return finished(stream(spark, d).join(table(spark, d, "customer"), F.col("user_id") == F.col("c_custkey")).select("event_id", "c_mktsegment"), "append")


@query("stream_stream_join", "SELECT a.event_id AS view, b.event_id AS purchase FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 6 HOURS WHERE a.event_type = 'view' AND b.event_type = 'purchase'")
def stream_stream_join(spark: SparkSession, d: str) -> DataFrame:
    a = stream(spark, d).where("event_type = 'view'").select(F.col("event_id").alias("view"), F.col("user_id").alias("u"), F.col("ts").alias("t"))
    b = stream(spark, d).where("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), "user_id", "ts")
    return finished(a.join(b, F.expr("u = user_id AND ts BETWEEN t AND t + INTERVAL 6 HOURS")).select("view", "purchase"), "append")


@query("stream_late_free_append", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events WHERE ts < (SELECT time_bucket(INTERVAL 1 DAY, max(ts)) FROM events) GROUP BY ALL")
def stream_append(spark: SparkSession, d: str) -> DataFrame:
    """Append mode; the window that the watermark hasn't passed isn't written, nor are those that end within its hour."""
    got = ends(finished(windowed(stream(spark, d), F.window("ts", "1 day")), "append"))
    last = table(spark, d, "events").agg(F.date_trunc("day", F.max("ts")).cast("timestamp_ntz").alias("last"))
    return got.join(F.broadcast(last), F.col("start") < F.col("last")).drop("last")


@query("stream_state", "SELECT user_id, count(*) AS n, max(value) AS top FROM events GROUP BY user_id")
def stream_state(spark: SparkSession, d: str) -> DataFrame:
    """Arbitrary state per user: a count and a maximum, in update mode; of each user the last row."""
    return largest_by_user(stream(spark, d))


def largest_by_user(rows: DataFrame) -> DataFrame:
    def step(key: tuple, parts, state: GroupState):
        n, top = state.get if state.exists else (0, float("-inf"))
        for p in parts:
            n, top = n + len(p), max(top, float(p["value"].max()))
        state.update((n, top))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "top": [top]})

    got = rows.select("user_id", "value").groupBy("user_id").applyInPandasWithState(step, "user_id bigint, n bigint, top double", "n bigint, top double", "update", GroupStateTimeout.NoTimeout)
    return finished(got, "update").groupBy("user_id").agg(F.max("n").alias("n"), F.max("top").alias("top"))


#: File of an event in arrivals(): a twentieth of the events come a file late, a twentieth three; the files are in order of arrival.
ARRIVAL = "cast(floor((day(ts) - 1) / 10) AS int) + CASE event_id % 20 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END"


def arrivals(spark: SparkSession, d: str, copies: int = 1) -> DataFrame:
    """events as a stream of several micro-batches, a file each, with a watermark of an hour; further copies of an event come in the files after its own."""
    out = scratch(spark, "arrivals")
    rows = table(spark, d, "events").withColumn("file", F.explode(F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda c: F.expr(ARRIVAL) + c)))
    rows.repartition("file").write.partitionBy("file").parquet(out)
    # The source takes files by their time of change.
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in store.listStatus(hadoop):
        if folder.isDirectory():
            number = int(folder.getPath().getName().split("=")[1])
            for file in store.listStatus(folder.getPath()):
                store.setTimes(file.getPath(), 1_700_000_000_000 + 60_000 * number, -1)
    raw = spark.readStream.schema(table(spark, d, "events").schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/file=*")
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")


@query(
    "stream_batches_late",
    f"""WITH a AS (SELECT *, {ARRIVAL} AS f FROM events),
    low AS (SELECT f, (SELECT max(ts) FROM a WHERE a.f < x.f - 1) - INTERVAL 1 HOUR AS mark FROM (SELECT DISTINCT f FROM a) x)
    SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM a JOIN low USING (f)
    WHERE mark IS NULL OR time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY > mark GROUP BY ALL""",
)
def stream_batches_late(spark: SparkSession, d: str) -> DataFrame:
    """Windows over six micro-batches; rows whose window the watermark of two batches before has passed are dropped, and no others."""
    got = ends(finished(windowed(arrivals(spark, d), F.window("ts", "1 day")), "update"))
    return got.groupBy("start", "event_type").agg(F.max("n").alias("n"))


@query("stream_batches_dedup", "SELECT event_id, event_type FROM events")
def stream_batches_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Each event comes in two files; its key is state from one micro-batch to the next."""
    return finished(arrivals(spark, d, copies=2).select("event_id", "event_type").dropDuplicates(["event_id"]), "append")


@query("stream_batches_state", "SELECT user_id, count(*) AS n, max(value) AS top FROM events GROUP BY user_id")
def stream_batches_state(spark: SparkSession, d: str) -> DataFrame:
    """As stream_state, with each user's state carried over six micro-batches."""
    return largest_by_user(arrivals(spark, d))


@query("stream_batches_join", "SELECT a.event_id AS view, b.event_id AS purchase FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 6 HOURS WHERE a.event_type = 'view' AND b.event_type = 'purchase'")
def stream_batches_join(spark: SparkSession, d: str) -> DataFrame:
    """Two streams whose rows meet in different micro-batches; without a watermark no row is late."""
    rows = arrivals(spark, d).select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("t"))
    a = rows.where("event_type = 'view'").select(F.col("event_id").alias("view"), F.col("user_id").alias("u"), F.col("t").alias("from"))
    b = rows.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), "user_id", "t")
    return finished(a.join(b, F.expr("u = user_id AND t BETWEEN from AND from + INTERVAL 6 HOURS")).select("view", "purchase"), "append")


@query("stream_update", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_update(spark: SparkSession, d: str) -> DataFrame:
    """Update mode writes a window each time it changes; the largest count is the last."""
    got = ends(finished(windowed(stream(spark, d), F.window("ts", "1 day")), "update"))
    return got.groupBy("start", "event_type").agg(F.max("n").alias("n"))


@query("stream_dedup_watermark", "SELECT count(DISTINCT event_id) AS n FROM events")
def stream_dedup_watermark(spark: SparkSession, d: str) -> DataFrame:
    """Each event twice; state for a key is dropped once the watermark has passed it."""
    doubled = stream(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return finished(doubled.dropDuplicatesWithinWatermark(["event_id"]).select("event_id"), "append").agg(F.count("*").alias("n"))


@query("stream_memory_sink", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_memory_sink(spark: SparkSession, d: str) -> DataFrame:
    """The memory sink holds its rows on the driver; here a row for each type of event."""
    import uuid

    name = f"events_{uuid.uuid4().hex}"
    counts = stream(spark, d).groupBy("event_type").agg(F.count("*").alias("n"))
    counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@query("stream_processor", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def stream_processor(spark: SparkSession, d: str) -> DataFrame:
    """A stateful processor with named state, kept in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = stream(spark, d).select("user_id", "value").groupBy("user_id").transformWithStateInPandas(Counter(), "user_id bigint, n bigint", "update", "none")
        return finished(got, "update").groupBy("user_id").agg(F.max("n").alias("n"))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


class Counter(StatefulProcessor):
    """Rows seen by key."""

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "n bigint")

    def handleInputRows(self, key, rows, timerValues):
        n = (self.seen.get()[0] if self.seen.exists() else 0) + sum(len(r) for r in rows)
        self.seen.update((n,))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n]})

    def close(self) -> None:
        pass
