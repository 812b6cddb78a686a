"""Streams of job and chart events: latest state, windows, once-only completions, stuck jobs, bad rows.

Each stream is driven by availableNow. Aggregations with a watermark give out a window once it is over and forget it (append
mode, file sink), so neither state nor output grows with the stream's age. Job transitions are keyed state with timers. Latest
states are an upsert into a table in buckets, by foreachBatch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from clinframe.sources.scratch import scratch

#: What a well-formed event has; others go to quarantine.
VALID = "event_id IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL AND event_type IN ('view', 'signup', 'error', 'click', 'purchase')"


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of files: every Parquet file or folder of the name events*.parquet."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def valid(events: DataFrame) -> DataFrame:
    return events.where(VALID)


def quarantined(events: DataFrame) -> DataFrame:
    """Events that aren't well-formed, with the reason; a sink of their own keeps them."""
    reason = F.when(F.col("event_id").isNull(), "no id").when(F.col("user_id").isNull(), "no user").when(F.col("ts").isNull(), "no time").otherwise("unknown type")
    return events.where(f"NOT coalesce({VALID}, false)").withColumn("reason", reason)


def _windowed(events: DataFrame, window, late: str) -> DataFrame:
    per = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return per.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", "total")


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their value per window and type; a window comes out when the watermark has passed it."""
    return _windowed(events, F.window("ts", width), late)


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return _windowed(events, F.window("ts", width, step), late)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """A user's events that follow each other within the gap."""
    per = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return per.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


def with_names(events: DataFrame, patients: DataFrame) -> DataFrame:
    """Events with their patient's name, from a table read anew with each batch."""
    return events.join(patients.select(F.col("id").alias("p_id"), "full_name"), F.col("user_id") == F.col("p_id"), "left").drop("p_id")


def stuck(states: DataFrame, at, after: str = "1 hour", active: tuple[str, ...] = ("click", "view")) -> DataFrame:
    """Of latest states (user_id, event_id, state, ts) those that are active and haven't moved for a while."""
    return states.where(F.col("state").isin(*active) & (F.col("ts") < at - F.expr(f"INTERVAL {after}")))


#: Columns of the table of latest states.
STATES = "user_id long, event_id long, state string, ts timestamp, n_events long"


def run_upsert(events: DataFrame, name: str, buckets: int = 16) -> DataFrame:
    """The last event of each user by (ts, event_id), and how many there were, kept as a table in buckets of users.

    Batch n reads the buckets that its users are in, as they were after batch n - 1, and writes these buckets anew as version
    n; a manifest says which version of each bucket counts. A batch replayed after a failure so writes the same again. Versions
    that neither of the last two manifests names are removed. Without any batch the table is empty.
    """
    spark = events.sparkSession
    path = scratch(spark, name)

    def read(version: int) -> DataFrame:
        return spark.read.schema(f"{STATES}, bucket int").parquet(f"{path}/v{version}")

    def versions(batch_id: int) -> dict[int, int]:
        """bucket -> version after a batch; batches without rows write nothing."""
        found = [n for n in _batches(spark, path) if n <= batch_id]
        return {r.bucket: r.version for r in spark.read.schema("bucket int, version int").parquet(f"{path}/manifest-{max(found)}").collect()} if found else {}

    def current(held: dict[int, int]) -> DataFrame:
        parts = [read(v).where(F.col("bucket").isin(*[k for k, w in held.items() if w == v])) for v in sorted(set(held.values()))]
        return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], f"{STATES}, bucket int"))

    def write(batch: DataFrame, batch_id: int) -> None:
        bucket = F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int")
        new = batch.select("user_id", "event_id", F.col("event_type").alias("state"), "ts", F.lit(1).cast("long").alias("n_events")).withColumn("bucket", bucket)
        touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())
        if not touched:
            return
        before = versions(batch_id - 1)
        old = current({k: v for k, v in before.items() if k in touched})
        last = F.max(F.struct("ts", "event_id", "state")).alias("last")
        merged = new.unionByName(old).groupBy("bucket", "user_id").agg(last, F.sum("n_events").alias("n_events"))
        merged.select("user_id", "last.event_id", "last.state", "last.ts", "n_events", "bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/v{batch_id}")
        now = before | dict.fromkeys(touched, batch_id)
        spark.createDataFrame(list(now.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest-{batch_id}")
        named = {batch_id, *now.values(), *before.values()}
        for n in _batches(spark, path):
            if n < batch_id - 1 and n not in named:
                _remove(spark, f"{path}/v{n}")

    q = events.writeStream.option("checkpointLocation", f"{path}/log").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    done = _batches(spark, path)
    return current(versions(max(done, default=-1))).drop("bucket")


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Batches that have a manifest."""
    files, at = _folder(spark, path)
    names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
    return sorted(int(n.removeprefix("manifest-")) for n in names if n.startswith("manifest-"))


def _remove(spark: SparkSession, path: str) -> None:
    files, at = _folder(spark, path)
    files.delete(at, True)


#: What an event says of a job, and the states in which a job is under way.
MOVES = {"signup": "queued", "view": "processing", "click": "processing", "purchase": "done", "error": "error"}
UNDER_WAY = ("queued", "processing", "stuck")
QUEUED, PROCESSING, DONE, ERROR, STUCK = range(5)
NAMES = np.array(["queued", "processing", "done", "error", "stuck"], dtype=object)


def transitions(events: DataFrame, patience: str = "1 hour", late: str = "10 minutes", buckets: int = 4096) -> DataFrame:
    """The transitions of each user's job: queued, processing, done or error, and stuck after `patience` without a move.

    A job is queued from any state; it goes on, ends or fails only while it is under way, and other events of it are ignored.
    Events wait in keyed state until the watermark has passed them and are applied in order of (ts, event_id), without an id last;
    a timer at the job's deadline marks it stuck, at the deadline's time, if it is queued or processing. So what comes out
    depends on the events alone, not on batches. A job that is done or failed has no state, one that is under way has one row.

    State is kept by buckets of users, since a call of the processor, a frame of rows and a call of the store cost some
    milliseconds each, however few rows they are about. A bucket's users are told apart in arrays.
    """
    millis = int(pd.Timedelta(patience).total_seconds() * 1000)
    state = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(int(np.flatnonzero(NAMES == v)[0]))) for k, v in MOVES.items()])
    known = events.where(F.col("user_id").isNotNull() & F.col("event_type").isin(*MOVES)).withWatermark("ts", late)
    # ts is there for the watermark; its milliseconds are those of UTC, whatever the session's time zone.
    rows = known.select(
        F.pmod(F.xxhash64("user_id"), F.lit(buckets)).alias("bucket"), "user_id", F.unix_millis("ts").alias("at"),
        F.coalesce("event_id", F.lit(0)).alias("event_id"), F.col("event_id").isNull().alias("no_id"), state.alias("state"), "ts",
    )
    moved = rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=_Jobs(millis), outputStructType="user_id long, event_id long, state string, at long", outputMode="Append", timeMode="EventTime")
    return moved.withColumn("at", F.timestamp_millis("at"))


#: An event that waits; or a job under way as the event that brought it there.
EVENT = np.dtype([("user_id", "i8"), ("at", "i8"), ("event_id", "i8"), ("no_id", "?"), ("state", "i1"), ("job", "?")])
#: Events in one row of state at most.
CHUNK = 10_000


def _chunks(events: np.ndarray) -> list[tuple[bytes]]:
    return [(events[i : i + CHUNK].tobytes(),) for i in range(0, len(events), CHUNK)]


def _moves(rows: np.ndarray, now: int, patience: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Jobs and the events up to `now`: events that moved a job, jobs that got stuck (at their deadlines), jobs under way.

    Whether a job is under way is said by its last event that queues or ends it: what else comes goes on with it or is ignored.
    """
    rows = rows[np.lexsort((rows["event_id"], rows["no_id"], rows["at"], ~rows["job"], rows["user_id"]))]
    user, at, state, job = (rows[c] for c in ("user_id", "at", "state", "job"))
    first = np.ones(len(rows), bool)
    first[1:] = user[1:] != user[:-1]
    last = np.append(first[1:], True)
    opens = job | (state == QUEUED)
    says = first | opens | (state == DONE) | (state == ERROR)
    under = opens[np.maximum.accumulate(np.where(says, np.arange(len(rows)), 0))]
    before = np.append(False, under[:-1]) & ~first
    until = np.where(last, now, np.append(at[1:], now))
    late = under & (state != STUCK) & (at + patience < until)
    stuck = rows[late]
    stuck["at"] += patience
    stuck["state"], stuck["no_id"] = STUCK, True
    left = rows[under & last]
    left["state"][late[under & last]] = STUCK
    left["job"] = True
    return rows[~job & (opens | before)], stuck, left


class _Jobs(StatefulProcessor):
    """State of a bucket of users: the events that wait, a row for each frame of them, and the jobs under way, as arrays of EVENT."""

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events binary")
        self.jobs = handle.getValueState("jobs", "jobs binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            new = np.zeros(len(frame), EVENT)
            for c in ("user_id", "at", "event_id", "no_id", "state"):
                new[c] = frame[c]
            self.waiting.appendList(_chunks(new))
            self.handle.registerTimer(int(new["at"].min()) + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = np.frombuffer(b"".join(chunk for (chunk,) in self.waiting.get()), EVENT)
        before = bytes((self.jobs.get() or (b"",))[0])
        due = held["at"] < now
        moved, stuck, left = _moves(np.concatenate([np.frombuffer(before, EVENT), held[due]]), now, self.patience)
        if due.all():
            self.waiting.clear()
        else:
            if due.any():
                self.waiting.put(_chunks(held[~due]))
            self.handle.registerTimer(int(held["at"][~due].min()) + 1)
        if not len(left):
            self.jobs.clear()
        elif left.tobytes() != before:
            self.jobs.update((left.tobytes(),))
        if len(waits := left["at"][left["state"] != STUCK]):
            self.handle.registerTimer(int(waits.min()) + self.patience + 1)
        out = np.concatenate([moved, stuck])
        if len(out):
            yield pd.DataFrame({"user_id": out["user_id"], "event_id": pd.arrays.IntegerArray(out["event_id"].copy(), out["no_id"].copy()), "state": NAMES[out["state"]], "at": out["at"]})

    def close(self) -> None:
        pass


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_stateful(stream: DataFrame, name: str) -> DataFrame:
    """run_append() with the state store that timers and keyed state need."""
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key)
    conf.set(key, ROCKSDB)
    try:
        return run_append(stream, name)
    finally:
        conf.set(key, before)


#: What changes of documents leave in the audit log.
AUDITED = {"purchase": "verified", "click": "edited", "error": "deleted"}
AUDIT = "document_id long, actor_id long, action string, at timestamp, detail string, batch long"


def audited(events: DataFrame) -> DataFrame:
    """Audit rows of events that change a document (event_id): who did what, when."""
    action = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in AUDITED.items()])
    return events.where(F.col("event_type").isin(*AUDITED)).select(F.col("event_id").alias("document_id"), F.col("user_id").alias("actor_id"), action.alias("action"), F.col("ts").alias("at"), F.get_json_object("props", "$.k").alias("detail"))


def append_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """A batch's audit rows in a folder of its own: the batch again writes the same folder again, so nothing is there twice."""
    rows.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/log/{batch_id:012d}")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The whole log; empty before the first batch."""
    files, at = _folder(spark, f"{path}/log")
    if not files.exists(at):
        return spark.createDataFrame([], AUDIT)
    return spark.read.schema(AUDIT).option("recursiveFileLookup", "true").parquet(f"{path}/log")


def run_audit(events: DataFrame, name: str) -> DataFrame:
    """Append what a stream of events says to the audit log; rows are never changed."""
    path = scratch(events.sparkSession, name)
    q = audited(events).writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(lambda batch, n: append_batch(batch, n, path)).start()
    q.awaitTermination()
    return read_audit(events.sparkSession, path)


def run_append(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream of final rows over what is available now; the file sink commits each batch once."""
    spark = stream.sparkSession
    path = scratch(spark, name)
    q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/table").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def first_completions(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each user's purchases once per event id, however often the log repeats them within a day; ids are forgotten after it."""
    return events.where("event_type = 'purchase'").withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
