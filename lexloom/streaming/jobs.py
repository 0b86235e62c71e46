"""The work queue: one job's life as a state machine, replayed over a log (batch) or run as a keyed streaming state.

Events (jobid, event_time, op, channel, priority, serial, timeout_s, ttl_s, error): op is push, pop, finish, setinfo, kill, drop or tick. A job times out when its
deadline passes without a finish; a finished job is kept for its time to live (an error's at most ten seconds); pushing a known job changes nothing
unless it was killed. Time is the events' own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TIMEOUT_S, TTL_S, ERROR_TTL_S = 120.0, 3600, 10


@dataclass
class Job:
    jobid: str
    channel: str = ""
    priority: int = 0
    serial: int = 0
    state: str = "new"  # new, waiting, running, success, error, timeout, killed, gone
    error: str | None = None
    info: str | None = None
    deadline: float = 0.0
    ttl: float = TTL_S
    drop: bool = False

    @property
    def done(self) -> bool:
        return self.state in ("success", "error", "timeout", "killed")


def advance(job: Job, now: float) -> None:
    """Lets time pass: deadlines make timeouts, and finished jobs go after their time to live."""
    if job.state in ("waiting", "running") and now >= job.deadline:
        at = job.deadline
        job.state, job.error = "timeout", "timeout"
        job.deadline = at + min(job.ttl, ERROR_TTL_S)
    if job.done and (job.drop or now >= job.deadline):
        job.state = "gone"


def step(job: Job, event: dict) -> None:
    """Applies one event."""
    now = float(event["event_time"])
    advance(job, now)
    op = event["op"]
    if op == "push" and job.state in ("new", "killed", "gone"):
        job.channel, job.priority, job.serial = event.get("channel") or "", int(event.get("priority") or 0), int(event.get("serial") or 0)
        job.ttl = float(event["ttl_s"]) if event.get("ttl_s") is not None else float(TTL_S)
        job.state, job.error, job.drop = "waiting", None, False
        job.deadline = now + (float(event["timeout_s"]) if event.get("timeout_s") is not None else TIMEOUT_S)
    elif op == "pop" and job.state == "waiting":
        job.state = "running"
    elif op == "finish" and job.state in ("waiting", "running"):
        job.error = event.get("error")
        job.state = "error" if job.error is not None else "success"
        job.deadline = now + (min(job.ttl, ERROR_TTL_S) if job.error is not None else job.ttl)
    elif op == "setinfo" and job.state in ("waiting", "running"):
        job.info = event.get("info")
    elif op == "kill" and job.state in ("waiting", "running"):
        job.state, job.error, job.deadline = "killed", "killed", now + job.ttl
    elif op == "drop":
        job.drop = True
        advance(job, now)


STATES = "jobid string, channel string, priority int, state string, error string, info string"
_STATES = pa.schema([("jobid", pa.string()), ("channel", pa.string()), ("priority", pa.int32()), ("state", pa.string()), ("error", pa.string()), ("info", pa.string())])


def replay(log: DataFrame, until: float | None = None) -> DataFrame:
    """The state of every job after a log (and up to a time, if given); a job's own events decide, so that jobs are replayed apart.
    The rows of a job come one after another, so that a task holds one job at a time, however many jobs and events there are."""

    def shown(job: Job) -> dict:
        if until is not None:
            advance(job, until)
        return {"jobid": job.jobid, "channel": job.channel, "priority": job.priority, "state": job.state, "error": job.error, "info": job.info}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job = None
        for batch in batches:
            out = []
            for event in batch.to_pylist():
                if job is None or str(event["jobid"]) != job.jobid:
                    if job is not None:
                        out.append(shown(job))
                    job = Job(str(event["jobid"]))
                step(job, {k: None if isinstance(v, float) and v != v else v for k, v in event.items()})
            yield pa.RecordBatch.from_pylist(out, _STATES)
        if job is not None:
            yield pa.RecordBatch.from_pylist([shown(job)], _STATES)

    return log.repartition("jobid").sortWithinPartitions("jobid", F.col("event_time").asc_nulls_last()).mapInArrow(run, STATES)


def channel_stats(states: DataFrame) -> DataFrame:
    """(channel, success, error, timeout, killed, busy); an empty error text counts in none."""
    n = lambda s: F.count_if(F.col("state") == s)
    return states.groupBy("channel").agg(n("success").alias("success"), F.count_if((F.col("state") == "error") & (F.col("error") != "")).alias("error"), n("timeout").alias("timeout"), n("killed").alias("killed"), F.count_if(F.col("state").isin("waiting", "running")).alias("busy"))


def pop_order(states: DataFrame, channels: list[str] | None = None) -> DataFrame:
    """Waiting jobs of some (or all) channels, the next first."""
    rows = states.where(F.col("state") == "waiting")
    return (rows if not channels else rows.where(F.col("channel").isin(channels))).orderBy("priority", "serial")


def with_prefix(states: DataFrame, prefix: str) -> DataFrame:
    return states.where(F.col("jobid").startswith(prefix))


def overloaded(stats: DataFrame, most: int = 10) -> DataFrame:
    return stats.select("channel", (F.col("busy") > most).alias("overloaded"))


def render_status(jobs: DataFrame) -> DataFrame:
    """(collection, status) of (collection, writer, zip_state, render_state, render_error): failed, finished or progress, the archive's progress while rendering waits for it."""
    return jobs.select("collection", F.when(F.col("render_state").isin("error", "timeout", "killed") | F.col("zip_state").isin("error", "timeout", "killed"), F.lit("failed")).when(F.col("render_state") == "success", F.lit("finished")).otherwise(F.lit("progress")).alias("status"))


def stale_folders(files: DataFrame, now: float, max_age: float) -> DataFrame:
    """Folders with any entry older than the age."""
    return files.groupBy("dir").agg(F.min("mtime").alias("oldest")).where(F.col("oldest") < now - max_age)


FINAL = ("success", "error", "timeout", "killed")


def waited_for(states: DataFrame, wanted: DataFrame) -> DataFrame:
    """(request, finished): whether all jobs that a request (request, jobid) waits for are done; a job that isn't known (any more) isn't waited for."""
    rows = wanted.join(states.select("jobid", "state"), "jobid", "left")
    return rows.groupBy("request").agg(F.bool_and(F.col("state").isNull() | F.col("state").isin(*FINAL)).alias("finished"))


def preened(states: DataFrame) -> DataFrame:
    """The jobs that a channel still has to give out or is working on."""
    return states.where(~F.col("state").isin(*FINAL, "gone"))


def requeued(states: DataFrame, lost: DataFrame) -> DataFrame:
    """States after workers (channel) were lost: their running jobs wait again."""
    gone = lost.select("channel", F.lit(True).alias("_lost")).distinct()
    back = F.coalesce("_lost", F.lit(False)) & (F.col("state") == "running")
    return states.join(gone, "channel", "left").withColumn("state", F.when(back, F.lit("waiting")).otherwise(F.col("state"))).select(*states.columns)


def route(collection, servers: int):
    """The server that keeps a collection's files: the same for every job of the collection."""
    return F.pmod(F.xxhash64(collection), F.lit(servers)).cast("int")


def save_states(states: DataFrame, path: str) -> None:
    """The queue as a table, for a new start."""
    states.write.mode("overwrite").parquet(path)


def load_states(spark, path: str) -> DataFrame:
    """A saved queue; what was running when it was saved waits again."""
    saved = spark.read.schema(STATES).parquet(path)
    return saved.withColumn("state", F.when(F.col("state") == "running", F.lit("waiting")).otherwise(F.col("state")))


def write_jobs(jobs: DataFrame, path: str) -> None:
    """Job files (one JSON line a job, each job once) that :func:`oldest_first` reads."""
    jobs.dropDuplicates(["jobid"]).write.mode("append").json(path)


def write_status(status: DataFrame, path: str) -> None:
    """The latest status of each job as JSON; the folder is replaced as a whole."""
    last = Window.partitionBy("jobid").orderBy(F.desc("event_time"))
    status.withColumn("_n", F.row_number().over(last)).where(F.col("_n") == 1).drop("_n").write.mode("overwrite").json(path)


# -- streaming -------------------------------------------------------------------------------------------------------
def job_stream(log: DataFrame) -> DataFrame:
    """The same machine as keyed state over a stream of events: rows come out at each change of a job's state. ``event_time`` is in
    seconds. A timer stands at each job's deadline, so that a job without a further event times out, and its state goes after its time to live, as
    soon as the events of other jobs have moved the watermark past them."""
    from pyspark.sql.streaming import StatefulProcessor

    columns = ["jobid", "channel", "priority", "state", "error", "info"]

    class Machine(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.value = handle.getValueState("job", "channel string, priority int, serial long, state string, error string, info string, deadline double, ttl double, drop boolean")

        def _load(self, jobid: str) -> Job:
            if not self.value.exists():
                return Job(jobid)
            return Job(jobid, *self.value.get())

        def _store(self, job: Job) -> None:
            for at in self.handle.listTimers():
                self.handle.deleteTimer(at)
            if job.state == "gone":
                self.value.clear()
            else:
                if job.state != "new":
                    self.handle.registerTimer(int(job.deadline * 1000))
                self.value.update((job.channel, job.priority, job.serial, job.state, job.error, job.info, job.deadline, job.ttl, job.drop))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            job = self._load(key[0])
            out = []
            for frame in rows:
                for event in frame.sort_values("event_time", kind="stable").to_dict("records"):
                    before = job.state
                    step(job, {k: None if isinstance(v, float) and v != v else v for k, v in event.items()})
                    if job.state != before:
                        out.append({"jobid": key[0], "channel": job.channel, "priority": job.priority, "state": job.state, "error": job.error, "info": job.info})
            self._store(job)
            yield pd.DataFrame(out, columns=columns)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            job = self._load(key[0])
            before = job.state
            advance(job, expiredTimerInfo.getExpiryTimeInMs() / 1000)
            self._store(job)
            shown = [{"jobid": key[0], "channel": job.channel, "priority": job.priority, "state": job.state, "error": job.error, "info": job.info}] if job.state != before else []
            yield pd.DataFrame(shown, columns=columns)

        def close(self) -> None:
            pass

    timed = log.withColumn("at", F.timestamp_seconds("event_time")).withWatermark("at", "0 seconds")
    return timed.groupBy("jobid").transformWithStateInPandas(Machine(), STATES, "Append", "EventTime")


def deduplicated(log: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Pushes once each, as long as the watermark holds them."""
    return log.where(F.col("op") == "push").withWatermark("ts", delay).dropDuplicatesWithinWatermark(["jobid"])


# -- windows over events (an extension) --------------------------------------------------------------------------------
def tumbling(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", slide: str = "15 minutes", delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width, slide), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def oldest_first(spark, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """A folder of JSON job files as a stream, the oldest first, a few in each trigger."""
    return spark.readStream.schema(schema).option("latestFirst", "false").option("maxFilesPerTrigger", per_trigger).json(path)


def monotone(status: DataFrame) -> DataFrame:
    """Progress by job that never falls."""
    w = Window.partitionBy("jobid").orderBy("event_time").rowsBetween(Window.unboundedPreceding, 0)
    return status.withColumn("progress", F.max("progress").over(w))
