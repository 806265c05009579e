"""Time-based state: limiters, cool-downs, windows, retention, and continuous verification; batch twins beside the streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.window import Window

ADMITTED = "user_id long, event_id long, ts timestamp, admitted boolean"


def admit(events: DataFrame, limit: int = 10, seconds: float = 60.0) -> DataFrame:
    """T-1 in batch: an event is admitted if fewer than `limit` admitted ones of its user lie in the last `seconds` seconds.

    Denied events don't count, so the rule is sequential: each user's events stream in order through one task, which holds the
    times of at most `limit` admitted events for one user at a time.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, recent = None, deque()
        for f in frames:
            out = []
            for u, t in zip(f["user_id"], f["ts"]):
                if u != user:
                    user, recent = u, deque()
                while recent and (t - recent[0]).total_seconds() >= seconds:
                    recent.popleft()
                out.append(ok := len(recent) < limit)
                if ok:
                    recent.append(t)
            yield f.assign(admitted=out)

    rows = events.where("user_id is not null and ts is not null").select("user_id", "event_id", "ts")
    return rows.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").mapInPandas(work, ADMITTED)


class Limiter(StatefulProcessor):
    """T-1 as a stream: a list state of admitted times for each user."""

    def __init__(self, limit: int = 10, seconds: float = 60.0):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", T.StructType([T.StructField("t", T.DoubleType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        recent = deque(x[0] for x in self.times.get())
        for f in rows:
            f = f.sort_values(["ts", "event_id"])
            out = []
            for t in f["ts"]:
                now = t.timestamp()
                while recent and now - recent[0] >= self.seconds:
                    recent.popleft()
                out.append(ok := len(recent) < self.limit)
                if ok:
                    recent.append(now)
            yield f.assign(admitted=out)[["user_id", "event_id", "ts", "admitted"]]
        self.times.put([(t,) for t in recent]) if recent else self.times.clear()

    def close(self) -> None:
        pass


def admit_stream(events: DataFrame, limit: int = 10, seconds: float = 60.0) -> DataFrame:
    return events.select("user_id", "event_id", "ts").groupBy("user_id").transformWithStateInPandas(Limiter(limit, seconds), ADMITTED, "Append", "None")


def requests_in_window(events: DataFrame, seconds: int = 60) -> DataFrame:
    """The metric beside T-1: how many events of the user lie in the last `seconds` seconds, itself included."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.select("event_id", "user_id", F.count(F.lit(1)).over(w).alias("n_recent"))


def cooldown(calls: DataFrame, key: str, failed, seconds: int = 45) -> DataFrame:
    """T-6: after a failure the key is skipped for `seconds` seconds. A skipped call doesn't fail anew, so it suffices to know
    the latest failure that was made; as each pause begins with a call that wasn't skipped, it runs in order like `admit`."""

    def work(frames):
        at, until = None, None
        for f in frames:
            out = []
            for k, t, bad in zip(f["key"], f["ts"], f["failed"]):
                if k != at:
                    at, until = k, None
                skip = until is not None and t < until
                out.append(skip)
                if bad and not skip:
                    until = t + pd.Timedelta(seconds=seconds)
            yield f.assign(skipped=out)[["event_id", "key", "skipped"]]

    rows = calls.select("event_id", F.col(key).cast("string").alias("key"), "ts", failed.alias("failed")).where("key is not null and ts is not null")
    return rows.repartition("key").sortWithinPartitions("key", "ts", "event_id").mapInPandas(work, "event_id long, key string, skipped boolean")


def recent(rows: DataFrame, key: str, id_: str, ts: str, k: int = 50) -> DataFrame:
    """T-2's cap, D-12: the newest k of a key, one for each id."""
    once = Window.partitionBy(key, id_).orderBy(F.desc(ts))
    best = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(id_))
    return rows.withColumn("_i", F.row_number().over(once)).where("_i = 1").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("_i")


RECENT = "report_id string, ts timestamp, live boolean"


class LastReports(StatefulProcessor):
    """T-2 as a stream: a value state with the last report of each id, and a timer at which it expires, by event time."""

    def __init__(self, hours: float):
        self.keep = int(hours * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType([T.StructField("ms", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(t.timestamp() * 1000) for f in rows for t in f["ts"])
        held = self.last.get()[0] if self.last.exists() else None
        if held is not None and held >= newest:
            return
        if held is not None:
            self.handle.deleteTimer(held + self.keep)
        self.last.update((newest,))
        self.handle.registerTimer(newest + self.keep)
        yield self._row(key, newest, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            held = self.last.get()[0]
            self.last.clear()
            yield self._row(key, held, False)

    @staticmethod
    def _row(key, ms: int, live: bool) -> pd.DataFrame:
        return pd.DataFrame({"report_id": [key[0]], "ts": [pd.Timestamp(ms, unit="ms")], "live": [live]})

    def close(self) -> None:
        pass


def recent_reports_stream(reports: DataFrame, hours: float = 6, late: str = "10 minutes") -> DataFrame:
    """T-2: changes (report_id, ts, live) of the reports that are remembered: a newer report of an id takes the older one's place, a
    report is forgotten `hours` after its time. The latest change of each id is the snapshot that `recent_reports` caps."""
    rows = reports.withWatermark("ts", late).select("report_id", "ts").where("report_id is not null")
    return rows.groupBy("report_id").transformWithStateInPandas(LastReports(hours), RECENT, "Append", "EventTime")


def recent_reports(changes: DataFrame, cap: int = 300) -> DataFrame:
    """T-2's global cap, over a snapshot: (report_id, ts) of the `cap` newest live reports, ties by id. A list of the newest, so the cap is the feature."""
    last = changes.groupBy("report_id").agg(F.max_by("live", F.struct("ts", ~F.col("live"))).alias("live"), F.max("ts").alias("ts"))
    return last.where("live").select("report_id", "ts").orderBy(F.desc("ts"), "report_id").limit(cap)


def recent_reports_at(reports: DataFrame, now, hours: float = 6, cap: int = 300) -> DataFrame:
    """T-2 in batch: what is remembered at a time."""
    last = reports.where(F.col("report_id").isNotNull()).groupBy("report_id").agg(F.max("ts").alias("ts"))
    return last.where(F.col("ts") + F.make_dt_interval(hours=F.lit(hours).cast("int")) > now).orderBy(F.desc("ts"), "report_id").limit(cap)


class Progress(StreamingQueryListener):
    """T-5: counters of a run's stages. `counted` puts a counter on a stage; each batch run or micro-batch leaves a row for each stage."""

    def __init__(self) -> None:
        self.found: list[tuple[str, int, str, int]] = []
        self.watched: list[tuple[str, Observation]] = []

    def counted(self, df: DataFrame, stage: str) -> DataFrame:
        """df itself, with its rows counted when they pass, on a stream or in a batch."""
        counter = F.count(F.lit(1)).alias("rows")
        if df.isStreaming:
            return df.observe(stage, counter)
        seen = Observation(stage)
        self.watched.append((stage, seen))
        return df.observe(seen, counter)

    def done(self, run: str) -> None:
        """After a batch's action: takes its counters."""
        self.found += [(run, 0, stage, seen.get["rows"]) for stage, seen in self.watched]
        self.watched = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.found += [(p.name or str(p.id), p.batchId, stage, row["rows"]) for stage, row in p.observedMetrics.items()]

    def onQueryTerminated(self, event) -> None:
        pass

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.found, "run string, batch long, stage string, rows long")


def retain(rows: DataFrame, ts: str, now, days: int = 14) -> DataFrame:
    """T-4: rows that are no older than `days` days at `now`."""
    return rows.where(F.col(ts) >= now - F.make_interval(days=F.lit(days)))


def windowed_counts(events: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """T-8: counts by tumbling window and type; on a stream, events later than `late` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """T-8: sessions of a user's events."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def first_seen(payloads: DataFrame, key: str, ts: str, keep: str = "1 hour") -> DataFrame:
    """T-3: one of each payload within the watermark (stream) or at all (batch)."""
    return payloads.withWatermark(ts, keep).dropDuplicatesWithinWatermark([key]) if payloads.isStreaming else payloads.dropDuplicates([key])


def watch(texts: DataFrame, corpus: DataFrame, out: str, checkpoint: str):
    """T-7: every micro-batch of (input_id, text) is verified against the corpus and its verdicts appended to `out`."""
    from ..operators.matching import verify

    def each(batch: DataFrame, number: int) -> None:
        verify(batch, corpus).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return texts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
