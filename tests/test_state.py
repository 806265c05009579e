"""Streams with state against their batch twins, progress counters, buckets that are written anew."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from quotemill.functions import text as X
from quotemill.operators import evaluate as E
from quotemill.operators import maintain as K
from quotemill.streaming import state as T

START = dt.datetime(2026, 1, 1)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def streamed(spark, folder, parts, schema):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{i}")
        os.utime(f"{folder}/in/{i}", (i + 1, i + 1))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


def ran(df, folder, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    q.awaitTermination(240)
    return df.sparkSession.table(name)


def test_recent_reports_expire(rocks, tmp_path):
    at = lambda h: START + dt.timedelta(hours=h)
    parts = [[("a", at(0)), ("b", at(1)), ("a", at(0.5))], [("a", at(3)), ("c", at(5))], [("d", at(8))], [("e", at(8.5))]]
    rows = [r for part in parts for r in part]
    changes = ran(T.recent_reports_stream(streamed(rocks, tmp_path, parts, "report_id string, ts timestamp"), 6), tmp_path, "recent_reports")
    assert {r.report_id for r in changes.where("not live").collect()} >= {"b"}  # its six hours are over
    want = T.recent_reports_at(rocks.createDataFrame(rows, "report_id string, ts timestamp"), F.lit(at(8.3)).cast("timestamp"), 6)
    assert [tuple(r) for r in T.recent_reports(changes).collect()] == [tuple(r) for r in want.collect()] and want.count() == 4
    assert [r.report_id for r in T.recent_reports(changes, 2).collect()] == ["e", "d"]


def test_limiter_stream_equals_batch(rocks, tmp_path):
    rnd = random.Random(1)
    rows = sorted((START + dt.timedelta(seconds=rnd.randrange(200)), i, rnd.randrange(3)) for i in range(90))
    rows = [(u, i, t) for t, i, u in rows]
    schema = "user_id long, event_id long, ts timestamp"
    found = ran(T.admit_stream(streamed(rocks, tmp_path, [rows[:40], rows[40:]], schema), 3, 30), tmp_path, "admitted")
    want = T.admit(rocks.createDataFrame(rows, schema), 3, 30)
    assert {r.event_id: r.admitted for r in found.collect()} == {r.event_id: r.admitted for r in want.collect()}


def test_first_seen(spark, tmp_path):
    rows = [("p", START), ("q", START), ("p", START + dt.timedelta(minutes=5))]
    df = spark.createDataFrame(rows, "payload string, ts timestamp")
    assert sorted(r.payload for r in T.first_seen(df, "payload", "ts").collect()) == ["p", "q"]
    found = ran(T.first_seen(streamed(spark, tmp_path, [rows[:1], rows[1:]], "payload string, ts timestamp"), "payload", "ts"), tmp_path, "first_seen")
    assert sorted(r.payload for r in found.collect()) == ["p", "q"]


def test_progress(spark, tmp_path):
    progress = T.Progress()
    rows = progress.counted(progress.counted(spark.range(100), "read").where("id % 4 = 0"), "kept")
    assert len(rows.collect()) == 25
    progress.done("batch")
    assert {(r.run, r.stage, r["rows"]) for r in progress.rows(spark).collect()} == {("batch", "read", 100), ("batch", "kept", 25)}
    live = T.Progress()
    spark.streams.addListener(live)
    try:
        stream = streamed(spark, tmp_path, [[(i,) for i in range(10)], [(i,) for i in range(10, 16)]], "id long")
        ran(live.counted(live.counted(stream, "read").where("id % 2 = 0"), "kept"), tmp_path, "counted")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(live)
    sums = {r.stage: r.n for r in live.rows(spark).groupBy("stage").agg(F.sum("rows").alias("n")).collect()}
    assert sums == {"read": 16, "kept": 8} and live.rows(spark).where("rows > 0").select("batch").distinct().count() == 2


def test_only_changed_buckets_are_written(spark, tmp_path):
    path = f"{tmp_path}/windows"
    texts = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(60)] + [(99, "")], "record_id long, text string")
    made = lambda df: K.reembedded(df, "record_id", X.latin_key(F.col("text")), lambda k: X.windows(k, "en"))
    K.store(made(texts), path, "record_id", 8)
    files = lambda: {(d, f) for d in os.listdir(path) if d.startswith("bucket=") for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")}
    before = files()
    changed = texts.where("record_id in (3, 7)").withColumn("text", F.concat("text", F.lit(" and more")))
    K.restore(made(changed), path, "record_id", 8)
    touched = {f"bucket={r.bucket}" for r in K.bucketed(changed, "record_id", 8).select("bucket").distinct().collect()}
    assert {f for f in before if f[0] not in touched} == {f for f in files() if f[0] not in touched} and 0 < len(touched) <= 2
    assert not before & {f for f in files() if f[0] in touched}
    want = made(texts.where("record_id not in (3, 7)").unionByName(changed))
    assert spark.read.parquet(path).select(*want.columns).exceptAll(want).isEmpty() and spark.read.parquet(path).count() == want.count()
    before = files()
    K.restore(made(changed.limit(0)), path, "record_id", 8)
    assert files() == before


def test_median_sketch(spark):
    rows = spark.range(40_001).select((F.col("id") % 3).cast("string").alias("group"), F.lit(True).alias("ok"), F.lit(False).alias("wrong"), F.col("id").cast("double").alias("ms"))
    total = E.group_metrics(rows, 1000).where("group is null").first()
    assert abs(total.median_ms - 20_000) <= 40_001 / 1000 and E.group_metrics(rows.limit(7)).where("group is null").first().median_ms == 3


def test_median_is_exact(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 4 > 0, (F.col("id") % 4).cast("string")).alias("group"), F.lit(True).alias("ok"), F.lit(False).alias("wrong"), F.when(F.col("id") % 8 != 1, F.col("id").cast("double")).alias("ms"))
    want = {tuple(r) for r in rows.rollup("group").agg(F.count(F.lit(1)), F.expr("percentile(ms, 0.5)")).collect()}
    for ranks in (10_000, 20):
        assert {(r.group, r.n, r.median_ms) for r in E.group_metrics(rows, ranks).collect()} == want
    assert E.group_metrics(rows.withColumn("ms", F.lit(None).cast("double"))).where("n = 40000").first().median_ms is None


def test_forms_of_a_long_text_in_time(spark):
    import time

    rows = spark.createDataFrame([(i, " ".join(f"word{j}" for j in range(60_000))) for i in range(4)], "record_id long, key string")
    start = time.time()
    for r in rows.select("key", *(E.FORMS[f](F.col("record_id"), F.col("key")).alias(f) for f in ("variant", "misquote"))).collect():
        assert sum(a != b for a, b in zip(r.key.split(" "), r.misquote.split(" "))) == 1 and r.variant != r.key
    assert time.time() - start < 60
