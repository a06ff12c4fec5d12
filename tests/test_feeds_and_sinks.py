"""Streams give what the batch twins give; sinks read back what they wrote."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from cinemill.functions import media as M
from cinemill.operators import reconcile as R
from cinemill.sources import library as L
from cinemill.sources import sinks
from cinemill.streaming import feeds


def drained(stream, name, spark, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_follow_equals_batch(spark, sf_dir, tmp_path):
    log = L.event_log(spark, sf_dir)
    log.repartition(3).write.parquet(f"{tmp_path}/log")
    got = drained(feeds.follow(spark, f"{tmp_path}/log", log.schema, "job.*", 100, 1), "followed", spark)
    wanted = log.where("startswith(event_type, 'job.') and rowid > 100")
    assert got.exceptAll(wanted).count() == 0 and got.count() == wanted.count()


def test_windows_equal_batch(spark, sf_dir, tmp_path):
    stats = L.plugin_stats(spark, sf_dir).withColumn("started_at", F.col("started_at").cast("timestamp"))
    stats.repartition(2).write.parquet(f"{tmp_path}/stats")
    stream = spark.readStream.schema(stats.schema).parquet(f"{tmp_path}/stats")
    got = drained(feeds.latency_windows(stream), "windows", spark, "complete")
    wanted = feeds.latency_windows(stats)
    assert got.exceptAll(wanted).count() == 0 and got.count() == wanted.count()


def test_discovery_walks_once(spark, tmp_path):
    for name in ("a/x.mkv", "a/b/y.MP4", "a/notes.txt", "a/.hidden.mkv", "z.tmp.mkv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"123")
    batch = feeds.discovered(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in batch.collect()) == ["x.mkv", "y.MP4"]
    got = drained(feeds.once_per_path(feeds.discovered(spark, str(tmp_path), stream=True), "modified_at"), "walked", spark)
    assert sorted((r.path, r.size) for r in got.collect()) == sorted((r.path, r.size) for r in batch.collect())


def test_gate_holds_until_the_marker(spark, tmp_path):
    schema = "root string, path string, done boolean"
    parts = [[("a", "a1", False), ("b", "b1", False)], [("a", "", True)], [("a", "a2", False)]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/rows")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/rows")
    assert sorted(r.path for r in drained(feeds.gate_by_root(stream), "gated", spark).collect()) == ["a1", "a2"]


def test_router_splits_and_repeats_safely(spark, sf_dir, tmp_path):
    log = L.event_log(spark, sf_dir)
    write = feeds.routed({"jobs": (F.col("event_type").startswith("job."), f"{tmp_path}/jobs"), "all": (F.lit(True), f"{tmp_path}/all")})
    write(log, 0)
    write(log, 0)
    assert spark.read.parquet(f"{tmp_path}/all").count() == log.count()
    assert spark.read.parquet(f"{tmp_path}/jobs").count() == log.where("startswith(event_type, 'job.')").count()


def test_sent_events(spark):
    rows = [(1, "file.discovered", '{"path":"/m/a/b.mkv"}'), (2, "plugin.error", "{}")]
    got = feeds.sent_events(spark.createDataFrame(rows, "rowid long, event_type string, payload string")).collect()
    assert [(r.event_type, json.loads(r.data)) for r in got] == [("file.discovered", {"id": 1, "file": "b.mkv"})]


def test_sinks_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", None), (2, "y", "d")], "id long, name string, destination string")
    sinks.append_lines(df, f"{tmp_path}/l")
    sinks.append_lines(df, f"{tmp_path}/l")
    assert sinks.read_lines(spark, f"{tmp_path}/l", "id long, name string, destination string", "d").count() == 2
    sinks.report(df, "csv", f"{tmp_path}/c")
    assert spark.read.csv(f"{tmp_path}/c", header=True).count() == 2
    sinks.report(df, "json", f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    sinks.report(df, "plain", f"{tmp_path}/p")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/p").collect()) == ["1\tx\t", "2\ty\td"]
    sinks.export_tsv(df, f"{tmp_path}/t")
    assert spark.read.csv(f"{tmp_path}/t", sep="\t", header=True).count() == 2
    assert sorted(json.loads(x)["id"] for x in sinks.json_rows(df)) == [1, 2]
    assert sinks.report(df, "table").splitlines() == ["id | name | destination", "---+------+------------", "1  | x    | NULL", "2  | y    | d"]
    assert sinks.report(df.orderBy("id"), "table", rows=1).endswith("(1 more)") and len(sinks.report(df.limit(0), "table").splitlines()) == 2
    sinks.compacted(df.repartition(2), f"{tmp_path}/k")
    assert sinks.storage_stats(spark.read.parquet(f"{tmp_path}/k")).first()["files"] >= 1
    assert list(sinks.sections({"a": df, "b": df}, ("b",))) == ["b"] and len(sinks.sections({"a": df})) == 1
    with pytest.raises(ValueError):
        sinks.sections({"a": df}, ("z",))


def test_sessions_begin(spark):
    now = dt.datetime(2024, 1, 1, 0, 2)
    rows = [("old", "in_progress", dt.datetime(2024, 1, 1)), ("done", "completed", dt.datetime(2024, 1, 1))]
    schema = "session_id string, status string, last_heartbeat_at timestamp_ntz"
    got = {r.session_id: r.status for r in R.begin(spark.createDataFrame(rows, schema), now).collect()}
    assert got == {"old": "cancelled", "done": "completed"}
    with pytest.raises(RuntimeError):
        R.begin(spark.createDataFrame([("live", "in_progress", now)], schema), now)


def test_since_forms():
    now = dt.datetime(2024, 3, 1)
    assert M.since("30d", now) == dt.datetime(2024, 1, 31) and M.since("4w", now) == dt.datetime(2024, 2, 2) and M.since("12h", now) == dt.datetime(2024, 2, 29, 12)
    assert M.since("2024-01-02", now) == dt.datetime(2024, 1, 2) and M.since("2024-01-02T03:04:05", now) == dt.datetime(2024, 1, 2, 3, 4, 5)
    with pytest.raises(ValueError):
        M.since("soon", now)


def test_gate_through_tables_releases_each_row_once(spark, tmp_path):
    write = feeds.gate_through_tables(f"file://{tmp_path}/gate")
    batches = [[("a", "a/1", False), ("b", "b/1", False)], [("a", None, True), ("a", "a/2", False)], [("b", "b/2", False), ("a", "a/3", False)], [("b", None, True)]]
    for n, rows in enumerate(batches):
        for _ in range(2):  # a batch may be tried again
            write(spark.createDataFrame(rows, "root string, path string, done boolean"), n)
    out = spark.read.schema("root string, path string, batch long").parquet(f"file://{tmp_path}/gate/out").collect()
    assert sorted((r.batch, r.path) for r in out) == [(1, "a/1"), (1, "a/2"), (2, "a/3"), (3, "b/1"), (3, "b/2")]
    left = spark.read.schema("root string, path string, batch long").parquet(f"file://{tmp_path}/gate/waiting").groupBy("batch").count().collect()
    assert {r.batch: r["count"] for r in left} == {0: 2, 1: 1, 2: 2}  # only what waits is carried on


def test_snapshot_follows_lifecycle_events_only(spark, tmp_path):
    at = f"{tmp_path}/snap"
    write = feeds.snapshot_on(("scan.complete",), lambda s: s.range(3).selectExpr("count(*) as total_files"), f"file://{at}")
    log = lambda *kinds: spark.createDataFrame([(i, k, "2024-01-01") for i, k in enumerate(kinds)], "rowid long, event_type string, created_at string")
    write(log("file.discovered"), 0)
    write(log("file.discovered", "scan.complete"), 1)
    got = spark.read.parquet(f"file://{at}").collect()
    assert [(r.total_files, r.trigger, r.batch) for r in got] == [(3, "scan.complete", 1)]
