"""Commits over several tables, and the changes that go through them."""

import datetime as dt
import os
import subprocess
import sys
import textwrap
import threading

import pytest
from pyspark.sql import functions as F

from cinemill.operators import changes as X
from cinemill.operators import reconcile as R
from cinemill.sources.commits import Conflict, Tables


def frame(spark, rows, schema="id long, v string"):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def store(spark, tmp_path):
    return Tables(spark, f"file://{tmp_path}/tables")


def test_versions_show_all_tables_of_one_commit(spark, store):
    assert store.snapshot().version == 0
    first = store.commit(lambda s: {"a": frame(spark, [(1, "x")]), "b": frame(spark, [(1, "y")])})
    second = store.commit(lambda s: {"a": s["a"].withColumn("v", F.lit("z"))})
    assert (first.version, second.version) == (1, 2)
    assert rows(first["a"]) == [(1, "x")] and rows(second["a"]) == [(1, "z")] and rows(second["b"]) == [(1, "y")]
    assert store.commit(lambda s: {}).version == 2 and "c" not in second


def test_two_writers_never_claim_one_job(spark, store):
    jobs = [(i, "pending", i % 3, dt.datetime(2024, 1, 1), None) for i in range(6)]
    store.commit(lambda s: {"jobs": frame(spark, jobs, "id long, status string, priority int, created_at timestamp_ntz, worker_id string")})
    tries = {"w1": 0, "w2": 0}
    together = threading.Barrier(2)

    def work(name):
        def claim(s):
            tries[name] += 1
            if tries[name] == 1:
                together.wait(60)  # both have read the same version
            return {"jobs": X.claimed(s["jobs"], name, "2024-01-02 00:00:00")}

        for _ in range(2):
            store.commit(claim)

    threads = [threading.Thread(target=work, args=(n,)) for n in tries]
    for t in threads:
        t.start()
    for t in threads:
        t.join(180)
    got = store.snapshot()["jobs"].where("status = 'running'").collect()
    assert sorted(r.worker_id for r in got) == ["w1", "w1", "w2", "w2"] and sorted(r.id for r in got) == [0, 1, 3, 4]
    assert sum(tries.values()) >= 5 and store.snapshot().version == 5  # one of them ran again


def test_only_one_session_begins(spark, store):
    now = dt.datetime(2024, 1, 1, 0, 2)
    schema = "session_id string, status string, last_heartbeat_at timestamp_ntz"
    store.commit(lambda s: {"sessions": frame(spark, [("old", "in_progress", dt.datetime(2024, 1, 1))], schema)})
    together, ended = threading.Barrier(2), {}

    def begin(name):
        first = []

        def change(s):
            if not first:
                first.append(together.wait(60))
            return {"sessions": R.begin(s["sessions"], now).unionByName(frame(spark, [(name, "in_progress", now)], schema))}

        try:
            ended[name] = store.commit(change).version
        except RuntimeError:
            ended[name] = None

    threads = [threading.Thread(target=begin, args=(n,)) for n in ("a", "b")]
    for t in threads:
        t.start()
    for t in threads:
        t.join(180)
    assert sorted(ended.values(), key=str) == [2, None]
    assert [r.status for r in store.snapshot()["sessions"].orderBy("session_id").collect()].count("in_progress") == 1


def test_writers_of_other_tables_do_not_run_again(spark, store):
    store.commit(lambda s: {"a": frame(spark, [(1, "x")]), "b": frame(spark, [(1, "y")])})
    runs = []

    def slow(s):
        runs.append(s.version)
        if len(runs) == 1:
            store.commit(lambda t: {"b": frame(spark, [(2, "w")])})
        return {"a": s["a"].withColumn("v", F.lit("slow"))}

    last = store.commit(slow, reads=["a"])
    assert runs == [1] and last.version == 3 and rows(last["a"]) == [(1, "slow")] and rows(last["b"]) == [(2, "w")]
    runs.clear()
    last = store.commit(slow)  # reads all tables: meets the new b and runs again
    assert len(runs) == 2 and last.version == 5


def test_a_writer_that_always_loses_gives_up(spark, store):
    store.commit(lambda s: {"a": frame(spark, [(1, "x")])})

    def loses(s):
        store.commit(lambda t: {"a": frame(spark, [(s.version, "other")])})
        return {"a": frame(spark, [(9, "mine")])}

    with pytest.raises(Conflict):
        store.commit(loses, attempts=2)
    assert rows(store.snapshot()["a"]) == [(2, "other")]


def test_a_killed_writer_leaves_nothing_visible(spark, store, tmp_path):
    store.commit(lambda s: {"a": frame(spark, [(1, "x")]), "b": frame(spark, [(1, "y")])})
    code = textwrap.dedent(
        f"""
        import os, signal
        from pyspark.sql import SparkSession
        from cinemill.sources.commits import Tables
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
        store = Tables(spark, "file://{tmp_path}/tables")
        store._publish = lambda *_: os.kill(os.getpid(), signal.SIGKILL)  # dies with both tables staged
        store.commit(lambda s: {{"a": spark.range(5), "b": spark.range(7)}})
        """
    )
    done = subprocess.run([sys.executable, "-c", code], env=os.environ, capture_output=True, timeout=120)
    assert done.returncode == -9
    seen = store.snapshot()
    assert seen.version == 1 and rows(seen["a"]) == [(1, "x")] and rows(seen["b"]) == [(1, "y")]
    assert store.vacuum() == []  # a running writer's tables look the same: they stay for a day
    assert len(store.vacuum(idle_seconds=0)) == 2
    after = store.commit(lambda s: {"a": s["a"].withColumn("v", F.lit("z"))})
    assert after.version == 2 and rows(after["a"]) == [(1, "z")]


def test_vacuum_keeps_named_tables(spark, store):
    for i in range(4):
        store.commit(lambda s, i=i: {"a": frame(spark, [(i, "x")])} | ({"b": frame(spark, [(i, "y")])} if i == 0 else {}))
    assert len(store.vacuum(keep=1, idle_seconds=0)) == 3 and store.versions() == [4]
    last = store.snapshot()
    assert rows(last["a"]) == [(3, "x")] and rows(last["b"]) == [(0, "y")]


FILES = "id long, path string, size long, expected_hash string, created_at string"
TRACKS = "file_id long, stream_index int, codec string"


def test_merge_keeps_the_id_and_replaces_children(spark):
    files = frame(spark, [(1, "/a", 10, "e1", "old"), (2, "/b", 20, None, "old"), (3, None, 30, "e3", "old"), (4, None, 40, None, "old")], FILES)
    tracks = frame(spark, [(1, 0, "h264"), (1, 1, "aac"), (2, 0, "av1"), (3, 0, "dts")], TRACKS)
    new_files = frame(spark, [(91, "/a", 11, "n", "new", 1), (92, "/a", 12, "m", "new", 2), (93, "/c", 5, "p", "new", 3), (94, "/c", 6, "q", "newer", 4), (95, None, 7, "r", "new", 5)], FILES + ", seq long")
    new_tracks = frame(spark, [(91, 0, "lost", 1), (92, 0, "hevc", 2), (93, 0, "lost", 3), (94, 0, "vp9", 4), (94, 1, "opus", 4), (95, 0, "lost", 5)], TRACKS + ", seq long")
    got = X.merged(files, tracks, new_files, new_tracks, kept=("id", "created_at", "expected_hash"))
    assert rows(got["files"]) == [(1, "/a", 12, "e1", "old"), (2, "/b", 20, None, "old"), (3, None, 30, "e3", "old"), (4, None, 40, None, "old"), (93, "/c", 6, "p", "new")]
    assert rows(got["tracks"]) == [(1, 0, "hevc"), (2, 0, "av1"), (3, 0, "dts"), (93, 0, "vp9"), (93, 1, "opus")]
    same = X.merged(files, tracks, new_files.limit(0), new_tracks.limit(0), kept=("id", "created_at", "expected_hash"))
    assert rows(same["files"]) == rows(files) and rows(same["tracks"]) == rows(tracks)


def test_job_commands(spark):
    schema = "id long, job_type string, priority int, payload string, status string, created_at timestamp_ntz, started_at timestamp_ntz, completed_at timestamp_ntz, worker_id string, error string"
    t = dt.datetime(2024, 1, 1)
    kinds = ("pending", "running", "completed", "failed", "cancelled")
    jobs = frame(spark, [(i, "scan", i, f"p{i}", k, t, None, None, None, "e") for i, k in enumerate(kinds)], schema)
    ids = frame(spark, [(i,) for i in range(5)] + [(0,)], "id long")
    now = "2024-02-01 00:00:00"
    assert [(r.id, r.status, r.completed_at is not None) for r in X.cancelled(jobs, ids, now).orderBy("id").collect()] == [(0, "cancelled", True), (1, "cancelled", True), (2, "completed", False), (3, "failed", False), (4, "cancelled", False)]
    again = X.retried(jobs, ids, now, F.col("id") + 100).orderBy("id").collect()
    assert len(again) == 6 and again[3].status == "failed"
    assert (again[5].id, again[5].status, again[5].payload, again[5].priority, again[5].error, again[5].created_at) == (103, "pending", "p3", 3, None, dt.datetime(2024, 2, 1))
    assert sorted(r.status for r in X.cleared(jobs).collect()) == ["pending", "running"] and X.cleared(jobs, "failed").count() == 4
    with pytest.raises(ValueError):
        X.cleared(jobs, "running")
    assert rows(X.claimed(jobs, "w", now, job_id=1).select("id", "worker_id")) == rows(jobs.select("id", "worker_id"))  # not pending
    mine = X.claimed(jobs, "w", now).where("worker_id = 'w'").collect()
    assert [(r.id, r.status, r.started_at) for r in mine] == [(0, "running", dt.datetime(2024, 2, 1))]
