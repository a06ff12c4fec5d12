"""The chained scan: restarts in the middle of a batch give what one batch over everything gives."""

import json
import os

import pytest

from cinemill.operators import probe as P
from cinemill.sources.commits import Added, Tables
from cinemill.streaming import feeds
from cinemill.streaming.scan import scanning


def prober(documents, fail_at=()):
    """Looks documents up by file name; fails once on each of the given calls."""
    calls, fail_at = [0], set(fail_at)

    def probe(rows):
        calls[0] += 1
        if calls[0] in fail_at:
            raise RuntimeError(f"probe {calls[0]} fails")
        from cinemill.operators.changes import base_name

        named = rows.withColumn("name", base_name(rows.path)).join(documents, "name", "left").selectExpr("path", "size", "CAST(NULL AS string) AS content_hash", "document")
        return P.probed_files(named).select("path", "problem"), P.probed_tracks(named).select("path", "index", "track_type", "codec")

    return probe, calls


def state(store):
    s = store.snapshot()
    plain = lambda df: sorted(map(tuple, df.collect()), key=str)
    return plain(s["files"].drop("modified_at")), plain(s["tracks"]), s["waiting"].count()


@pytest.fixture
def documents(spark):
    doc = lambda *kinds: json.dumps({"streams": [{"codec_type": k, "codec_name": c} for k, c in kinds]})
    return spark.createDataFrame([(f"f{i}.mkv", doc(("video", "h264"), *[("audio", "aac")] * (i % 3)) if i % 4 else "{broken") for i in range(12)], "name string, document string")


def put(folder, name, size):
    os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
    with open(f"{folder}/{name}", "wb") as f:
        f.write(b"x" * size)


def stream(spark, root, store, probe, at):
    found = feeds.discovered(spark, root, stream=True, per_trigger=3).select("path", "size", "modified_at")
    q = found.writeStream.foreachBatch(scanning(store, probe)).option("checkpointLocation", at).trigger(availableNow=True).start()
    return q.awaitTermination(180)


def test_restarts_in_mid_batch_equal_one_batch(spark, tmp_path, documents):
    root = f"{tmp_path}/media"
    for i in range(7):
        put(root, f"d{i % 2}/f{i}.mkv", i + 1)
    store, twin = Tables(spark, f"file://{tmp_path}/stream"), Tables(spark, f"file://{tmp_path}/whole")
    probe, calls = prober(documents, fail_at=(1, 3))
    crashes = 0
    for _ in range(6):
        try:
            stream(spark, root, store, probe, f"{tmp_path}/ck")
            break
        except Exception:
            crashes += 1
            waiting = store.snapshot()["waiting"].count()
            assert 0 < waiting <= 3  # ingested, not probed; never more than one batch is admitted
    assert crashes == 2 and calls[0] == 5
    for i in range(7, 12):
        put(root, f"d{i % 2}/f{i}.mkv", i + 1)
    stream(spark, root, store, prober(documents)[0], f"{tmp_path}/ck")
    scanning(twin, prober(documents)[0])(feeds.discovered(spark, root).select("path", "size", "modified_at"), 0)
    assert state(store) == state(twin)
    files, tracks, waiting = state(store)
    assert len(files) == 12 and waiting == 0 and sum(f[-1] == "malformed" for f in files) == 3 and len(tracks) == sum(1 + i % 3 for i in range(12) if i % 4)


def test_a_batch_again_changes_nothing(spark, tmp_path, documents):
    store = Tables(spark, f"file://{tmp_path}/tables")
    row = lambda path, size, day: (path, size, f"2024-01-0{day}")
    frame = lambda *rows: spark.createDataFrame(rows, "path string, size long, at string").selectExpr("path", "size", "CAST(at AS timestamp) AS modified_at")
    write = scanning(store, prober(documents)[0])
    write(frame(row("/f1.mkv", 1, 1), row("/f1.mkv", 2, 2), row("/f2.mkv", 5, 1)), 0)
    first, version = state(store), store.snapshot().version
    write(frame(row("/f1.mkv", 1, 1), row("/f1.mkv", 2, 2), row("/f2.mkv", 5, 1)), 0)
    assert state(store) == first and store.snapshot().version == version
    write(frame(row("/f1.mkv", 2, 2), row("/f2.mkv", 9, 3)), 1)  # one is unchanged
    files = {f[0]: f[2] for f in state(store)[0]}
    assert files == {"/f1.mkv": 2, "/f2.mkv": 9}
    write(frame(row("/f2.mkv", 1, 2)), 2)  # an older listing
    assert {f[0]: f[2] for f in state(store)[0]} == files
    write(frame().limit(0), 3)
    assert state(store)[2] == 0


def test_added_rows_leave_the_others_in_place(spark, tmp_path):
    store = Tables(spark, f"file://{tmp_path}/tables")
    store.commit(lambda s: {"log": spark.range(2)})
    store.commit(lambda s: {"log": Added(spark.range(5, 7))})
    last = store.commit(lambda s: {"log": Added(spark.range(9, 10)), "other": Added(spark.range(1))})
    assert sorted(r.id for r in last["log"].collect()) == [0, 1, 5, 6, 9] and len(last.folders["log"]) == 3 and last["other"].count() == 1
    assert len(store.vacuum(keep=1, idle_seconds=0)) == 0
    store.commit(lambda s: {"log": s["log"].where("id > 4")})
    assert len(store.vacuum(keep=1, idle_seconds=0)) == 3 and store.snapshot()["log"].count() == 3
