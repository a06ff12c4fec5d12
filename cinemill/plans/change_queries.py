"""Queries over changed tables: upserts of files with their tracks, executed plans and job commands, committed together."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cinemill.operators import changes as X
from cinemill.plans.registry import query
from cinemill.sources import library as L
from cinemill.sources.commits import Snapshot, Tables, shared_folder

NOW = "2030-01-01 00:00:00"


def committed(spark, tables: dict, *steps) -> Snapshot:
    """The version that holds tables after the steps, each one commit."""
    store = Tables(spark, f"{shared_folder(spark)}/catalogue-{uuid.uuid4().hex}")
    store.commit(lambda _: tables)
    for step in steps:
        last = store.commit(step)
    return last


def _files(spark, d):
    return L.files(spark, d).select("id", "path", "filename", "size", "content_hash", "expected_hash", "status", "created_at")


def _upserted(spark, d):
    """A scan's rows: every third file again under another id (every sixth of them twice), and as many unknown paths."""
    files, tracks = _files(spark, d), L.tracks(spark, d).select("file_id", "stream_index", "codec", "language")
    k = F.col("id")
    again = files.where(k % 3 == 0)
    first = again.select((k + 100_000_000_000).alias("id"), "path", "filename", (F.col("size") + 1).alias("size"), F.lit("n").alias("content_hash"), F.lit("x").alias("expected_hash"), F.lit("active").alias("status"), F.lit(NOW).cast("timestamp_ntz").alias("created_at"), k.alias("seq"), k.alias("_old"))
    second = first.where(F.col("seq") % 6 == 0).withColumns({"id": k + 100_000_000_000, "size": F.col("size") + 1, "seq": F.col("seq") + 10_000_000})
    fresh = first.withColumns({"id": k + 300_000_000_000, "path": F.concat("path", F.lit(".new")), "seq": F.col("seq") + 20_000_000})
    rows = first.unionByName(second).unionByName(fresh)
    new_tracks = rows.join(tracks.withColumnRenamed("file_id", "_old"), "_old").where("stream_index < 2").select(F.col("id").alias("file_id"), "stream_index", F.concat(F.lit("n"), "codec").alias("codec"), "language", "seq")
    return committed(spark, {"files": files, "tracks": tracks}, lambda s: X.merged(s["files"], s["tracks"], rows, new_tracks))


@query(
    "s09_upsert_keeps_ids",
    f"""
    SELECT id, path, size + CASE WHEN id % 6 = 0 THEN 2 WHEN id % 3 = 0 THEN 1 ELSE 0 END AS size, CASE WHEN id % 3 = 0 THEN 'n' ELSE content_hash END AS content_hash,
      expected_hash, CASE WHEN id % 3 = 0 THEN 'active' ELSE status END AS status, created_at FROM files
    UNION ALL
    SELECT id + 400000000000, path || '.new', size + 1, 'n', 'x', 'active', TIMESTAMP '{NOW}' FROM files WHERE id % 3 = 0
    """,
)
def upsert_keeps_ids(spark, d):
    return _upserted(spark, d)["files"].select("id", "path", "size", "content_hash", "expected_hash", "status", "created_at")


@query(
    "s09_upsert_replaces_tracks",
    """
    SELECT file_id, stream_index, CASE WHEN file_id % 3 = 0 THEN 'n' ELSE '' END || codec AS codec, language FROM tracks WHERE file_id % 3 <> 0 OR stream_index < 2
    UNION ALL
    SELECT file_id + 400000000000, stream_index, 'n' || codec, language FROM tracks WHERE file_id % 3 = 0 AND stream_index < 2
    """,
)
def upsert_replaces_tracks(spark, d):
    return _upserted(spark, d)["tracks"]


@query(
    "t09_post_execution_bundle",
    """
    WITH b AS (
      SELECT id + 100000000000 AS id, file_id, '/media/' || CASE file_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c_d' END || '/f' || file_id AS path, from_path, outcome,
        CASE WHEN id % 2 = 0 THEN '/media/done/' || id || '.mkv' END AS new_path, CASE WHEN id % 5 <> 0 THEN 'e' || id END AS new_hash
      FROM transitions WHERE executor IS NOT NULL AND outcome = 'success' AND file_id % 4 <> 0),
    s AS (SELECT file_id, arg_max(new_path, id) FILTER (new_path IS NOT NULL) AS new_path, arg_max(new_hash, id) FILTER (new_hash IS NOT NULL) AS new_hash FROM b GROUP BY 1)
    SELECT 'files' AS name, f.id, coalesce(s.new_path, f.path) AS path, CASE WHEN s.new_path IS NULL THEN f.filename ELSE split_part(s.new_path, '/', 4) END AS detail, coalesce(s.new_hash, f.expected_hash) AS hash
    FROM files f LEFT JOIN s ON s.file_id = f.id
    UNION ALL SELECT 'transitions', id, path, outcome, NULL FROM transitions UNION ALL SELECT 'transitions', id, path, outcome, NULL FROM b
    UNION ALL SELECT 'bad_files', id, path, error, NULL FROM bad_files WHERE path NOT IN (SELECT path FROM b)
    """,
)
def post_execution(spark, d):
    t = L.transitions(spark, d).select("id", "file_id", "path", "from_path", "outcome", "executor")
    k = F.col("id")
    path = F.concat(F.lit("/media/"), L.pick(("a", "b", "c_d"), F.col("file_id")), F.lit("/f"), F.col("file_id").cast("string"))
    done = t.where("executor IS NOT NULL AND outcome = 'success' AND file_id % 4 <> 0")
    bundles = done.withColumns({"seq": k, "path": path, "new_path": F.when(k % 2 == 0, F.concat(F.lit("/media/done/"), k.cast("string"), F.lit(".mkv"))), "new_expected_hash": F.when(k % 5 != 0, F.concat(F.lit("e"), k.cast("string")))})
    bundles = bundles.withColumn("id", k + 100_000_000_000)
    tables = {"files": _files(spark, d), "transitions": t, "bad_files": L.bad_files(spark, d)}
    last = committed(spark, tables, lambda s: X.executed(s["files"], s["transitions"], s["bad_files"], bundles))
    row = lambda name, detail, hash_: last[name].select(F.lit(name).alias("name"), "id", "path", F.col(detail).alias("detail"), hash_.alias("hash"))
    return row("files", "filename", F.col("expected_hash")).unionByName(row("transitions", "outcome", F.lit(None).cast("string"))).unionByName(row("bad_files", "error", F.lit(None).cast("string")))


@query(
    "t26_k03_job_commands",
    f"""
    WITH one AS (SELECT id FROM jobs WHERE status = 'pending' ORDER BY priority, created_at, id LIMIT 1),
    claimed AS (SELECT id, job_type, priority, CASE WHEN id IN (FROM one) THEN 'running' ELSE status END AS status, created_at, completed_at, CASE WHEN id IN (FROM one) THEN 'w1' END AS worker_id FROM jobs),
    stopped AS (
      SELECT id, job_type, priority, CASE WHEN c THEN 'cancelled' ELSE status END AS status, created_at, CASE WHEN c THEN TIMESTAMP '{NOW}' ELSE completed_at END AS completed_at, worker_id
      FROM (SELECT *, id % 7 = 0 AND status IN ('pending', 'running') AS c FROM claimed)),
    again AS (SELECT * FROM stopped UNION ALL SELECT id + 100000000000, job_type, priority, 'pending', TIMESTAMP '{NOW}', NULL, NULL FROM stopped WHERE status = 'failed' AND id % 2 = 1)
    SELECT * FROM again WHERE status <> 'completed'
    """,
)
def job_commands(spark, d):
    jobs = L.jobs(spark, d).select("id", "job_type", "priority", "status", "created_at", "completed_at", F.lit(None).cast("string").alias("worker_id"))
    some = lambda s, c: s["jobs"].where(c).select("id")
    return committed(
        spark, {"jobs": jobs},
        lambda s: {"jobs": X.claimed(s["jobs"], "w1", NOW)},
        lambda s: {"jobs": X.cancelled(s["jobs"], some(s, "id % 7 = 0"), NOW)},
        lambda s: {"jobs": X.retried(s["jobs"], some(s, "id % 2 = 1"), NOW, F.col("id") + 100_000_000_000)},
        lambda s: {"jobs": X.cleared(s["jobs"], "completed")},
    )["jobs"]
