"""Registered queries of reconciliation and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinemill.functions import media as M
from cinemill.operators import audit as A
from cinemill.operators import catalogue as C
from cinemill.operators import reconcile as R
from cinemill.plans.registry import query
from cinemill.sources import library as L

ROOTS = ["/media/1-URGENT", "/media/2-HIGH", "/media/3-MEDIUM"]
_UNDER = "(" + " OR ".join(f"starts_with({{0}}, '{r}/')" for r in ROOTS) + ")"
_PRE = f"""found AS (SELECT CASE WHEN id % 17 = 0 THEN replace(path, '.', '-b.') ELSE path END AS path, id AS seq, size + id % 2 AS size, CASE WHEN id % 13 = 0 THEN 'x' || content_hash ELSE content_hash END AS hash FROM files WHERE id % 10 <> 3 AND {_UNDER.format("path")}
      UNION ALL SELECT path, id + 100000000, size, content_hash FROM files WHERE id % 19 = 0 AND {_UNDER.format("path")}),
    sess AS (SELECT 's0' AS session_id, 'completed' AS status UNION ALL SELECT 's1', 'cancelled' UNION ALL SELECT 's2', 'completed'),
    known AS (SELECT f.* FROM files f LEFT JOIN sess s ON s.session_id = f.last_seen_session_id WHERE f.last_seen_session_id IS NULL OR coalesce(s.status = 'completed', false)),
    ff AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq) AS fn FROM found),
    met AS (SELECT ff.path, ff.seq, ff.size, ff.hash, k.id, k.expected_hash FROM ff LEFT JOIN known k ON k.path = ff.path AND k.status = 'active' WHERE fn = 1),
    absent AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY path) AS n FROM met WHERE id IS NULL),
    gone AS (SELECT id AS file_id, expected_hash AS hash, row_number() OVER (PARTITION BY expected_hash ORDER BY path) AS n FROM known WHERE status = 'missing' AND expected_hash IS NOT NULL AND {_UNDER.format("path")}),
    dec AS (SELECT path, seq, CASE WHEN expected_hash IS NULL OR expected_hash = hash THEN 'unchanged' ELSE 'externally_changed' END AS decision, id AS file_id, hash, size FROM met WHERE id IS NOT NULL
      UNION ALL SELECT a.path, a.seq, CASE WHEN g.file_id IS NOT NULL THEN 'moved' ELSE 'new' END, g.file_id, a.hash, a.size FROM absent a LEFT JOIN gone g ON g.hash = a.hash AND g.n = a.n
      UNION ALL SELECT path, seq, 'duplicate', NULL, hash, size FROM ff WHERE fn > 1),
    unseen AS (SELECT f.* FROM files f WHERE status = 'active' AND {_UNDER.format("path")} AND NOT EXISTS (SELECT 1 FROM dec d WHERE d.file_id = f.id)),
    fresh AS (SELECT hash, path, row_number() OVER (PARTITION BY hash ORDER BY path) AS n FROM dec WHERE decision = 'new'),
    un AS (SELECT id, expected_hash, row_number() OVER (PARTITION BY expected_hash ORDER BY path) AS n FROM unseen WHERE expected_hash IS NOT NULL),
    fin AS (SELECT u.id, CASE WHEN m.path IS NOT NULL THEN 'promoted' WHEN u.id % 23 = 0 THEN 'kept' ELSE 'missing' END AS outcome, coalesce(m.path, u.path) AS path FROM unseen u LEFT JOIN (SELECT un.id, fresh.path FROM un JOIN fresh ON fresh.hash = un.expected_hash AND fresh.n = un.n) m ON m.id = u.id)"""


def _scan(spark, d):
    f = L.files(spark, d).where(R.under_any(F.col("path"), ROOTS))
    k = F.col("id")
    a = f.where("id % 10 <> 3").select(
        F.when(k % 17 == 0, F.replace("path", F.lit("."), F.lit("-b."))).otherwise(F.col("path")).alias("path"), k.alias("seq"), (F.col("size") + k % 2).alias("size"),
        F.when(k % 13 == 0, F.concat(F.lit("x"), "content_hash")).otherwise(F.col("content_hash")).alias("hash"),
    )
    b = f.where("id % 19 = 0").select("path", (k + 100_000_000).alias("seq"), "size", F.col("content_hash").alias("hash"))
    sessions = spark.createDataFrame([("s0", "completed"), ("s1", "cancelled"), ("s2", "completed")], "session_id string, status string")
    return R.classify(a.unionByName(b), L.files(spark, d), sessions, ROOTS)


def _finished(spark, d):
    dec = _scan(spark, d)
    return dec, R.finish(dec, L.files(spark, d), L.files(spark, d).where("id % 23 = 0").select("path"), ROOTS)


@query("t02_t03_t05_j07_classify_scan", f"WITH {_PRE} SELECT path, seq, decision, file_id FROM dec")
def classify(spark, d):
    return _scan(spark, d).select("path", "seq", "decision", "file_id")


@query("t06_j08_j09_finish_scan", f"WITH {_PRE} SELECT * FROM fin")
def finish(spark, d):
    return _finished(spark, d)[1]


@query("t08_reconcile_counts", f"WITH {_PRE}, p AS (SELECT count(*) AS p FROM fin WHERE outcome = 'promoted') SELECT e.decision, coalesce(c.n, 0) + CASE e.decision WHEN 'new' THEN -p WHEN 'moved' THEN p ELSE 0 END AS n FROM (SELECT unnest(['duplicate', 'unchanged', 'externally_changed', 'moved', 'new', 'missing']) AS decision) e LEFT JOIN (SELECT decision, count(*) AS n FROM dec GROUP BY 1 UNION ALL SELECT 'missing', count(*) FROM fin WHERE outcome = 'missing') c ON c.decision = e.decision, p")
def counts(spark, d):
    return R.counts(*_finished(spark, d))


@query("t04_scan_transitions", f"WITH {_PRE} SELECT path, file_id, unnest(CASE decision WHEN 'externally_changed' THEN ['superseded', 'discovered'] WHEN 'moved' THEN ['moved'] WHEN 'new' THEN ['discovered'] ELSE [] END) AS kind FROM dec")
def scan_transitions(spark, d):
    return R.transitions(_scan(spark, d))


@query("s09_t09_catalogue_after_scan", f"WITH {_PRE} SELECT status, path IS NULL AS closed, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM (SELECT CASE WHEN d.decision = 'externally_changed' THEN NULL WHEN d.decision IS NOT NULL THEN d.path ELSE f.path END AS path, CASE WHEN d.decision IN ('unchanged', 'moved') THEN d.size ELSE f.size END AS size, CASE WHEN d.decision = 'externally_changed' THEN 'missing' WHEN d.decision IS NOT NULL THEN 'active' ELSE f.status END AS status FROM files f LEFT JOIN (SELECT * FROM dec WHERE decision IN ('unchanged', 'externally_changed', 'moved')) d ON d.file_id = f.id UNION ALL SELECT path, size, 'active' FROM dec WHERE decision IN ('new', 'externally_changed')) GROUP BY 1, 2")
def after_scan(spark, d):
    out = R.applied(L.files(spark, d), _scan(spark, d))
    return out.groupBy("status", F.col("path").isNull().alias("closed")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


@query("j10_missing_paths", "SELECT id FROM files WHERE status = 'active' AND starts_with(path, '/media/2-HIGH/') AND id % 10 = 3")
def missing_paths(spark, d):
    seen = L.files(spark, d).where("id % 10 <> 3").select("path")
    return L.files(spark, d).where("status = 'active'").where(C.under(F.col("path"), "/media/2-HIGH")).join(seen, "path", "left_anti").select("id")


@query("j11_under_roots", f"SELECT count(*) AS n FROM files WHERE {_UNDER.format('path')}")
def under_roots(spark, d):
    return L.files(spark, d).where(R.under_any(F.col("path"), ROOTS)).agg(F.count(F.lit(1)).alias("n"))


@query("j19_cascade_delete", "SELECT t.file_id, count(*) AS n FROM tracks t WHERE t.file_id NOT IN (SELECT id FROM files WHERE status = 'missing') GROUP BY 1")
def cascade(spark, d):
    gone = L.files(spark, d).where("status = 'missing'").select(F.col("id").alias("file_id"))
    return L.tracks(spark, d).join(gone, "file_id", "left_anti").groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))


@query("s01_t16_mutation_skip_set", "WITH m AS (SELECT DISTINCT p AS path FROM (SELECT path AS p FROM transitions WHERE source = 'engine' AND id % 7 = 0 UNION ALL SELECT from_path FROM transitions WHERE source = 'engine' AND id % 7 = 0 AND from_path IS NOT NULL)) SELECT t.id FROM transitions t WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.path = t.path)")
def mutations(spark, d):
    t = L.transitions(spark, d)
    own = R.mutation_rows(t.where("source = 'engine' and id % 7 = 0").select("session_id", "path", "from_path"))
    return t.join(own.select("path").distinct(), "path", "left_anti").select("id")


@query("t13_prune_against_listing", "SELECT id FROM files WHERE starts_with(path, '/media/1-URGENT/') AND id % 4 = 0")
def prune_listing(spark, d):
    listing = L.files(spark, d).where("id % 4 <> 0").select("path")
    return L.files(spark, d).where(C.under(F.col("path"), "/media/1-URGENT")).join(listing, "path", "left_anti").select("id")


@query("b01_codec_container_pivot", "SELECT t.codec, count(*) FILTER (f.container = 'mkv') AS mkv, count(*) FILTER (f.container = 'mp4') AS mp4, count(*) FILTER (f.container = 'webm') AS webm, count(*) FILTER (f.container IN ('mkv', 'mp4', 'webm')) AS total FROM tracks t JOIN files f ON f.id = t.file_id WHERE t.track_type = 'video' GROUP BY 1")
def codec_pivot(spark, d):
    df = L.tracks(spark, d).where("track_type = 'video'").join(L.files(spark, d).select(F.col("id").alias("file_id"), "container"), "file_id")
    return A.pivot_with_total(df, "codec", "container", ["mkv", "mp4", "webm"])


@query("b02_codec_language_pivot", "SELECT codec, count(*) FILTER (language = 'eng') AS eng, count(*) FILTER (language = 'jpn') AS jpn, count(*) FILTER (language = 'und') AS und, count(*) FILTER (language IN ('eng', 'jpn', 'und')) AS total FROM tracks WHERE track_type LIKE 'audio%' GROUP BY 1")
def language_pivot(spark, d):
    return A.pivot_with_total(L.tracks(spark, d).where(F.col("track_type").startswith("audio")), "codec", "language", ["eng", "jpn", "und"])


def _listings(spark, d):
    f = L.files(spark, d)
    a = f.where("id % 9 <> 0").select("path", "size", (F.col("id") % 100).alias("mtime"))
    b = f.where("id % 8 <> 0").select("path", F.when(F.col("id") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), (F.col("id") % 100 + F.when(F.col("id") % 7 == 0, 1).otherwise(0)).alias("mtime"))
    return a, b


_CHANGE = "CASE WHEN id % 8 = 0 THEN 'disappeared' WHEN id % 9 = 0 THEN 'new' WHEN id % 5 = 0 THEN 'size_changed' WHEN id % 7 = 0 THEN 'mtime_changed' ELSE 'unchanged' END"


@query("b05_j18_u02_snapshot_diff", f"SELECT path, {_CHANGE} AS change FROM files WHERE NOT (id % 8 = 0 AND id % 9 = 0)")
def snapshot_diff(spark, d):
    return A.snapshot_diff(*_listings(spark, d))


@query("b05_extension_tally", f"SELECT container AS ext, {_CHANGE} AS change, count(*) AS n FROM files WHERE NOT (id % 8 = 0 AND id % 9 = 0) GROUP BY 1, 2")
def tally(spark, d):
    return A.snapshot_diff(*_listings(spark, d)).groupBy(M.extension(F.col("path")).alias("ext"), "change").agg(F.count(F.lit(1)).alias("n"))


_REC = "SELECT path, 'pre' AS side, '*' AS field FROM files WHERE id % 8 = 0 UNION ALL SELECT path, 'both', 'container' FROM files WHERE id % 8 <> 0 AND id % 6 = 0 UNION ALL SELECT path, 'both', 'duration' FROM files WHERE id % 8 <> 0 AND id % 5 = 0"


def _records(spark, d):
    f = L.files(spark, d).select("id", "path", "container", "duration")
    b = f.where("id % 8 <> 0").select("path", F.when(F.col("id") % 6 == 0, "other").otherwise(F.col("container")).alias("container"), F.when(F.col("id") % 5 == 0, F.col("duration") * 1.02).otherwise(F.col("duration") * 1.001).alias("duration"))
    return A.record_diff(f, b, "path", ["container"], ["duration"])


@query("b03_x32_record_diff", _REC)
def record_diff(spark, d):
    return _records(spark, d)


@query("b04_diff_classes", f"SELECT side, field, count(*) AS n, count(DISTINCT path) AS files, min(path) AS sample FROM ({_REC}) GROUP BY 1, 2")
def diff_classes(spark, d):
    return _records(spark, d).groupBy("side", "field").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("files"), F.min("path").alias("sample"))


@query("b06_phase_summary", "SELECT phase_name, count(*) AS total, count(*) FILTER (status = 'failed') AS failed, min(id) AS first_seen FROM plans GROUP BY 1")
def phase_summary(spark, d):
    return L.plans(spark, d).groupBy("phase_name").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "failed").alias("failed"), F.min("id").alias("first_seen"))


#: The signature of error_message, for the SQL of other modules too.
SIG = """
CASE WHEN contains(error_message, 'failed to insert transcode outcome: FOREIGN KEY') THEN 'storage-fk-transcode-outcome'
  WHEN contains(error_message, 'CUDA_ERROR_OUT_OF_MEMORY') THEN 'cuda-context-oom'
  WHEN contains(error_message, 'CUDA_ERROR_UNKNOWN') THEN 'cuda-context-unknown'
  WHEN contains(error_message, 'InitializeEncoder failed: out of memory') THEN 'nvenc-initialize-oom'
  WHEN contains(error_message, 'Error submitting packet to decoder: Cannot allocate memory') THEN 'cuda-decoder-packet-oom'
  WHEN contains(error_message, 'Impossible to convert between the formats') THEN 'filter-format-conversion'
  WHEN contains(error_message, 'No device available for decoder') THEN 'no-hw-decoder-device'
  WHEN contains(error_message, 'Nothing was written into output file') THEN 'no-output-written'
  WHEN contains(error_message, 'Conversion failed') THEN 'ffmpeg-conversion-failed'
  WHEN contains(error_message, 'ffmpeg exited with exit status') THEN 'ffmpeg-nonzero' ELSE 'unknown' END"""


@query("b07_failure_clusters", f"SELECT phase_name, {SIG} AS signature, count(*) AS n, count(DISTINCT file_id) AS files, min(path) AS sample FROM transitions WHERE outcome = 'failure' GROUP BY 1, 2")
def clusters(spark, d):
    failed = L.transitions(spark, d).where("outcome = 'failure'").withColumn("signature", M.error_signature(F.col("error_message")))
    return A.clusters(failed, ["phase_name", "signature"], "path")


@query("b08_failure_timeline", f"SELECT date_trunc('hour', created_at) AS hour, count(*) FILTER ({SIG} = 'cuda-context-oom') AS \"cuda-context-oom\", count(*) FILTER ({SIG} = 'unknown') AS unknown, count(*) FILTER ({SIG} IN ('cuda-context-oom', 'unknown')) AS total FROM transitions WHERE outcome = 'failure' GROUP BY 1")
def timeline(spark, d):
    failed = L.transitions(spark, d).where("outcome = 'failure'").select(F.date_trunc("hour", "created_at").cast("timestamp_ntz").alias("hour"), M.error_signature(F.col("error_message")).alias("signature"))
    return A.pivot_with_total(failed, "hour", "signature", ["cuda-context-oom", "unknown"])


@query("b09_plan_differences", "SELECT id, difference FROM (SELECT id, unnest([CASE WHEN id % 11 = 0 THEN 'executed-only' END, CASE WHEN id % 7 = 0 AND id % 11 <> 0 THEN 'preview-only' END, CASE WHEN id % 7 <> 0 AND id % 11 <> 0 AND status = 'skipped' AND id % 3 = 0 THEN 'skip-reason' END, CASE WHEN id % 7 <> 0 AND id % 11 <> 0 AND id % 5 = 0 THEN 'action-params' END]) AS difference FROM plans WHERE NOT (id % 7 = 0 AND id % 11 = 0)) WHERE difference IS NOT NULL")
def plan_differences(spark, d):
    p, k = L.plans(spark, d), F.col("id")
    a = p.where("id % 11 <> 0").select("id", "skip_reason", (k % 10).alias("params"))
    b = p.where("id % 7 <> 0").select("id", F.when(k % 3 != 0, F.col("skip_reason")).alias("skip_reason"), (k % 10 + F.when(k % 5 == 0, 1).otherwise(0)).alias("params"))
    return A.plan_diff(a, b, ["id"])


@query("b10_w10_error_occurrences", f"SELECT id, signature, row_number() OVER (PARTITION BY signature ORDER BY created_at, id) AS occurrence FROM (SELECT *, {SIG} AS signature FROM transitions WHERE outcome = 'failure')")
def occurrences(spark, d):
    failed = L.transitions(spark, d).where("outcome = 'failure'").withColumn("signature", M.error_signature(F.col("error_message")))
    return A.occurrence(failed, ["signature"], ["created_at", "id"]).select("id", "signature", "occurrence")


@query("b13_u04_w09_repro_set", f"SELECT path, source, signature FROM (SELECT *, row_number() OVER (PARTITION BY source, signature ORDER BY id) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY path, source, signature ORDER BY id) AS first FROM (SELECT *, {SIG} AS signature FROM transitions WHERE outcome = 'failure')) WHERE first = 1) WHERE rn <= 5")
def repro(spark, d):
    failed = L.transitions(spark, d).where("outcome = 'failure'").withColumn("signature", M.error_signature(F.col("error_message")))
    unique = C.latest_per(failed, ["path", "source", "signature"], [F.asc("id")])
    return A.first_per_group(unique, ["source", "signature"], ["id"], 5).select("path", "source", "signature")


@query("b17_run_verdict", "SELECT 'failed plans' AS name, CASE WHEN count(*) = 0 THEN 'pass' ELSE 'hard' END AS level, count(*) AS n FROM plans WHERE status = 'failed' UNION ALL SELECT 'open jobs', CASE WHEN count(*) = 0 THEN 'pass' ELSE 'soft' END, count(*) FROM jobs WHERE status IN ('pending', 'running') UNION ALL SELECT 'orphan tracks', CASE WHEN count(*) = 0 THEN 'pass' ELSE 'hard' END, count(*) FROM tracks t WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.id = t.file_id)")
def verdict(spark, d):
    orphans = L.tracks(spark, d).join(L.files(spark, d).select(F.col("id").alias("file_id")), "file_id", "left_anti")
    return A.verdict(**{"failed plans": (L.plans(spark, d).where("status = 'failed'"), "hard"), "open jobs": (L.jobs(spark, d).where("status in ('pending', 'running')"), "soft"), "orphan tracks": (orphans, "hard")})


@query("u01_union_of_keys", "SELECT user_id AS key FROM events UNION SELECT o_custkey FROM orders")
def union_keys(spark, d):
    return L.read(spark, d, "events").select(F.col("user_id").alias("key")).union(L.read(spark, d, "orders").select("o_custkey")).distinct()


@query("f15_runs_with_children", "SELECT r.session_id, r.n, p.id FROM (SELECT session_id, count(*) AS n, max(created_at) AS newest FROM plans GROUP BY 1 ORDER BY newest DESC, session_id LIMIT 3) r JOIN plans p ON p.session_id = r.session_id")
def runs(spark, d):
    p = L.plans(spark, d)
    top = p.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("at")).orderBy(F.desc("at"), "session_id").limit(3)
    return p.select("session_id", "id").join(F.broadcast(top.select("session_id", "n")), "session_id")
