"""Registered queries over files, tracks and logs: filters, pages, lookups, distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinemill.operators import catalogue as C
from cinemill.plans.registry import query
from cinemill.sources import library as L


@query("a02_j01_container_codec_distribution", "SELECT f.container, t.codec, count(*) AS n FROM tracks t JOIN files f ON t.file_id = f.id WHERE f.status = 'active' AND t.track_type = 'video' GROUP BY ALL")
def container_codec(spark, d):
    active = L.files(spark, d).where("status = 'active'").select(F.col("id").alias("file_id"), "container")
    return L.tracks(spark, d).where("track_type = 'video'").join(active, "file_id").groupBy("container", "codec").agg(F.count(F.lit(1)).alias("n"))


@query("a01_file_totals", "SELECT count(*) AS total_files, CAST(coalesce(sum(size), 0) AS BIGINT) AS total_size, CAST(floor(sum(size)::DOUBLE / count(*)) AS BIGINT) AS avg_size, max(size) AS max_size, min(size) AS min_size FROM files WHERE status = 'active'")
def file_totals(spark, d):
    return C.file_totals(L.files(spark, d).where("status = 'active'"))


@query("a02_container_distribution", "SELECT container AS key, count(*) AS n FROM files WHERE status = 'active' GROUP BY 1")
def containers(spark, d):
    return C.distribution(L.files(spark, d).where("status = 'active'"), F.col("container"))


@query("a03_video_counts", "SELECT count(*) AS total, count(*) FILTER (is_hdr) AS hdr, count(*) FILTER (is_vfr) AS vfr FROM tracks WHERE track_type = 'video'")
def video_counts(spark, d):
    return L.tracks(spark, d).where("track_type = 'video'").agg(F.count(F.lit(1)).alias("total"), F.count_if("is_hdr").alias("hdr"), F.count_if("is_vfr").alias("vfr"))


@query("a04_hdr_format_distribution", "SELECT coalesce(k, 'unknown') AS key, n FROM (SELECT hdr_format AS k, count(*) AS n FROM tracks WHERE is_hdr GROUP BY 1)")
def hdr_formats(spark, d):
    return C.distribution(L.tracks(spark, d).where("is_hdr"), F.col("hdr_format"), "unknown")


@query("a05_resolution_buckets", "SELECT CASE WHEN width >= 7680 THEN '8K' WHEN width >= 3840 THEN '4K' WHEN width >= 1920 THEN '1080p' WHEN width >= 1280 THEN '720p' ELSE 'SD' END AS key, count(*) AS n FROM tracks WHERE track_type = 'video' AND width IS NOT NULL GROUP BY 1")
def resolutions(spark, d):
    return C.distribution(L.tracks(spark, d).where("track_type = 'video' and width is not null"), C.resolution(F.col("width")))


@query(
    "a06_frame_rate_buckets",
    """SELECT CASE WHEN abs(frame_rate - 23.976) < 0.1 THEN '23.976' WHEN abs(frame_rate - 24) < 0.1 THEN '24' WHEN abs(frame_rate - 25) < 0.1 THEN '25' WHEN abs(frame_rate - 29.97) < 0.1 THEN '29.97'
    WHEN abs(frame_rate - 59.94) < 0.1 THEN '59.94' ELSE CAST(CAST(round(frame_rate) AS INTEGER) AS VARCHAR) END AS key, count(*) AS n FROM tracks WHERE track_type = 'video' AND frame_rate IS NOT NULL GROUP BY 1""",
)
def frame_rates(spark, d):
    return C.distribution(L.tracks(spark, d).where("track_type = 'video' and frame_rate is not null"), C.frame_rate_label(F.col("frame_rate")))


_DIMS = "language codec channel_layout sample_rate bit_depth track_type".split()


@query(
    "a07_audio_distributions",
    " UNION ALL ".join(f"SELECT '{c}' AS dim, CAST({c} AS VARCHAR) AS key, count(*) AS n FROM tracks WHERE track_type LIKE 'audio%' GROUP BY 2" for c in _DIMS),
)
def audio_distributions(spark, d):
    return C.distributions(L.tracks(spark, d).where(F.col("track_type").startswith("audio")), **{c: F.col(c) for c in _DIMS})


@query("a08_subtitle_distributions", "SELECT 'language' AS dim, language AS key, count(*) AS n FROM tracks WHERE track_type LIKE 'subtitle%' GROUP BY 2 UNION ALL SELECT 'track_type', track_type, count(*) FROM tracks WHERE track_type LIKE 'subtitle%' GROUP BY 2")
def subtitle_distributions(spark, d):
    return C.distributions(L.tracks(spark, d).where(F.col("track_type").startswith("subtitle")), language=F.col("language"), track_type=F.col("track_type"))


@query(
    "a09_processing_stats",
    """SELECT p.dim, p.key, p.n, p.v FROM (SELECT 'plan' AS dim, status AS key, count(*) AS n, CAST(NULL AS BIGINT) AS v FROM plans GROUP BY 2 UNION ALL SELECT 'outcome', outcome, count(*), CAST(sum(coalesce(from_size, to_size) - to_size) AS BIGINT) FROM transitions WHERE source = 'engine' GROUP BY 2
    UNION ALL SELECT 'bad', error_source, count(DISTINCT path), NULL FROM bad_files GROUP BY 2) p""",
)
def processing(spark, d):
    none = F.lit(None).cast("long").alias("v")
    plans = L.plans(spark, d).groupBy(F.col("status").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("plan").alias("dim"), "key", "n", none)
    saved = F.sum(F.coalesce("from_size", "to_size") - F.col("to_size")).alias("v")
    done = L.transitions(spark, d).where("source = 'engine'").groupBy(F.col("outcome").alias("key")).agg(F.count(F.lit(1)).alias("n"), saved).select(F.lit("outcome").alias("dim"), "key", "n", "v")
    bad = L.bad_files(spark, d).groupBy(F.col("error_source").alias("key")).agg(F.countDistinct("path").alias("n")).select(F.lit("bad").alias("dim"), "key", "n", none)
    return plans.unionByName(done).unionByName(bad)


@query("a10_jobs_by_status_and_type", "SELECT 'status' AS dim, status AS key, count(*) AS n FROM jobs GROUP BY 2 UNION ALL SELECT 'type', job_type, count(*) FROM jobs GROUP BY 2")
def jobs_by(spark, d):
    return C.distributions(L.jobs(spark, d), status=F.col("status"), type=F.col("job_type"))


@query(
    "a25_a33_metadata_snapshot",
    """SELECT f.id, CAST(count(t.file_id) FILTER (t.track_type = 'video') AS INTEGER) AS n_video, CAST(count(t.file_id) FILTER (t.track_type LIKE 'audio%') AS INTEGER) AS n_audio, CAST(count(t.file_id) FILTER (t.track_type LIKE 'subtitle%') AS INTEGER) AS n_subtitle,
    coalesce(string_agg(DISTINCT t.codec, ',' ORDER BY t.codec) FILTER (t.track_type = 'video'), '') AS video_codecs, coalesce(string_agg(DISTINCT t.codec, ',' ORDER BY t.codec) FILTER (t.track_type LIKE 'audio%'), '') AS audio_codecs,
    max(t.width) FILTER (t.stream_index = 0) AS width, CASE WHEN max(f.duration) > 0 THEN max(f.duration) END AS duration,
    concat_ws(' ', CASE WHEN n_video > 0 THEN n_video || 'v' END, CASE WHEN n_audio > 0 THEN n_audio || 'a' END, CASE WHEN n_subtitle > 0 THEN n_subtitle || 's' END) AS summary FROM files f LEFT JOIN tracks t ON t.file_id = f.id GROUP BY f.id""",
)
def snapshots(spark, d):
    return C.snapshot(L.with_tracks(spark, d))


@query("a26_count_by_container_and_codec", "SELECT 'container' AS dim, container AS key, count(*) AS n FROM files GROUP BY 2 UNION ALL SELECT 'codec', codec, count(DISTINCT file_id) FROM tracks WHERE track_type = 'video' GROUP BY 2")
def count_by(spark, d):
    a = L.files(spark, d).groupBy(F.col("container").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("container").alias("dim"), "key", "n")
    b = L.tracks(spark, d).where("track_type = 'video'").groupBy(F.col("codec").alias("key")).agg(F.countDistinct("file_id").alias("n")).select(F.lit("codec").alias("dim"), "key", "n")
    return a.unionByName(b)


@query("f04_j02_list_files", "SELECT f.id, f.path FROM files f WHERE f.status = 'active' AND starts_with(f.path, '/media/1-') AND EXISTS (SELECT 1 FROM tracks t WHERE t.file_id = f.id AND t.codec = 'aac' AND t.language = 'eng')")
def list_files(spark, d):
    return C.list_files(L.files(spark, d), L.tracks(spark, d), status="active", prefix="/media/1-", codec="aac", language="eng").select("id", "path")


@query("f05_u05_count_files", "SELECT count(DISTINCT f.id) AS n FROM files f JOIN tracks t ON t.file_id = f.id WHERE f.container = 'mkv' AND t.codec = 'hevc'")
def count_files(spark, d):
    return C.list_files(L.files(spark, d), L.tracks(spark, d), container="mkv", codec="hevc").agg(F.countDistinct("id").alias("n"))


@query("f06_file_lookup", "SELECT id, path, size, content_hash FROM files WHERE path = (SELECT max(path) FROM files) OR id = 7")
def lookup(spark, d):
    files = L.files(spark, d)
    last = files.agg(F.max("path").alias("path"))
    return files.join(F.broadcast(last), "path", "left_semi").unionByName(files.where("id = 7")).select("id", "path", "size", "content_hash").distinct()


@query("f01_f02_k01_files_page", "SELECT id, path, size FROM files WHERE status = 'active' ORDER BY path LIMIT 25 OFFSET 50")
def files_page(spark, d):
    return C.page(C.matching(L.files(spark, d), status="active", container=None), [F.col("path")], 25, 50).select("id", "path", "size")


@query("f03_prefix_is_literal", "SELECT DISTINCT path FROM bad_files WHERE starts_with(path, '/media/c_')")
def prefix(spark, d):
    return L.bad_files(spark, d).where(F.col("path").startswith("/media/c_")).select("path").distinct()


@query("f07_list_jobs", "SELECT id, priority, created_at FROM jobs WHERE status = 'pending' ORDER BY priority, created_at DESC, id LIMIT 100")
def list_jobs(spark, d):
    return C.page(C.matching(L.jobs(spark, d), status="pending"), [F.asc("priority"), F.desc("created_at"), F.asc("id")], 100).select("id", "priority", "created_at")


@query("f08_bad_files", "SELECT path, seen_at FROM bad_files WHERE starts_with(path, '/media/a/') AND error_source = 'parse' ORDER BY seen_at DESC, id LIMIT 50")
def bad_files(spark, d):
    return C.page(L.bad_files(spark, d).where("startswith(path, '/media/a/') and error_source = 'parse'"), [F.desc("seen_at"), F.asc("id")], 50).select("path", "seen_at")


@query("f09_health_checks", "SELECT id, check_name, passed, checked_at FROM health_checks WHERE check_name = 'disk' AND NOT passed ORDER BY checked_at DESC, id LIMIT 20")
def health(spark, d):
    return C.page(C.matching(L.health_checks(spark, d), check_name="disk", passed=False), [F.desc("checked_at"), F.asc("id")], 20)


@query("f10_k02_event_log_by_prefix", "SELECT rowid, event_type, summary FROM event_log WHERE starts_with(event_type, 'file.') AND rowid > 100 ORDER BY rowid LIMIT 500")
def event_log(spark, d):
    return C.after(L.event_log(spark, d).where(C.event_type_matches(F.col("event_type"), "file.*")), "rowid", 100, 500).select("rowid", "event_type", "summary")


@query("f11_verifications", "SELECT id, file_id FROM verifications WHERE mode = 'hash' AND outcome = 'error' ORDER BY verified_at DESC, id LIMIT 200")
def verifications(spark, d):
    return C.page(C.matching(L.verifications(spark, d), mode="hash", outcome="error"), [F.desc("verified_at"), F.asc("id")], 200).select("id", "file_id")


@query("f12_transitions_for_path", "SELECT id, path, from_path FROM transitions WHERE path = '/media/f3' OR from_path = '/media/old3'")
def transitions(spark, d):
    return L.transitions(spark, d).where("path = '/media/f3' or from_path = '/media/old3'").select("id", "path", "from_path")


@query("f13_transcode_outcomes", "SELECT id, file_id, crf_used FROM outcomes ORDER BY completed_at DESC, id DESC LIMIT 50")
def transcodes(spark, d):
    return C.page(L.outcomes(spark, d), [F.desc("completed_at"), F.desc("id")], 50).select("id", "file_id", "crf_used")


@query("f14_cost_samples", "SELECT id, pixels_per_second FROM samples WHERE phase_name = 'transcode' AND codec = 'hevc' AND preset = 'fast' AND backend = 'sw'")
def cost_samples(spark, d):
    return C.matching(L.samples(spark, d), phase_name="transcode", codec="hevc", preset="fast", backend="sw").select("id", "pixels_per_second")


@query("f16_staged_rows", "SELECT id, path FROM files WHERE status = 'missing' ORDER BY created_at, id LIMIT 100")
def staged(spark, d):
    return C.page(C.matching(L.files(spark, d), status="missing"), [F.asc("created_at"), F.asc("id")], 100).select("id", "path")


@query("f17_plans_for_file", "SELECT id, phase_name, status FROM plans WHERE file_id = 5")
def plans_for(spark, d):
    return C.matching(L.plans(spark, d), file_id=5).select("id", "phase_name", "status")


@query("f18_pending_operations", "SELECT id, job_type, created_at FROM jobs WHERE status = 'running' ORDER BY created_at, id LIMIT 100")
def pending(spark, d):
    return C.page(C.matching(L.jobs(spark, d), status="running"), [F.asc("created_at"), F.asc("id")], 100).select("id", "job_type", "created_at")


@query("f19_latest_verification", "SELECT file_id, mode, max(id) FILTER (rn = 1) AS id FROM (SELECT *, row_number() OVER (PARTITION BY file_id, mode ORDER BY verified_at DESC, id DESC) AS rn FROM verifications) GROUP BY 1, 2")
def latest_verification(spark, d):
    return C.latest_per(L.verifications(spark, d), ["file_id", "mode"], [F.desc("verified_at"), F.desc("id")]).select("file_id", "mode", "id")


@query("f20_latest_and_oldest_events", "SELECT event_type, arg_max(rowid, created_at) AS latest, min(created_at) AS oldest FROM event_log GROUP BY 1")
def latest_events(spark, d):
    return L.event_log(spark, d).groupBy("event_type").agg(F.max_by("rowid", "created_at").alias("latest"), F.min("created_at").alias("oldest"))


@query("f21_session_events", "SELECT rowid FROM event_log WHERE contains(payload, '7') OR contains(summary, 'user 7')")
def session_events(spark, d):
    return L.event_log(spark, d).where(F.contains("payload", F.lit("7")) | F.contains("summary", F.lit("user 7"))).select("rowid")


@query("f22_event_glob", "SELECT event_type, count(*) AS n FROM event_log WHERE starts_with(event_type, 'job.') OR event_type = 'plan.failed' GROUP BY 1")
def glob(spark, d):
    kind = F.col("event_type")
    return L.event_log(spark, d).where(C.event_type_matches(kind, "job.*") | C.event_type_matches(kind, "plan.failed")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("f23_session_by_prefix", "SELECT session_id, count(*) AS n FROM transitions WHERE session_id = (SELECT min(session_id) FROM transitions WHERE starts_with(session_id, 'run')) GROUP BY 1")
def session_prefix(spark, d):
    t = L.transitions(spark, d)
    first = t.where(F.col("session_id").startswith("run")).agg(F.min("session_id").alias("session_id"))
    return t.join(F.broadcast(first), "session_id").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


@query("f25_unchanged_with_tracks", "SELECT f.id FROM files f WHERE f.status = 'active' AND f.content_hash = f.expected_hash AND EXISTS (SELECT 1 FROM tracks t WHERE t.file_id = f.id)")
def cache_hits(spark, d):
    return L.files(spark, d).where("status = 'active' and content_hash = expected_hash").join(L.tracks(spark, d).select(F.col("file_id").alias("id")), "id", "left_semi").select("id")


@query("s08_nested_tracks", "SELECT f.id, coalesce(string_agg(t.codec, '>' ORDER BY t.stream_index), '') AS codecs FROM files f LEFT JOIN tracks t ON t.file_id = f.id GROUP BY 1")
def nested(spark, d):
    found = C.nest(L.files(spark, d).select("id"), L.tracks(spark, d).select("file_id", "stream_index", "codec"), "file_id", "id", "stream_index", "tracks")
    return found.select("id", F.coalesce(F.concat_ws(">", F.transform("tracks", lambda t: t["codec"])), F.lit("")).alias("codecs"))


@query("s19_clamped_page", "SELECT id FROM jobs ORDER BY id LIMIT 10000 OFFSET 0")
def clamped(spark, d):
    return C.page(L.jobs(spark, d), [F.col("id")], 99_999, -5).select("id")


@query("s20_row_counts", "SELECT 'files' AS name, count(*) AS n FROM files UNION ALL SELECT 'tracks', count(*) FROM tracks UNION ALL SELECT 'jobs', count(*) FROM jobs UNION ALL SELECT 'plans', count(*) FROM plans")
def counts(spark, d):
    return C.row_counts(**{k: getattr(L, k)(spark, d) for k in ("files", "tracks", "jobs", "plans")})


@query("k03_claim_next_job", "SELECT id FROM jobs WHERE status = 'pending' ORDER BY priority, created_at, id LIMIT 1")
def claim(spark, d):
    return L.jobs(spark, d).where("status = 'pending'").orderBy("priority", "created_at", "id").limit(1).select("id")


@query("k05_date_priority", "SELECT id, CASE WHEN age < 7 THEN 10 WHEN age < 30 THEN 50 WHEN age < 365 THEN 100 ELSE 200 END AS priority FROM (SELECT id, date_diff('day', created_at, TIMESTAMP '1998-08-01') AS age FROM files)")
def date_priority(spark, d):
    age = F.date_diff(F.lit("1998-08-01").cast("date"), F.col("created_at"))
    return L.files(spark, d).select("id", F.when(age < 7, 10).when(age < 30, 50).when(age < 365, 100).otherwise(200).alias("priority"))


@query("k07_newest_and_pruned", "SELECT id, rn <= 20 AS kept FROM (SELECT id, row_number() OVER (ORDER BY created_at DESC, id DESC) AS rn FROM jobs WHERE status = 'completed')")
def newest(spark, d):
    done = L.jobs(spark, d).where("status = 'completed'").select("id", "created_at")
    top = done.orderBy(F.desc("created_at"), F.desc("id")).limit(20).select("id", F.lit(True).alias("kept"))
    return done.select("id").join(top, "id", "left").select("id", F.coalesce("kept", F.lit(False)).alias("kept"))


@query("k08_b16_greedy_cover")
def cover(spark, d):
    files = L.files(spark, d).where("status = 'active'").select(F.col("id").alias("file_id"), "size", "container")
    t = L.tracks(spark, d).join(files, "file_id")
    features = F.explode(F.array(F.concat(F.lit("codec:"), "codec"), F.concat(F.lit("lang:"), "language"), F.concat(F.lit("box:"), "container")))
    return C.greedy_cover(t.select(F.col("file_id").alias("item"), "size", features.alias("feature")), 6, 10**11)


_SIXTEENTH = "least(width, CAST(trunc(width * 9 / 16) AS INTEGER))"


@query(
    "b16_corpus_features",
    f"""
    WITH t AS (SELECT f.id, f.size, f.container, t.* EXCLUDE (file_id), split_part(track_type, '_', 1) AS kind FROM files f JOIN tracks t ON t.file_id = f.id)
    SELECT id, size, 'container:' || container AS feature FROM t
    UNION SELECT id, size, kind || '_codec:' || codec FROM t WHERE kind IN ('video', 'audio', 'subtitle')
    UNION SELECT id, size, 'resolution:' || CASE WHEN {_SIXTEENTH} >= 2160 THEN '4K+' WHEN {_SIXTEENTH} >= 1080 THEN '1080p' WHEN {_SIXTEENTH} >= 720 THEN '720p' WHEN {_SIXTEENTH} >= 480 THEN 'SD' ELSE 'sub-SD' END FROM t WHERE kind = 'video' AND width IS NOT NULL
    UNION SELECT id, size, 'hdr:' || CASE WHEN is_hdr THEN lower(coalesce(hdr_format, 'generic')) ELSE 'none' END FROM t WHERE kind = 'video'
    UNION SELECT id, size, 'framerate:' || CASE WHEN is_vfr THEN 'vfr' ELSE 'cfr' END FROM t WHERE kind = 'video'
    UNION SELECT id, size, 'audio_channels:' || CASE channels WHEN 1 THEN 'mono' WHEN 2 THEN 'stereo' WHEN 6 THEN '5.1' WHEN 8 THEN '7.1' ELSE channels || 'ch' END FROM t WHERE kind = 'audio' AND channels IS NOT NULL
    UNION SELECT id, size, 'commentary:yes' FROM t WHERE contains(lower(title), 'commentary')
    UNION SELECT id, size, 'attachment:yes' FROM t WHERE kind = 'attachment'
    UNION SELECT id, size, 'forced_subtitle:yes' FROM t WHERE kind = 'subtitle' AND is_forced
    UNION SELECT id, size, 'multi_' || kind || ':yes' FROM t WHERE kind IN ('audio', 'subtitle') GROUP BY id, size, kind HAVING count(*) > 1
    """,
)
def corpus_features(spark, d):
    return C.corpus_features(L.with_tracks(spark, d))
