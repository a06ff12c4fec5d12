"""Registered queries over samples and measurements: timelines, crops, batch estimates, lookups, fingerprints, redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinemill.functions import media as M
from cinemill.functions import sql as S
from cinemill.operators import history as H
from cinemill.operators import measures as X
from cinemill.operators import timelines as T
from cinemill.plans.registry import query
from cinemill.sources import library as L
from cinemill.streaming.batching import Bounds, batched

_SAMPLES = """s AS (SELECT user_id % 40 AS source, ts AS "at", event_id AS id, CAST(event_id % 7 // 3 AS INTEGER) AS gpus, event_id % 100 AS d0, CASE WHEN event_id % 4 <> 0 THEN event_id * 7 % 100 END AS d1, event_id % 5 // 2 AS job_rows FROM events),
    o AS (SELECT *, row_number() OVER w AS number, lag(gpus) OVER w AS pg, lag(d0) OVER w AS p0, lag(d1) OVER w AS p1, lag(job_rows) OVER w AS pj FROM s WINDOW w AS (PARTITION BY source ORDER BY "at", id)),
    i AS (SELECT *, sum(CASE WHEN pj = job_rows THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY "at", id) AS island FROM o),
    k AS (SELECT *, row_number() OVER (PARTITION BY source, island ORDER BY "at", id) AS streak FROM i)"""


def _samples(spark, d):
    e = F.col("event_id")
    disks = F.create_map(F.lit("/"), (e % 100).cast("int"))
    disks = F.when(e % 4 != 0, F.map_concat(disks, F.create_map(F.lit("/data"), (e * 7 % 100).cast("int")))).otherwise(disks)
    return L.events(spark, d).select(
        (F.col("user_id") % 40).alias("source"), F.col("ts").alias("at"), e.alias("id"), F.floor(e % 7 / 3).cast("int").alias("gpus"), disks.alias("disks"), F.floor(e % 5 / 2).alias("job_rows")
    )


@query(
    "b11_runtime_timeline",
    f"""WITH {_SAMPLES} SELECT source, "at", id, 'gpus' AS kind, pg || ' -> ' || gpus AS detail FROM k WHERE number > 1 AND pg <> gpus
    UNION ALL SELECT source, "at", id, 'disk', '/ ' || d0 FROM k WHERE number > 1 AND d0 >= 90 AND p0 < 90
    UNION ALL SELECT source, "at", id, 'disk', '/data ' || d1 FROM k WHERE number > 1 AND d1 >= 90 AND coalesce(p1, 0) < 90
    UNION ALL SELECT source, "at", id, 'stall', CAST(job_rows AS VARCHAR) FROM k WHERE number > 1 AND job_rows > 0 AND streak = 3""",
)
def runtime_timeline(spark, d):
    return T.runtime_changes(_samples(spark, d), 90, 3)


@query(
    "b12_environment_timeline",
    f"""WITH {_SAMPLES} SELECT source, number, c AS changes FROM (SELECT source, number, concat_ws('; ', CASE WHEN pg <> gpus THEN 'GPUs ' || pg || ' -> ' || gpus END, CASE WHEN p1 IS DISTINCT FROM d1 THEN 'disk ' || coalesce(CAST(p1 AS VARCHAR), 'none') || ' -> ' || coalesce(CAST(d1 AS VARCHAR), 'none') END) AS c FROM k WHERE number > 1) WHERE c <> ''""",
)
def environment_timeline(spark, d):
    df = _samples(spark, d).withColumn("second", F.try_element_at("disks", F.lit("/data")))
    return T.environment_changes(df, {"gpus": "GPUs", "second": "disk"})


@query("b18_progress_watchdog", f'WITH {_SAMPLES} SELECT source, min(number) AS poll, arg_min("at", number) AS "at" FROM k WHERE streak > 3 GROUP BY 1')
def progress_watchdog(spark, d):
    return T.watchdog(_samples(spark, d).withColumn("signature", F.col("job_rows").cast("string")), 3)


_LOCKS = [(16, 9), (4, 3), (64, 27)]


@query(
    "a31_crop_with_aspect",
    """WITH m AS (SELECT user_id AS file_id, 1920 AS w, 1080 AS h, min(event_id % 90) AS l, min(event_id % 150 + 3) AS t, min(event_id % 31) AS r, min(event_id % 140) AS b FROM events GROUP BY 1),
    n AS (SELECT file_id, w, h, CASE WHEN l < 4 THEN 0 ELSE l END AS l, CASE WHEN t < 4 THEN 0 ELSE t END AS t, CASE WHEN r < 4 THEN 0 ELSE r END AS r, greatest(CASE WHEN b < 4 THEN 0 ELSE b END - 10, 0) AS b FROM m),
    o AS (SELECT *, w - l - r AS ow, h - t - b AS oh FROM n), c AS (SELECT o.*, k, rw, rh, (ow * rh + rw - 1) // rw AS h1, (oh * rw + rh - 1) // rh AS w1 FROM o, (VALUES (0, 16, 9), (1, 4, 3), (2, 64, 27)) v(k, rw, rh)),
    g AS (SELECT *, CASE WHEN ow * rh > oh * rw THEN h1 + h1 % 2 - oh ELSE 0 END AS down, CASE WHEN ow * rh < oh * rw THEN w1 + w1 % 2 - ow ELSE 0 END AS across FROM c),
    f AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY down * ow + across * oh, k) AS rn FROM g WHERE down <= t + b AND across <= l + r AND oh + down <= h AND ow + across <= w),
    q AS (SELECT *, least(down // 2, t) AS dt, least(across // 2, l) AS al FROM f WHERE rn = 1),
    p AS (SELECT *, least(down - dt, b) AS db, least(across - al, r) AS ar FROM q),
    z AS (SELECT o.file_id, o.w, o.h, coalesce(p.l - al - (across - al - ar), o.l) AS "left", coalesce(p.t - dt - (down - dt - db), o.t) AS "top", coalesce(p.r - ar, o.r) AS "right", coalesce(p.b - db, o.b) AS "bottom" FROM o LEFT JOIN p USING (file_id))
    SELECT file_id, "left", "top", "right" + (w - "left" - "right") % 2 AS "right", "bottom" + (h - "top" - "bottom") % 2 AS "bottom" FROM z""",
)
def crop_with_aspect(spark, d):
    e = F.col("event_id")
    df = L.read(spark, d, "events").select(F.col("user_id").alias("file_id"), F.lit(1920).alias("width"), F.lit(1080).alias("height"), (e % 90).alias("left"), (e % 150 + 3).alias("top"), (e % 31).alias("right"), (e % 140).alias("bottom"))
    return X.merged_crop(df, 4, 10, _LOCKS)


@query(
    "a32_batch_estimate",
    """WITH j AS (SELECT user_id % 20 AS batch, CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' ELSE 'completed' END AS state, (event_id % 50 + 1)::DOUBLE AS weight, (event_id % 90)::DOUBLE AS seconds, CASE WHEN event_id % 4 = 1 THEN event_id % 8 / 8 ELSE 0 END AS p FROM events),
    r AS (SELECT batch, count(*) FILTER (state = 'completed') AS completed, sum(seconds) FILTER (state = 'completed' OR p > 0) / sum(CASE WHEN state = 'completed' THEN weight ELSE weight * p END) FILTER (state = 'completed' OR p > 0) AS rate FROM j GROUP BY 1),
    l AS (SELECT batch, state, weight * (1 - p) AS w, CASE WHEN state = 'queued' THEN weight * rate WHEN p > 0 THEN greatest(greatest(seconds / p, greatest(weight * rate, seconds)) - seconds, 0) ELSE greatest(greatest(weight * rate, seconds) - seconds, 0) END AS x FROM j JOIN r USING (batch) WHERE state <> 'completed')
    SELECT batch, round(rem * 10000) / 10000 AS remaining, round(rate * 10000) / 10000 AS seconds_per_weight, round(greatest(x / 4, longest) * 10000) / 10000 AS eta_low, round((x / 4 + longest * 0.75::DOUBLE) * 10000) / 10000 AS eta_high, CASE WHEN completed >= 6 THEN 'high' WHEN completed >= 2 THEN 'medium' ELSE 'low' END AS confidence
    FROM r JOIN (SELECT batch, sum(w) AS rem, sum(x) AS x, max(x) AS longest FROM l GROUP BY 1) USING (batch)""",
)
def batch(spark, d):
    e = F.col("event_id")
    state = F.when(e % 4 == 0, "queued").when(e % 4 == 1, "running").otherwise("completed")
    jobs = L.read(spark, d, "events").select((F.col("user_id") % 20).alias("batch"), state.alias("state"), (e % 50 + 1).cast("double").alias("weight"), (e % 90).cast("double").alias("seconds"), (e % 8 / 8).alias("progress"))
    out = X.batch_estimate(jobs, 4)
    return out.select("batch", *(H.round4(F.col(c)).alias(c) for c in ("remaining", "seconds_per_weight", "eta_low", "eta_high")), "confidence")


@query(
    "a32_makespan",
    """
    WITH RECURSIVE j AS (
      SELECT user_id % 12 AS batch, CASE WHEN event_id % 4 = 0 THEN 'queued' WHEN event_id % 400 = 1 THEN 'running' ELSE 'completed' END AS state, (event_id % 50 + 1)::DOUBLE AS weight,
        (event_id % 90)::DOUBLE AS seconds, CASE WHEN event_id % 400 = 1 AND user_id % 3 = 0 THEN ((event_id % 700) / 700)::DOUBLE END AS p FROM events),
    r AS (
      SELECT batch, count(*) FILTER (state = 'completed') AS completed,
        sum(seconds) FILTER (state = 'completed' OR p > 0) / sum(CASE WHEN state = 'completed' THEN weight ELSE weight * least(p, 0.98::DOUBLE) END) FILTER (state = 'completed' OR p > 0) AS rate FROM j GROUP BY 1),
    g AS (SELECT j.*, rate, least(CASE WHEN p IS NULL THEN seconds / (weight * rate) ELSE p END, 0.98::DOUBLE) AS done FROM j JOIN r USING (batch) WHERE state <> 'completed'),
    l AS (
      SELECT batch, state, CASE WHEN state = 'queued' THEN weight ELSE weight * (1 - done) END AS w,
        CASE WHEN state = 'queued' THEN weight * rate WHEN done > 0 THEN greatest(greatest(seconds / done, weight * rate, seconds) - seconds, 0) ELSE greatest(weight * rate - seconds, 0) END AS x FROM g),
    q AS (SELECT batch, x, row_number() OVER (PARTITION BY batch ORDER BY x DESC) AS k FROM l WHERE state = 'queued'),
    f AS (SELECT b.batch, coalesce(list(x) FILTER (x IS NOT NULL), []) AS loads FROM (SELECT DISTINCT batch FROM j) b LEFT JOIN l ON l.batch = b.batch AND state = 'running' GROUP BY 1),
    s AS (
      SELECT batch, 0 AS k, list_sort(list_concat(loads, list_transform(range(greatest(4 - len(loads), 0)), lambda i: 0::DOUBLE))) AS loads FROM f
      UNION ALL SELECT s.batch, s.k + 1, list_sort(list_append(s.loads[2:], s.loads[1] + q.x)) FROM s JOIN q ON q.batch = s.batch AND q.k = s.k + 1),
    e AS (SELECT batch, max_by(loads, k)[-1] AS eta FROM s GROUP BY 1)
    SELECT batch, round(rem * 1000) / 1000 AS remaining, round(eta * 1000) / 1000 AS eta, CASE WHEN completed >= 6 THEN 'high' ELSE 'medium' END AS confidence
    FROM r JOIN e USING (batch) JOIN (SELECT batch, sum(w) AS rem FROM l GROUP BY 1) USING (batch)
    """,
)
def makespan(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    state = F.when(e % 4 == 0, "queued").when(e % 400 == 1, "running").otherwise("completed")
    progress = F.when((e % 400 == 1) & (u % 3 == 0), e % 700 / 700)
    jobs = L.read(spark, d, "events").select((u % 12).alias("batch"), state.alias("state"), (e % 50 + 1).cast("double").alias("weight"), (e % 90).cast("double").alias("seconds"), progress.alias("progress"))
    elapsed = jobs.groupBy("batch").agg(F.sum("seconds").alias("elapsed"))
    out = X.batch_makespan(jobs, 4, elapsed)
    return out.select("batch", *((F.round(F.col(c) * 1000) / 1000).alias(c) for c in ("remaining", "eta")), "confidence")


@query(
    "t21_batched_sink",
    """
    WITH RECURSIVE r AS (SELECT plugin_id || '/' || (rowid % 2) AS lane, started_at AS ts, rowid AS id, duration_ms AS value FROM plugin_stats),
    o AS (SELECT DISTINCT lane, ts FROM r),
    n AS (SELECT a.lane, a.ts, min(b.ts) AS next FROM o a JOIN o b ON a.lane = b.lane AND a.ts + INTERVAL 1 HOUR <= b.ts GROUP BY 1, 2),
    w AS (SELECT lane, min(ts) AS opened FROM r GROUP BY 1 UNION ALL SELECT w.lane, n.next FROM w JOIN n ON n.lane = w.lane AND n.ts = w.opened),
    p AS (SELECT r.lane, r.ts, r.id, r.value, max(opened) AS opened FROM r JOIN w ON r.lane = w.lane AND r.ts >= w.opened GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY lane, opened ORDER BY ts, id) AS rn FROM p)
    SELECT lane, opened, CAST((rn - 1) // 5 AS INTEGER) AS batch, count(*) AS n, arg_min(id, rn) AS first_id, arg_max(id, rn) AS last_id, CAST(sum(value) AS BIGINT) AS total, 0 AS dropped
    FROM k WHERE rn <= 8 GROUP BY ALL UNION ALL SELECT lane, opened, NULL, 0, NULL, NULL, 0, count(*) FROM k WHERE rn > 8 GROUP BY 1, 2
    """,
)
def batched_sink(spark, d):
    stats = L.plugin_stats(spark, d).select(F.concat("plugin_id", F.lit("/"), (F.col("rowid") % 2).cast("string")).alias("lane"), F.col("started_at").cast("timestamp").alias("ts"), F.col("rowid").alias("id"), F.col("duration_ms").alias("value"))
    return batched(stats, Bounds(5, 3_600_000_000, 8)).withColumn("opened", F.col("opened").cast("timestamp_ntz"))


@query(
    "a32_smoothed_estimates",
    "SELECT event_id, CASE WHEN prev IS NULL THEN raw ELSE least(greatest(prev + 0.35::DOUBLE * (raw - prev), prev * 0.75::DOUBLE), prev * 1.3::DOUBLE) END AS shown FROM (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN (event_id % 60 + 1)::DOUBLE END AS prev, (event_id % 77 + 1)::DOUBLE AS raw FROM events)",
)
def smoothed(spark, d):
    e = F.col("event_id")
    return L.read(spark, d, "events").select("event_id", X.smoothed_eta(F.when(e % 10 != 0, (e % 60 + 1).cast("double")), (e % 77 + 1).cast("double")).alias("shown"))


@query("a30_capabilities", "SELECT ['nvenc', 'qsv', 'unknown', 'vaapi'] AS backends, 'nvenc' AS best, CAST(min(user_id % 9) FILTER (user_id % 9 > 0 AND event_id % 2 = 0) AS BIGINT) AS parallel FROM events")
def capabilities(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    limits = F.array(F.struct(F.when(e % 2 == 0, "gpu").otherwise("disk").alias("resource"), (u % 9).alias("most")))
    df = L.read(spark, d, "events").select(F.array(L.pick(("CUDA", "qsv", "vaapi", "d3d11va"), e), F.lit("QSV")).alias("hw_accels"), limits.alias("limits"))
    return X.capabilities(df, "gpu")


@query(
    "a27_safeguard_issues",
    """SELECT id, 1 + id % 2 AS n, 'no_video' AS first FROM files WHERE id % 5 = 0""",
)
def issues(spark, d):
    one = '{"kind":"no_video","message":"m"}'
    meta = F.when(F.col("id") % 5 == 0, F.when(F.col("id") % 2 == 0, f'{{"safeguard_violations":[{one}]}}').otherwise(f'{{"safeguard_violations":[{one},{one}]}}')).when(F.col("id") % 5 == 1, '{"safeguard_violations":[]}').when(F.col("id") % 5 == 2, '{"other":1}')
    found = L.files(spark, d).select("id", X.violations(meta).alias("v")).where("size(v) > 0")
    return found.select("id", F.size("v").cast("long").alias("n"), F.col("v")[0]["kind"].alias("first"))


_CATALOGUE = "c AS (SELECT n_nationkey, n_name, CASE n_nationkey % 3 WHEN 0 THEN '/media/' || (n_nationkey % 5 + 1) WHEN 1 THEN '/media/' || (n_nationkey % 5 + 1) || '-HIGH/' ELSE '/media/4-NOT SPECIFIED/' || n_nationkey END AS root, n_nationkey || CASE n_nationkey % 2 WHEN 0 THEN '.mkv' ELSE '.mp4' END AS tail FROM nation)"


def _catalogue(spark, d):
    k = F.col("n_nationkey")
    n = (k % 5 + 1).cast("string")
    root = F.when(k % 3 == 0, F.concat(F.lit("/media/"), n)).when(k % 3 == 1, F.concat(F.lit("/media/"), n, F.lit("-HIGH/"))).otherwise(F.concat(F.lit("/media/4-NOT SPECIFIED/"), k.cast("string")))
    tail = F.concat(k.cast("string"), F.when(k % 2 == 0, ".mkv").otherwise(".mp4"))
    return L.read(spark, d, "nation").select(root.alias("root"), tail.alias("tail"), F.col("n_name").alias("name"), k.alias("position"))


@query("j12_first_prefix", f"WITH {_CATALOGUE} SELECT f.id, arg_min(c.n_name, c.n_nationkey) AS name FROM files f LEFT JOIN c ON starts_with(f.path, c.root) GROUP BY 1")
def first_prefix(spark, d):
    return X.first_by_prefix(L.files(spark, d).select("id", "path"), "path", _catalogue(spark, d)).select("id", "name")


@query("j12_first_suffix", f"WITH {_CATALOGUE} SELECT f.id, arg_min(c.n_name, c.n_nationkey) AS name FROM files f LEFT JOIN c ON ends_with(f.path, c.tail) GROUP BY 1")
def first_suffix(spark, d):
    catalogue = _catalogue(spark, d).select(F.col("tail").alias("root"), "name", "position")
    return X.first_by_prefix(L.files(spark, d).select("id", "path"), "path", catalogue, at_end=True).select("id", "name")


@query(
    "s04_content_fingerprint",
    "SELECT doc_id, substr(sha256(CASE WHEN n <= 2000 THEN b ELSE encode(CAST(n AS VARCHAR)) || b[1:1000] || b[n // 2 + 1:n // 2 + 1000] || b[n - 999:n] END), 1, 16) AS fingerprint FROM (SELECT doc_id, encode(text) AS b, octet_length(encode(text)) AS n FROM documents)",
)
def fingerprint(spark, d):
    return L.read(spark, d, "documents").select("doc_id", X.content_fingerprint(F.encode("text", "UTF-8"), 2000, 1000).alias("fingerprint"))


_REPORTS = "r AS (SELECT user_id AS report, event_id AS line, 'ran m' || (event_id % 6) || '.mkv api_key=k' || (event_id % 4) || 'z and m' || (event_id % 6) || '0.mp4' AS text FROM events)"


@query(
    "f26_numbered_redaction",
    rf"""WITH {_REPORTS}, m AS (SELECT report, line, 0 AS pos, 'secret' AS kind, 'k' || (line % 4) || 'z' AS was FROM r UNION ALL SELECT report, line, 1, 'video', 'm' || (line % 6) || '.mkv' FROM r UNION ALL SELECT report, line, 2, 'video', 'm' || (line % 6) || '0.mp4' FROM r),
    f AS (SELECT report, kind, was, min(line) AS line, arg_min(pos, line) AS pos FROM m GROUP BY 1, 2, 3), n AS (SELECT *, kind || format('{{:03d}}', row_number() OVER (PARTITION BY report, kind ORDER BY line, pos) - 1) || CASE kind WHEN 'video' THEN '.' || split_part(was, '.', 2) ELSE '' END AS put FROM f)
    SELECT r.report, r.line, 'ran ' || a.put || ' api_key=' || s.put || ' and ' || b.put AS text FROM r JOIN n a ON a.report = r.report AND a.was = 'm' || (r.line % 6) || '.mkv' JOIN n b ON b.report = r.report AND b.was = 'm' || (r.line % 6) || '0.mp4' JOIN n s ON s.report = r.report AND s.was = 'k' || (r.line % 4) || 'z'""",
)
def numbered_redaction(spark, d):
    e = F.col("event_id")
    text = F.concat(F.lit("ran m"), (e % 6).cast("string"), F.lit(".mkv api_key=k"), (e % 4).cast("string"), F.lit("z and m"), (e % 6).cast("string"), F.lit("0.mp4"))
    return X.redacted_reports(L.read(spark, d, "events").select(F.col("user_id").alias("report"), e.alias("line"), text.alias("text")))


@query(
    "f26_redacted_documents",
    """
    WITH r AS (SELECT user_id AS report, event_id AS line, event_id % 6 AS a, event_id % 4 AS b FROM events),
    m AS (
      SELECT report, line, 0 AS pos, 'video' AS kind, 'm' || a || '.mkv' AS was FROM r UNION ALL SELECT report, line, 1, 'secret', 'k' || b || 'z' FROM r
      UNION ALL SELECT report, line, 2, 'secret', 'p' || a || 'q' FROM r UNION ALL SELECT report, line, 3, 'video', 'm' || a || '0.mp4' FROM r),
    f AS (SELECT report, kind, was, min(line) AS line, arg_min(pos, line) AS pos FROM m GROUP BY 1, 2, 3),
    n AS (SELECT *, kind || format('{:03d}', row_number() OVER (PARTITION BY report, kind ORDER BY line, pos) - 1) || CASE kind WHEN 'video' THEN '.' || split_part(was, '.', 2) ELSE '' END AS put FROM f)
    SELECT r.report, r.line, '{"a":{"file":"at ' || v.put || ' now","n":[1,"api_key=' || s.put || '",null]},"m0.mkv":true,"token":"' || t.put || '","z":"' || w.put || '"}' AS document
    FROM r JOIN n v ON v.report = r.report AND v.was = 'm' || r.a || '.mkv' JOIN n s ON s.report = r.report AND s.was = 'k' || r.b || 'z'
    JOIN n t ON t.report = r.report AND t.was = 'p' || r.a || 'q' JOIN n w ON w.report = r.report AND w.was = 'm' || r.a || '0.mp4'
    """,
)
def redacted_documents(spark, d):
    e = F.col("event_id")
    a, b = (e % 6).cast("string"), (e % 4).cast("string")
    text = F.format_string('{"z": "m%s0.mp4", "token": "p%sq", "a": {"n": [1, "api_key=k%sz", null], "file": "at m%s.mkv now"}, "m0.mkv": true}', a, a, b, a)
    return X.redacted_documents(L.read(spark, d, "events").select(F.col("user_id").alias("report"), e.alias("line"), text.alias("document")))


_PLAN = "CASE WHEN duration <= {n} * 10 THEN 1 ELSE len(list_filter({starts}[1:{n}], lambda t: t < duration)) END AS n, CASE WHEN duration <= {n} * 10 THEN duration ELSE list_sum(list_transform(list_filter({starts}[1:{n}], lambda t: t < duration), lambda t: least(10::DOUBLE, duration - t))) END AS total"


def _planned(plan):
    return F.size(plan).cast("long").alias("n"), F.aggregate(plan, F.lit(0.0), lambda a, s: a + s["length"]).alias("total")


@query("x23_uniform_samples", f"SELECT id, CASE WHEN duration <= 40 THEN 0 ELSE duration * 0.5::DOUBLE / 4 END AS first, {_PLAN.format(n=4, starts='list_transform(range(4), lambda i: duration * (i + 0.5::DOUBLE) / 4)')} FROM files")
def uniform_samples(spark, d):
    at = F.col("duration")
    plan = X.sample_plan(at, X.uniform_starts(at, 4), 4, 10)
    return L.files(spark, d).select("id", plan[0]["start"].alias("first"), *_planned(plan))


@query("x23_scene_samples", f"SELECT id, {_PLAN.format(n=3, starts='[duration - 3, 5.0::DOUBLE, duration + 1, 12.0::DOUBLE]')} FROM files")
def scene_samples(spark, d):
    at = F.col("duration")
    scenes = F.array(*(F.struct(a.alias("at"), F.lit(s).alias("score")) for a, s in ((F.lit(5.0), 0.7), (F.lit(12.0), 0.41), (at + 1, 0.5), (at - 3, 0.9))))
    return L.files(spark, d).select("id", *_planned(X.sample_plan(at, X.scene_starts(scenes), 3, 10)))


@query("e06_sql_functions", "SELECT id, CASE WHEN v >= 2160 THEN '4K+' WHEN v >= 1080 THEN '1080p' WHEN v >= 720 THEN '720p' WHEN v >= 480 THEN 'SD' ELSE 'sub-SD' END AS tier, container = 'mkv' AS is_mkv FROM (SELECT id, container, id % 3000 AS v FROM files)")
def sql_functions(spark, d):
    S.register(spark)
    return spark.sql("SELECT id, media_resolution_tier(id % 3000, 4000) AS tier, media_extension(path) = 'mkv' AS is_mkv FROM {files}", files=L.files(spark, d))
