"""Registered queries over logs: savings, sessions, retention, integrity, latency, quality, estimates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinemill.operators import catalogue as C
from cinemill.operators import history as H
from cinemill.plans.registry import query
from cinemill.sources import library as L

CUT = "1998-06-01"
_SAVED = "count(*) AS n, CAST(coalesce(sum(from_size - to_size), 0) AS BIGINT) AS bytes_saved, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, count(DISTINCT file_id) AS files FROM transitions WHERE (source = 'engine' OR executor IS NOT NULL) AND outcome = 'success'"


@query("a11_savings", f"SELECT executor, phase_name, {_SAVED} GROUP BY ALL")
def savings(spark, d):
    return H.savings(L.transitions(spark, d))


@query("a11_savings_totals", "SELECT CAST(coalesce(sum(from_size - to_size), 0) AS BIGINT) AS total_bytes_saved, count(*) AS total_transitions FROM transitions WHERE (source = 'engine' OR executor IS NOT NULL) AND outcome = 'success'")
def savings_totals(spark, d):
    return H.savings_totals(H.savings(L.transitions(spark, d), "month"))


for _unit, _fmt in (("day", "%Y-%m-%d"), ("week", "%Y-W%W"), ("month", "%Y-%m")):
    query(f"a11_x20_savings_by_{_unit}", f"SELECT executor, phase_name, strftime(created_at, '{_fmt}') AS period, {_SAVED} GROUP BY ALL")(lambda spark, d, u=_unit: H.savings(L.transitions(spark, d), u))


@query("a12_plan_stats", "SELECT phase_name, status, skip_reason, count(*) AS n FROM plans GROUP BY ALL")
def plan_stats(spark, d):
    return L.plans(spark, d).groupBy("phase_name", "status", "skip_reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a13_plan_pivot",
    """SELECT phase_name, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed,
    (SELECT string_agg(skip_reason || '=' || n, ';' ORDER BY n DESC, skip_reason) FROM (SELECT skip_reason, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, skip_reason) AS rn FROM plans q WHERE q.phase_name = p.phase_name AND skip_reason IS NOT NULL GROUP BY 1) WHERE rn <= 3) AS top_reasons FROM plans p GROUP BY phase_name""",
)
def plan_pivot(spark, d):
    plans = L.plans(spark, d)
    counts = plans.groupBy("phase_name").pivot("status", ["completed", "skipped", "failed"]).count().na.fill(0)
    why = plans.where("skip_reason is not null").groupBy("phase_name", "skip_reason").agg(F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "skip_reason")))
    why = why.groupBy("phase_name").agg(F.concat_ws(";", F.transform(F.slice(ordered, 1, 3), lambda x: F.concat(x["skip_reason"], F.lit("="), (-x["m"]).cast("string")))).alias("top_reasons"))
    return counts.join(why, "phase_name", "left")


@query("a14_failure_sessions", "SELECT session_id, min(created_at) AS first_at, count(*) AS n FROM transitions WHERE outcome = 'failure' GROUP BY 1 ORDER BY first_at DESC, session_id LIMIT 20")
def failure_sessions(spark, d):
    failed = L.transitions(spark, d).where("outcome = 'failure'").groupBy("session_id").agg(F.min("created_at").alias("first_at"), F.count(F.lit(1)).alias("n"))
    return failed.orderBy(F.desc("first_at"), "session_id").limit(20)


@query("j03_failures_with_plans", "SELECT t.id, t.error_message, p.policy_name, p.status FROM transitions t LEFT JOIN plans p ON t.plan_id = p.id WHERE t.outcome = 'failure'")
def failures(spark, d):
    plans = L.plans(spark, d).select(F.col("id").alias("plan_id"), "policy_name", "status")
    return L.transitions(spark, d).where("outcome = 'failure'").join(plans, "plan_id", "left").select("id", "error_message", "policy_name", "status")


@query("j04_t24_due_for_verification", f"SELECT f.id FROM files f LEFT JOIN (SELECT file_id, max(verified_at) AS at FROM verifications GROUP BY 1) v ON v.file_id = f.id WHERE f.status = 'active' AND (v.at IS NULL OR v.at < TIMESTAMP '{CUT}')")
def due(spark, d):
    return H.due(L.files(spark, d), L.verifications(spark, d), F.lit(CUT).cast("timestamp_ntz")).select("id")


@query(
    "a15_j05_w01_w02_integrity",
    f"""WITH newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY verified_at DESC, id DESC) AS rn FROM verifications) WHERE rn = 1),
    hashed AS (SELECT *, lag(content_hash) OVER (PARTITION BY file_id ORDER BY verified_at, id) AS prev, row_number() OVER (PARTITION BY file_id ORDER BY verified_at DESC, id DESC) AS rn FROM verifications WHERE content_hash IS NOT NULL)
    SELECT count(*) AS total, count(*) FILTER (n.file_id IS NULL) AS never_verified, count(*) FILTER (n.verified_at < TIMESTAMP '{CUT}') AS stale, count(*) FILTER (n.outcome = 'error') AS with_errors, count(*) FILTER (n.outcome = 'warning') AS with_warnings,
    (SELECT count(*) FROM hashed WHERE rn = 1 AND prev <> content_hash) AS hash_mismatches FROM files f LEFT JOIN newest n ON n.file_id = f.id WHERE f.status = 'active'""",
)
def integrity(spark, d):
    return H.integrity(L.files(spark, d), L.verifications(spark, d), F.lit(CUT).cast("timestamp_ntz"))


@query(
    "w02_x28_hash_changes",
    "SELECT file_id, prev, content_hash FROM (SELECT *, lag(content_hash) OVER (PARTITION BY file_id ORDER BY verified_at, id) AS prev, row_number() OVER (PARTITION BY file_id ORDER BY verified_at DESC, id DESC) AS rn FROM verifications WHERE content_hash IS NOT NULL) WHERE rn = 1 AND prev <> content_hash",
)
def hash_changes(spark, d):
    return H.hash_changes(L.verifications(spark, d))


@query("j06_latest_health_with_ties", "SELECT h.id, h.check_name, h.passed FROM health_checks h JOIN (SELECT check_name, max(checked_at) AS at FROM health_checks GROUP BY 1) m ON h.check_name = m.check_name AND h.checked_at = m.at")
def latest_health(spark, d):
    return C.latest_with_ties(L.health_checks(spark, d), ["check_name"], "checked_at").select("id", "check_name", "passed")


@query("j15_vmaf_with_path", "SELECT o.id, f.path FROM outcomes o LEFT JOIN files f ON f.id = o.file_id")
def vmaf_paths(spark, d):
    return L.outcomes(spark, d).join(L.files(spark, d).select(F.col("id").alias("file_id"), "path"), "file_id", "left").select("id", "path")


@query("j20_latest_error_files", "SELECT f.id, f.path FROM files f JOIN (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY verified_at DESC, id DESC) AS rn FROM verifications) v ON v.file_id = f.id WHERE v.rn = 1 AND v.outcome = 'error' ORDER BY v.verified_at DESC, f.id LIMIT 50")
def error_files(spark, d):
    newest = C.latest_per(L.verifications(spark, d), ["file_id"], [F.desc("verified_at"), F.desc("id")]).where("outcome = 'error'").select(F.col("file_id").alias("id"), "verified_at")
    return L.files(spark, d).join(newest, "id").orderBy(F.desc("verified_at"), "id").limit(50).select("id", "path")


@query(
    "j17_d19_u06_lineage",
    "WITH RECURSIVE chain AS (SELECT id AS root, id, 0 AS hop FROM files UNION ALL SELECT c.root, f.id, c.hop + 1 FROM chain c JOIN files f ON f.superseded_by = c.id WHERE c.hop < 49 AND f.id <> c.root) SELECT root, id, hop FROM chain",
)
def lineage(spark, d):
    files = L.files(spark, d)
    return H.lineage(files, files)


@query(
    "j17_d19_u06_lineage_transitions",
    """WITH RECURSIVE chain AS (SELECT id AS root, id, 0 AS hop FROM files UNION ALL SELECT c.root, f.id, c.hop + 1 FROM chain c JOIN files f ON f.superseded_by = c.id WHERE c.hop < 49 AND f.id <> c.root)
    SELECT c.root, c.hop, c.id AS file_id, t.id AS transition_id, t.created_at FROM chain c JOIN transitions t ON t.file_id = c.id""",
)
def lineage_transitions(spark, d):
    files = L.files(spark, d)
    return H.lineage_transitions(H.lineage(files, files), L.transitions(spark, d))


@query("a16_k06_latency_rollup", "SELECT plugin_id, count(*) AS n, count(*) FILTER (outcome = 'ok') AS ok, count(*) FILTER (outcome = 'error') AS errors, count(*) FILTER (outcome = 'panic') AS panics, quantile_disc(duration_ms, 0.5) AS p50, quantile_disc(duration_ms, 0.95) AS p95, quantile_disc(duration_ms, 0.99) AS p99, CAST(sum(duration_ms) AS BIGINT) AS total_ms FROM plugin_stats GROUP BY 1 ORDER BY p95 DESC, plugin_id LIMIT 5")
def latency(spark, d):
    return H.latency_rollup(L.plugin_stats(spark, d), 5)


@query(
    "a17_vmaf_summary",
    """SELECT count(*) AS n, round(sum(CAST(round(achieved_vmaf * 100) AS BIGINT)) / count(achieved_vmaf) / 100 * 100) / 100 AS avg_vmaf, round(sum(iterations) / count(*) * 100) / 100 AS avg_iterations, round(count(*) FILTER (fallback_used) / count(*) * 10000) / 10000 AS fallback_rate,
    (SELECT count(*) FILTER (df > 0) FROM (SELECT target_vmaf - achieved_vmaf AS df FROM outcomes WHERE target_vmaf IS NOT NULL AND achieved_vmaf IS NOT NULL ORDER BY df DESC, id LIMIT 20)) AS missed FROM outcomes""",
)
def vmaf(spark, d):
    return H.vmaf_summary(L.outcomes(spark, d))


@query("a17_worst_vmaf", "SELECT id, target_vmaf - achieved_vmaf AS deficit FROM outcomes WHERE target_vmaf IS NOT NULL AND achieved_vmaf IS NOT NULL ORDER BY deficit DESC, id LIMIT 20")
def worst_vmaf(spark, d):
    known = L.outcomes(spark, d).where("target_vmaf is not null and achieved_vmaf is not null")
    return known.select("id", (F.col("target_vmaf") - F.col("achieved_vmaf")).alias("deficit")).orderBy(F.desc("deficit"), "id").limit(20)


@query("a18_loudness", "SELECT count(*) AS n, round(sum(CAST(round(lufs * 10) AS BIGINT)) / count(*) / 10 * 100) / 100 AS avg_lufs, round(sum(CAST(round(true_peak * 10) AS BIGINT)) / count(true_peak) / 10 * 100) / 100 AS avg_peak, count(*) FILTER (abs(lufs + 23) > 0.5) AS outside FROM tracks WHERE lufs IS NOT NULL")
def loudness(spark, d):
    return H.loudness(L.tracks(spark, d))


@query("a18_loudness_outliers", "SELECT file_id, stream_index, round(abs(lufs + 23) * 100) / 100 AS drift FROM tracks WHERE lufs IS NOT NULL ORDER BY drift DESC, file_id, stream_index LIMIT 10")
def outliers(spark, d):
    drift = H.round2(F.abs(F.col("lufs") + 23)).alias("drift")
    return L.tracks(spark, d).where("lufs is not null").select("file_id", "stream_index", drift).orderBy(F.desc("drift"), "file_id", "stream_index").limit(10)


@query("a19_loudness_points", "SELECT t.file_id, t.stream_index, t.lufs, t.true_peak FROM tracks t JOIN files f ON f.id = t.file_id WHERE t.lufs IS NOT NULL AND f.status = 'active'")
def points(spark, d):
    flat = L.with_tracks(spark, d).where("status = 'active'").select(F.col("id").alias("file_id"), F.explode("tracks").alias("t"))
    return flat.where("t.lufs is not null").select("file_id", "t.stream_index", "t.lufs", "t.true_peak")


_ACTIONS = """acts AS (SELECT file_id, size, pixels, phase_name, codec, preset, backend FROM (SELECT f.id AS file_id, f.size, t.width * 1000 AS pixels, 'transcode' AS phase_name, 'hevc' AS codec, 'slow' AS preset, CASE WHEN f.id % 2 = 0 THEN 'sw' ELSE 'nvenc' END AS backend
    FROM files f JOIN tracks t ON t.file_id = f.id WHERE t.track_type = 'video' AND t.codec <> 'hevc' AND t.width IS NOT NULL)),
    prof AS (SELECT phase_name, codec, preset, backend, list_sort(list(pixels_per_second))[len(list(pixels_per_second)) // 2 + 1] AS speed, list_sort(list(output_size_ratio))[len(list(output_size_ratio)) // 2 + 1] AS ratio, list_sort(list(fixed_overhead_ms))[len(list(fixed_overhead_ms)) // 2 + 1] AS overhead, count(*) AS n_samples FROM samples GROUP BY 1, 2, 3, 4),
    est AS (SELECT a.*, coalesce(CAST(round(size * ratio) AS BIGINT), size) AS bytes_out, coalesce(CAST(round(pixels / speed * 1000) AS BIGINT) + overhead, 0) AS time_ms, coalesce(n_samples, 0) AS n_samples FROM acts a LEFT JOIN prof USING (phase_name, codec, preset, backend)),
    per AS (SELECT file_id, max(size) AS bytes_in, max(bytes_out) AS bytes_out, CAST(sum(time_ms) AS BIGINT) AS time_ms, bool_or(n_samples < 3) AS uncertain FROM est GROUP BY 1)"""


def _actions(spark, d):
    video = L.tracks(spark, d).where("track_type = 'video' and codec <> 'hevc' and width is not null").select("file_id", "width")
    df = L.files(spark, d).select(F.col("id").alias("file_id"), "size").join(video, "file_id")
    return df.select(
        "file_id", "size", (F.col("width") * 1000).alias("pixels"), F.lit("transcode").alias("phase_name"), F.lit("hevc").alias("codec"), F.lit("slow").alias("preset"), F.when(F.col("file_id") % 2 == 0, "sw").otherwise("nvenc").alias("backend")
    )


@query("a20_j14_estimate_files", f"WITH {_ACTIONS} SELECT * FROM per")
def estimate_files(spark, d):
    return H.estimate(_actions(spark, d), L.samples(spark, d), 4)["files"]


@query("a20_estimate_run", f"WITH {_ACTIONS} SELECT count(*) AS file_count, CAST(sum(bytes_in) AS BIGINT) AS bytes_in, CAST(sum(bytes_out) AS BIGINT) AS bytes_out, CAST(sum(bytes_in - bytes_out) AS BIGINT) AS bytes_saved, CAST(sum(time_ms) AS BIGINT) AS compute_ms, CAST(ceil(sum(time_ms)::DOUBLE / 4) AS BIGINT) AS wall_ms, count(*) FILTER (uncertain) AS uncertain_files, count(*) FILTER (bytes_out > bytes_in) AS net_loss_files FROM per")
def estimate_run(spark, d):
    return H.estimate(_actions(spark, d), L.samples(spark, d), 4)["run"]


@query("a21_estimate_breakdown", f"WITH {_ACTIONS} SELECT codec, backend, count(*) AS n, CAST(sum(bytes_out) AS BIGINT) AS bytes_out, CAST(sum(time_ms) AS BIGINT) AS time_ms FROM est GROUP BY 1, 2")
def breakdown(spark, d):
    acts = H.estimate(_actions(spark, d), L.samples(spark, d), 4)["actions"]
    return acts.groupBy("codec", "backend").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes_out").alias("bytes_out"), F.sum("time_ms").alias("time_ms"))


@query("a21_estimate_breakdown_by_phase_and_back_end", f"WITH {_ACTIONS} SELECT phase_name, codec, backend, count(*) AS n, CAST(sum(bytes_out) AS BIGINT) AS bytes_out, CAST(sum(time_ms) AS BIGINT) AS time_ms FROM est GROUP BY GROUPING SETS ((phase_name), (codec, backend))")
def breakdowns(spark, d):
    acts = H.estimate(_actions(spark, d), L.samples(spark, d), 4)["actions"]
    sets = acts.groupingSets([[F.col("phase_name")], [F.col("codec"), F.col("backend")]], F.col("phase_name"), F.col("codec"), F.col("backend"))
    return sets.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes_out").alias("bytes_out"), F.sum("time_ms").alias("time_ms"))


_BENCH = "b AS (SELECT *, 1000000 + id * 100 AS input_bytes, CAST(round((1000000 + id * 100) * output_size_ratio) AS BIGINT) AS output_bytes, 100000000 + id * 1000 AS pixels, CAST(round((100000000 + id * 1000) / pixels_per_second * 1000) AS BIGINT) + fixed_overhead_ms AS elapsed_ms FROM samples)"
_ERROR = "CASE WHEN {a} <= 0 THEN 0 ELSE abs({e} - {a}) / {a} END"


@query(
    "a22_calibration_report",
    f"""WITH {_BENCH}, m AS (SELECT a.id, list_sort(list(o.output_size_ratio))[len(list(o.output_size_ratio)) // 2 + 1] AS ratio, list_sort(list(o.pixels_per_second))[len(list(o.pixels_per_second)) // 2 + 1] AS speed
    FROM b a JOIN b o ON a.phase_name = o.phase_name AND a.codec = o.codec AND a.preset = o.preset AND a.backend = o.backend AND a.id <> o.id GROUP BY 1),
    e AS (SELECT b.*, CAST(round(input_bytes * ratio) AS BIGINT) AS bytes, CAST(round(pixels / speed * 1000) AS BIGINT) AS ms FROM b JOIN m USING (id)),
    g AS (SELECT phase_name, codec, preset, backend, count(*) AS fixtures, sum(input_bytes - bytes) AS sv, sum(input_bytes - output_bytes) AS rs, sum(bytes) AS bs, sum(output_bytes) AS ob, sum(ms) AS ms, sum(elapsed_ms) AS el, max({_ERROR.format(e="bytes", a="output_bytes")}) AS mb, max({_ERROR.format(e="ms", a="elapsed_ms")}) AS mt FROM e GROUP BY ALL)
    SELECT phase_name, codec, preset, backend, fixtures, round({_ERROR.format(e="sv", a="rs")} * 10000) / 10000 AS savings_error, round({_ERROR.format(e="bs", a="ob")} * 10000) / 10000 AS bytes_error, round({_ERROR.format(e="ms", a="el")} * 10000) / 10000 AS time_error, round(mb * 10000) / 10000 AS max_bytes_error, round(mt * 10000) / 10000 AS max_time_error FROM g""",
)
def calibration_report(spark, d):
    size, pixels = 1_000_000 + F.col("id") * 100, 100_000_000 + F.col("id") * 1000
    bench = L.samples(spark, d).select(
        "*", size.alias("input_bytes"), F.round(size * F.col("output_size_ratio")).cast("long").alias("output_bytes"), pixels.alias("pixels"),
        (F.round(pixels / F.col("pixels_per_second") * 1000).cast("long") + F.col("fixed_overhead_ms")).alias("elapsed_ms"),
    )
    return H.calibration_report(bench)


@query("t25_estimate_gate", f"WITH {_ACTIONS} SELECT file_id FROM per WHERE bytes_in - bytes_out < 5000000")
def gate(spark, d):
    return H.estimate(_actions(spark, d), L.samples(spark, d), 4)["files"].where("bytes_in - bytes_out < 5000000").select("file_id")


@query(
    "a22_calibration",
    "SELECT a.id, any_value(a.output_size_ratio) AS output_size_ratio, list_sort(list(b.output_size_ratio))[len(list(b.output_size_ratio)) // 2 + 1] AS median_of_others FROM samples a JOIN samples b ON a.phase_name = b.phase_name AND a.codec = b.codec AND a.preset = b.preset AND a.backend = b.backend AND a.id <> b.id GROUP BY a.id",
)
def calibration(spark, d):
    return H.leave_one_out(L.samples(spark, d))


_VOTES = """v AS (SELECT user_id AS file_id, event_id % 3 AS track, CASE WHEN event_id % 3 = 0 THEN 'eng' ELSE CASE user_id % 3 WHEN 0 THEN 'jpn' WHEN 1 THEN 'eng' ELSE 'fre' END END AS language,
    CASE WHEN user_id % 4 = 0 THEN 91 + event_id % 9 ELSE event_id % 101 END AS silence FROM events)"""


def _votes(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    lang = F.when(e % 3 == 0, "eng").otherwise(L.pick(("jpn", "eng", "fre"), u))
    silence = F.when(u % 4 == 0, 91 + e % 9).otherwise(e % 101)
    return L.read(spark, d, "events").select(u.alias("file_id"), (e % 3).alias("track"), lang.alias("language"), silence.alias("silence"))


@query(
    "a23_language_vote",
    f"""WITH {_VOTES}, p AS (SELECT file_id, track, language, sum(100 - silence) AS s, count(*) AS k FROM v WHERE silence <= 90 GROUP BY 1, 2, 3),
    t AS (SELECT *, sum(k) OVER (PARTITION BY file_id, track) AS total, row_number() OVER (PARTITION BY file_id, track ORDER BY s DESC, language) AS rn FROM p)
    SELECT a.file_id, a.track, coalesce(t.language, 'zxx') AS language, round(CASE WHEN t.language IS NULL THEN a.silence / a.n ELSE t.s / t.total END / 100 * 10000) / 10000 AS confidence
    FROM (SELECT file_id, track, sum(silence) AS silence, count(*) AS n FROM v GROUP BY 1, 2) a LEFT JOIN t ON t.file_id = a.file_id AND t.track = a.track AND t.rn = 1""",
)
def vote(spark, d):
    return H.language_vote(_votes(spark, d))


@query("a24_multi_language", f"WITH {_VOTES} SELECT file_id, count(DISTINCT language) > 1 AS multi FROM v GROUP BY 1")
def multi(spark, d):
    return _votes(spark, d).groupBy("file_id").agg((F.countDistinct("language") > 1).alias("multi"))


@query("a31_crop_merge", "SELECT user_id AS file_id, CASE WHEN min(event_id % 90) >= 4 THEN min(event_id % 90) // 2 * 2 ELSE 0 END AS left, CASE WHEN min(event_id % 50 + 3) >= 4 THEN min(event_id % 50 + 3) // 2 * 2 ELSE 0 END AS top, CASE WHEN min(event_id % 31) >= 4 THEN min(event_id % 31) // 2 * 2 ELSE 0 END AS right, CASE WHEN min(event_id % 7) >= 4 THEN min(event_id % 7) // 2 * 2 ELSE 0 END AS bottom FROM events GROUP BY 1")
def crop(spark, d):
    e = F.col("event_id")
    return H.conservative_crop(L.read(spark, d, "events").select(F.col("user_id").alias("file_id"), (e % 90).alias("left"), (e % 50 + 3).alias("top"), (e % 31).alias("right"), (e % 7).alias("bottom")))


@query("a28_phase_stats", "SELECT session_id, phase_name, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed FROM plans GROUP BY 1, 2")
def phase_stats(spark, d):
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return L.plans(spark, d).groupBy("session_id", "phase_name").agg(n("completed"), n("skipped"), n("failed"))


@query("a32_queue_weight", "SELECT job_type, count(*) FILTER (status = 'pending') AS queued, count(*) FILTER (status = 'completed') AS done, round(count(*) FILTER (status = 'completed') / count(*) * 10000) / 10000 AS share FROM jobs GROUP BY 1")
def queue_weight(spark, d):
    n = lambda s: F.count_if(F.col("status") == s)
    return L.jobs(spark, d).groupBy("job_type").agg(n("pending").alias("queued"), n("completed").alias("done"), H.round4(n("completed") / F.count(F.lit(1))).alias("share"))


def _retained(name, view, at, extra=""):
    key = "rowid" if view in ("plugin_stats", "event_log") else "id"
    sql = f"SELECT {key} AS id FROM (SELECT *, row_number() OVER (ORDER BY {at} DESC, {key} DESC) AS rn FROM {view} {extra}) WHERE {at} < TIMESTAMP '{CUT}' OR rn > 300"

    @query(name, sql)
    def run(spark, d):
        df = getattr(L, view)(spark, d)
        if extra:
            df = df.where(extra.removeprefix("WHERE "))
        df = df.select(F.col(key).alias("id"), F.expr(at).alias("at"))
        return H.doomed(df, F.col("at"), [F.desc("at"), F.desc("id")], F.lit(CUT).cast("timestamp_ntz"), 300).select("id")


_retained("w03_t10_prune_plugin_stats", "plugin_stats", "started_at")
_retained("w04_prune_event_log", "event_log", "created_at")
_retained("w05_prune_jobs", "jobs", "coalesce(completed_at, created_at)", "WHERE status in ('completed', 'failed', 'cancelled')")


@query("w06_prune_transitions", f"SELECT id FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) AS rn FROM transitions t WHERE id <> (SELECT max(id) FROM transitions m WHERE m.file_id = t.file_id)) WHERE created_at < TIMESTAMP '{CUT}' OR rn > 300")
def prune_transitions(spark, d):
    t = L.transitions(spark, d).select("id", "file_id", F.col("created_at").alias("at"))
    last = t.groupBy("file_id").agg(F.max("id").alias("id")).select("id")
    rest = t.join(last, "id", "left_anti")
    return H.doomed(rest, F.col("at"), [F.desc("at"), F.desc("id")], F.lit(CUT).cast("timestamp_ntz"), 300).select("id")


@query("t11_purge_missing", f"SELECT f.id, count(t.id) AS transitions FROM files f LEFT JOIN transitions t ON t.file_id = f.id WHERE f.status = 'missing' AND f.created_at < TIMESTAMP '{CUT}' GROUP BY 1")
def purge(spark, d):
    gone = L.files(spark, d).where("status = 'missing'").where(F.col("created_at") < F.lit(CUT).cast("timestamp_ntz")).select("id")
    logs = L.transitions(spark, d).groupBy(F.col("file_id").alias("id")).agg(F.count(F.lit(1)).alias("transitions"))
    return gone.join(logs, "id", "left").na.fill(0, ["transitions"])


@query("t12_prune_by_rowid_gap", "SELECT rowid FROM event_log WHERE event_type = 'plan.failed' AND rowid <= (SELECT max(rowid) FROM event_log WHERE event_type = 'plan.failed') - 200")
def rowid_gap(spark, d):
    log = L.event_log(spark, d).where("event_type = 'plan.failed'")
    top = log.agg(F.max("rowid").alias("top"))
    return log.crossJoin(F.broadcast(top)).where("rowid <= top - 200").select("rowid")


@query("t14_bad_file_upsert", "SELECT path, count(*) AS attempt_count, min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at, arg_max(error, seen_at) AS error FROM bad_files GROUP BY 1")
def bad_upsert(spark, d):
    return L.bad_files(spark, d).groupBy("path").agg(F.count(F.lit(1)).alias("attempt_count"), F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"), F.max_by("error", F.struct("seen_at", "id")).alias("error"))


@query("s10_t15_last_write_wins", "SELECT plugin_id, event_type, duration_ms AS value FROM (SELECT *, row_number() OVER (PARTITION BY plugin_id, event_type ORDER BY started_at DESC, rowid DESC) AS rn FROM plugin_stats) WHERE rn = 1 AND outcome <> 'panic'")
def kv(spark, d):
    return C.latest_per(L.plugin_stats(spark, d), ["plugin_id", "event_type"], [F.desc("started_at"), F.desc("rowid")]).where("outcome <> 'panic'").select("plugin_id", "event_type", F.col("duration_ms").alias("value"))


@query("t26_job_retry", "SELECT id, CASE WHEN status IN ('failed', 'cancelled') THEN 'pending' ELSE status END AS status FROM jobs")
def retry(spark, d):
    return L.jobs(spark, d).select("id", F.when(F.col("status").isin("failed", "cancelled"), "pending").otherwise(F.col("status")).alias("status"))


@query("w07_first_per_language", "SELECT file_id, stream_index FROM (SELECT *, row_number() OVER (PARTITION BY file_id, language ORDER BY stream_index) AS rn FROM tracks WHERE track_type LIKE 'audio%') WHERE rn = 1")
def first_per_language(spark, d):
    audio = L.tracks(spark, d).where(F.col("track_type").startswith("audio"))
    return audio.withColumn("rn", F.row_number().over(W.partitionBy("file_id", "language").orderBy("stream_index"))).where("rn = 1").select("file_id", "stream_index")
