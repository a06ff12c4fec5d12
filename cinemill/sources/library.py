"""The media library as views over the driver's tables.

files and tracks come from orders and lineitem; the logs (transitions, verifications, statistics,
jobs, plans, event log) come from events. VIEWS holds the same definitions as DuckDB SQL, which the
oracles put in front of their queries. Derivations use integers and exact doubles only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CONTAINERS = ("mkv", "mp4", "avi", "mov", "webm")
VIDEO, AUDIO, SUBTITLE = ("h264", "hevc", "av1", "mpeg2video"), ("aac", "ac3", "dts", "flac", "opus"), ("subrip", "ass", "hdmv_pgs_subtitle")
LANGUAGES = ("eng", "jpn", "fre", "spa", "ger", "und")
WIDTHS = (7680, 3840, 1920, 1280, 640, None)
RATES = (23.976, 24.0, 25.0, 29.97, 59.94, 12.5)
ERRORS = (
    "Unknown encoder 'hevc_nvenc'", "CUDA_ERROR_OUT_OF_MEMORY: out of memory, then Conversion failed!", "CUDA_ERROR_UNKNOWN: unknown error", "InitializeEncoder failed: out of memory (10)",
    "Error submitting packet to decoder: Cannot allocate memory", "Impossible to convert between the formats of a and b", "No device available for decoder: device type cuda", "Nothing was written into output file 0",
    "Conversion failed!", "ffmpeg exited with exit status: 1 at /media/a.mkv", "failed to insert transcode outcome: FOREIGN KEY constraint failed",
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, n: Column) -> Column:
    """values[n mod their number], null entries included."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (n % len(values)).cast("int") + 1)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    ext = pick(CONTAINERS, k)
    return read(spark, sf_dir, "orders").select(
        k.alias("id"),
        F.concat(F.lit("/media/"), F.col("o_orderpriority"), F.lit("/"), k.cast("string"), F.lit("."), ext).alias("path"),
        F.concat(k.cast("string"), F.lit("."), ext).alias("filename"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("size"),
        F.concat(F.lit("h"), (F.col("o_custkey") % 700).cast("string")).alias("content_hash"),
        F.when(k % 7 != 0, F.concat(F.lit("h"), (F.col("o_custkey") % 700).cast("string"))).alias("expected_hash"),
        F.when(F.col("o_orderstatus") == "P", "missing").otherwise("active").alias("status"),
        ext.alias("container"),
        (F.col("o_totalprice") / 10).alias("duration"),
        F.when(k % 11 == 0, k - 11).alias("superseded_by"),
        F.when(k % 3 != 0, F.concat(F.lit("s"), (k % 4).cast("string"))).alias("last_seen_session_id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
    )


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax")
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    i = F.col("stream_index")
    video, audio, subtitle = i == 0, (i > 0) & (p % 4 < 2), (i > 0) & (p % 4 == 2)
    kind = F.when(video, "video").when(audio & (s % 6 == 0), "audio_commentary").when(audio, "audio_main").when(subtitle & (s % 5 == 0), "subtitle_forced").when(subtitle, "subtitle_main").otherwise("attachment")
    df = read(spark, sf_dir, "lineitem").withColumn("stream_index", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)) - 1)
    return df.select(
        F.col("l_orderkey").alias("file_id"), i, kind.alias("track_type"),
        F.when(video, pick(VIDEO, s)).when(audio, pick(AUDIO, s)).when(subtitle, pick(SUBTITLE, s)).otherwise(F.when(s % 2 == 0, "ttf").otherwise("mjpeg")).alias("codec"),
        pick(LANGUAGES, p).alias("language"),
        F.when(p % 9 == 0, "Director Commentary").when(p % 9 == 1, "font.OTF").otherwise(F.concat(F.lit("Track "), i.cast("string"))).alias("title"),
        (F.col("l_returnflag") == "R").alias("is_default"), (F.col("l_linestatus") == "F").alias("is_forced"),
        F.when(audio, pick((2, 6, 8, None), F.col("l_quantity").cast("long"))).alias("channels"),
        F.when(audio, pick(("stereo", "5.1", "7.1"), p)).alias("channel_layout"),
        F.when(audio, pick((44100, 48000, 96000), s)).alias("sample_rate"), F.when(audio, pick((16, 24, None), p)).alias("bit_depth"),
        F.when(audio & (p % 5 != 0), ((p % 41) - 250) / 10).alias("lufs"), F.when(audio & (p % 5 != 0), (0 - (p % 31)) / 10).alias("true_peak"),
        F.when(video, pick(WIDTHS, p)).alias("width"), F.when(video, pick(RATES, s)).alias("frame_rate"),
        (video & (p % 3 == 0)).alias("is_hdr"), (video & (p % 8 == 0)).alias("is_vfr"),
        F.when(video & (p % 3 == 0), pick(("HDR10", "HLG", "unknown", None), s)).alias("hdr_format"), F.when(video, pick(("yuv420p", "yuv420p10le", None), s)).alias("pixel_format"),
    )


def with_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with their tracks as an array of structs in stream order; no tracks gives an empty array."""
    t = tracks(spark, sf_dir)
    cols = [c for c in t.columns if c != "file_id"]
    nested = t.groupBy(F.col("file_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("tracks"))
    kind = dict(nested.dtypes)["tracks"]
    return files(spark, sf_dir).join(nested, "id", "left").withColumn("tracks", F.coalesce("tracks", F.array().cast(kind)))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    kind = pick(("file.discovered", "file.introspected", "plan.created", "plan.failed", "job.started", "job.completed", "plugin.error"), e)
    return events(spark, sf_dir).select(e.alias("rowid"), kind.alias("event_type"), F.col("props").alias("payload"), F.concat(kind, F.lit(" user "), u.cast("string")).alias("summary"), F.col("ts").alias("created_at"))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u, v = F.col("event_id"), F.col("user_id"), F.round(F.col("value") * 100).cast("long")
    return events(spark, sf_dir).select(
        e.alias("id"), u.alias("file_id"), F.concat(F.lit("/media/f"), u.cast("string")).alias("path"), F.when(e % 5 == 0, F.concat(F.lit("/media/old"), u.cast("string"))).alias("from_path"),
        F.when(e % 13 != 0, v + 1000).alias("from_size"), (v + 1000 - (e % 700)).alias("to_size"), pick(("discovery", "engine", "external"), e).alias("source"),
        F.when(e % 3 == 1, pick(("ffmpeg", "mkvtoolnix"), u)).alias("executor"), pick(("normalize", "transcode", "cleanup"), u).alias("phase_name"),
        F.when(e % 4 == 0, "failure").otherwise("success").alias("outcome"), F.when(e % 4 == 0, pick(ERRORS, u)).alias("error_message"),
        F.when(e % 6 != 0, e + 1).alias("plan_id"), (e % 5000).alias("duration_ms"), F.concat(F.lit("run"), (e % 9).cast("string")).alias("session_id"), F.col("ts").alias("created_at"),
    )


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    status = pick(("completed", "skipped", "failed", "pending"), e)
    return events(spark, sf_dir).select(
        e.alias("id"), u.alias("file_id"), pick(("policy_a", "policy_b"), e).alias("policy_name"), pick(("normalize", "transcode", "cleanup"), u).alias("phase_name"), status.alias("status"),
        F.when(status == "skipped", pick(("no changes", "dependency not met", "condition", "hardware"), u)).alias("skip_reason"), F.concat(F.lit("run"), (e % 9).cast("string")).alias("session_id"), F.col("ts").alias("created_at"),
    )


def verifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    return events(spark, sf_dir).where("event_type in ('view', 'click')").select(
        e.alias("id"), u.alias("file_id"), F.col("ts").alias("verified_at"), pick(("quick", "thorough", "hash"), e).alias("mode"), pick(("ok", "ok", "warning", "error"), e).alias("outcome"),
        (e % 3).alias("error_count"), (e % 2).alias("warning_count"), F.when(e % 3 == 2, F.concat(F.lit("c"), (e % 4).cast("string"))).alias("content_hash"),
    )


def plugin_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    return events(spark, sf_dir).select(
        e.alias("rowid"), F.concat(F.lit("plugin"), (u % 7).cast("string")).alias("plugin_id"), F.col("event_type"), F.col("ts").alias("started_at"), F.round(F.col("value") * 10).cast("long").alias("duration_ms"),
        pick(("ok", "ok", "ok", "error", "panic"), e).alias("outcome"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    status = pick(("pending", "running", "completed", "failed", "cancelled"), e)
    return events(spark, sf_dir).select(
        e.alias("id"), pick(("process", "scan", "verify"), u).alias("job_type"), status.alias("status"), pick((10, 50, 100, 200), u).alias("priority"), F.col("ts").alias("created_at"),
        F.when((e % 5 >= 2) & (e % 3 != 0), F.col("ts") + F.expr("make_dt_interval(0, 1)")).alias("completed_at"),
    )


def bad_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per failed attempt: (path, size, error, error_source, seen_at, id)."""
    e, u = F.col("event_id"), F.col("user_id")
    return events(spark, sf_dir).where("event_type = 'error'").select(
        F.concat(F.lit("/media/"), pick(("a", "b", "c_d"), u), F.lit("/f"), u.cast("string")).alias("path"), (e % 1000).alias("size"), pick(ERRORS, e).alias("error"), pick(("parse", "io", "probe"), u).alias("error_source"),
        F.col("ts").alias("seen_at"), e.alias("id"),
    )


def health_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return events(spark, sf_dir).where("event_type = 'signup'").select(e.alias("id"), pick(("disk", "ffmpeg", "database"), e).alias("check_name"), (e % 4 != 0).alias("passed"), F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("checked_at"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcode outcomes with target and achieved quality."""
    e, u = F.col("event_id"), F.col("user_id")
    return events(spark, sf_dir).where("event_type = 'purchase'").select(
        e.alias("id"), u.alias("file_id"), F.when(e % 10 != 0, 90 + e % 6).alias("target_vmaf"), F.when(e % 7 != 0, (e % 200 + 8000) / 100).alias("achieved_vmaf"), (e % 51).alias("crf_used"), (e % 5 + 1).alias("iterations"),
        (e % 4 == 0).alias("fallback_used"), F.col("ts").alias("completed_at"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost model samples: speed, size ratio and overhead by phase, codec, preset and backend."""
    e, u = F.col("event_id"), F.col("user_id")
    return events(spark, sf_dir).where("event_type in ('purchase', 'view')").select(
        e.alias("id"), pick(("transcode", "normalize"), e).alias("phase_name"), pick(("hevc", "av1", "h264"), u).alias("codec"), pick(("fast", "slow"), u).alias("preset"), pick(("sw", "nvenc"), e).alias("backend"),
        ((u % 90 + 10) * 1000.0).alias("pixels_per_second"), ((e % 80 + 20) / 100).alias("output_size_ratio"), (e % 400).alias("fixed_overhead_ms"), F.col("ts").alias("completed_at"),
    )


def _case(values, n: str) -> str:
    quote = lambda v: "NULL" if v is None else f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else str(v)
    return f"(CASE ({n}) % {len(values)} " + " ".join(f"WHEN {i} THEN {quote(v)}" for i, v in enumerate(values)) + " END)"


_VIDEO, _AUDIO, _SUB = "i = 0", "(i > 0 AND l_partkey % 4 < 2)", "(i > 0 AND l_partkey % 4 = 2)"
#: DuckDB definitions of the same views.
VIEWS = {
    "files": f"""SELECT o_orderkey AS id, '/media/' || o_orderpriority || '/' || o_orderkey || '.' || {_case(CONTAINERS, "o_orderkey")} AS path,
      o_orderkey || '.' || {_case(CONTAINERS, "o_orderkey")} AS filename, CAST(round(o_totalprice * 100) AS BIGINT) AS size, 'h' || (o_custkey % 700) AS content_hash,
      CASE WHEN o_orderkey % 7 <> 0 THEN 'h' || (o_custkey % 700) END AS expected_hash, CASE WHEN o_orderstatus = 'P' THEN 'missing' ELSE 'active' END AS status,
      {_case(CONTAINERS, "o_orderkey")} AS container, o_totalprice / 10 AS duration, CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey - 11 END AS superseded_by,
      CASE WHEN o_orderkey % 3 <> 0 THEN 's' || (o_orderkey % 4) END AS last_seen_session_id, o_orderdate AS created_at FROM orders""",
    "tracks": f"""SELECT l_orderkey AS file_id, i AS stream_index,
      CASE WHEN {_VIDEO} THEN 'video' WHEN {_AUDIO} AND l_suppkey % 6 = 0 THEN 'audio_commentary' WHEN {_AUDIO} THEN 'audio_main' WHEN {_SUB} AND l_suppkey % 5 = 0 THEN 'subtitle_forced' WHEN {_SUB} THEN 'subtitle_main' ELSE 'attachment' END AS track_type,
      CASE WHEN {_VIDEO} THEN {_case(VIDEO, "l_suppkey")} WHEN {_AUDIO} THEN {_case(AUDIO, "l_suppkey")} WHEN {_SUB} THEN {_case(SUBTITLE, "l_suppkey")} WHEN l_suppkey % 2 = 0 THEN 'ttf' ELSE 'mjpeg' END AS codec,
      {_case(LANGUAGES, "l_partkey")} AS language, CASE WHEN l_partkey % 9 = 0 THEN 'Director Commentary' WHEN l_partkey % 9 = 1 THEN 'font.OTF' ELSE 'Track ' || i END AS title,
      l_returnflag = 'R' AS is_default, l_linestatus = 'F' AS is_forced, CASE WHEN {_AUDIO} THEN {_case((2, 6, 8, None), "CAST(l_quantity AS BIGINT)")} END AS channels,
      CASE WHEN {_AUDIO} THEN {_case(("stereo", "5.1", "7.1"), "l_partkey")} END AS channel_layout, CASE WHEN {_AUDIO} THEN {_case((44100, 48000, 96000), "l_suppkey")} END AS sample_rate,
      CASE WHEN {_AUDIO} THEN {_case((16, 24, None), "l_partkey")} END AS bit_depth, CASE WHEN {_AUDIO} AND l_partkey % 5 <> 0 THEN ((l_partkey % 41) - 250)::DOUBLE / 10 END AS lufs,
      CASE WHEN {_AUDIO} AND l_partkey % 5 <> 0 THEN (0 - (l_partkey % 31))::DOUBLE / 10 END AS true_peak, CASE WHEN {_VIDEO} THEN {_case(WIDTHS, "l_partkey")} END AS width,
      CASE WHEN {_VIDEO} THEN CAST({_case(RATES, "l_suppkey")} AS DOUBLE) END AS frame_rate, ({_VIDEO} AND l_partkey % 3 = 0) AS is_hdr, ({_VIDEO} AND l_partkey % 8 = 0) AS is_vfr,
      CASE WHEN {_VIDEO} AND l_partkey % 3 = 0 THEN {_case(("HDR10", "HLG", "unknown", None), "l_suppkey")} END AS hdr_format, CASE WHEN {_VIDEO} THEN {_case(("yuv420p", "yuv420p10le", None), "l_suppkey")} END AS pixel_format
      FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) - 1 AS INTEGER) AS i FROM lineitem)""",
    "event_log": f"""SELECT event_id AS rowid, k AS event_type, props AS payload, k || ' user ' || user_id AS summary, ts AS created_at
      FROM (SELECT *, {_case(("file.discovered", "file.introspected", "plan.created", "plan.failed", "job.started", "job.completed", "plugin.error"), "event_id")} AS k FROM events)""",
    "transitions": f"""SELECT event_id AS id, user_id AS file_id, '/media/f' || user_id AS path, CASE WHEN event_id % 5 = 0 THEN '/media/old' || user_id END AS from_path,
      CASE WHEN event_id % 13 <> 0 THEN CAST(round(value * 100) AS BIGINT) + 1000 END AS from_size, CAST(round(value * 100) AS BIGINT) + 1000 - (event_id % 700) AS to_size, {_case(("discovery", "engine", "external"), "event_id")} AS source,
      CASE WHEN event_id % 3 = 1 THEN {_case(("ffmpeg", "mkvtoolnix"), "user_id")} END AS executor, {_case(("normalize", "transcode", "cleanup"), "user_id")} AS phase_name,
      CASE WHEN event_id % 4 = 0 THEN 'failure' ELSE 'success' END AS outcome, CASE WHEN event_id % 4 = 0 THEN {_case(ERRORS, "user_id")} END AS error_message,
      CASE WHEN event_id % 6 <> 0 THEN event_id + 1 END AS plan_id, event_id % 5000 AS duration_ms, 'run' || (event_id % 9) AS session_id, ts AS created_at FROM events""",
    "plans": f"""SELECT event_id AS id, user_id AS file_id, {_case(("policy_a", "policy_b"), "event_id")} AS policy_name, {_case(("normalize", "transcode", "cleanup"), "user_id")} AS phase_name, s AS status,
      CASE WHEN s = 'skipped' THEN {_case(("no changes", "dependency not met", "condition", "hardware"), "user_id")} END AS skip_reason, 'run' || (event_id % 9) AS session_id, ts AS created_at
      FROM (SELECT *, {_case(("completed", "skipped", "failed", "pending"), "event_id")} AS s FROM events)""",
    "verifications": f"""SELECT event_id AS id, user_id AS file_id, ts AS verified_at, {_case(("quick", "thorough", "hash"), "event_id")} AS mode, {_case(("ok", "ok", "warning", "error"), "event_id")} AS outcome,
      event_id % 3 AS error_count, event_id % 2 AS warning_count, CASE WHEN event_id % 3 = 2 THEN 'c' || (event_id % 4) END AS content_hash FROM events WHERE event_type IN ('view', 'click')""",
    "plugin_stats": f"""SELECT event_id AS rowid, 'plugin' || (user_id % 7) AS plugin_id, event_type, ts AS started_at, CAST(round(value * 10) AS BIGINT) AS duration_ms, {_case(("ok", "ok", "ok", "error", "panic"), "event_id")} AS outcome FROM events""",
    "jobs": f"""SELECT event_id AS id, {_case(("process", "scan", "verify"), "user_id")} AS job_type, {_case(("pending", "running", "completed", "failed", "cancelled"), "event_id")} AS status, {_case((10, 50, 100, 200), "user_id")} AS priority,
      ts AS created_at, CASE WHEN event_id % 5 >= 2 AND event_id % 3 <> 0 THEN ts + INTERVAL 1 HOUR END AS completed_at FROM events""",
    "bad_files": f"""SELECT '/media/' || {_case(("a", "b", "c_d"), "user_id")} || '/f' || user_id AS path, event_id % 1000 AS size, {_case(ERRORS, "event_id")} AS error, {_case(("parse", "io", "probe"), "user_id")} AS error_source, ts AS seen_at, event_id AS id
      FROM events WHERE event_type = 'error'""",
    "health_checks": f"""SELECT event_id AS id, {_case(("disk", "ffmpeg", "database"), "event_id")} AS check_name, event_id % 4 <> 0 AS passed, date_trunc('day', ts) AS checked_at FROM events WHERE event_type = 'signup'""",
    "outcomes": """SELECT event_id AS id, user_id AS file_id, CASE WHEN event_id % 10 <> 0 THEN 90 + event_id % 6 END AS target_vmaf, CASE WHEN event_id % 7 <> 0 THEN (event_id % 200 + 8000)::DOUBLE / 100 END AS achieved_vmaf, event_id % 51 AS crf_used,
      event_id % 5 + 1 AS iterations, event_id % 4 = 0 AS fallback_used, ts AS completed_at FROM events WHERE event_type = 'purchase'""",
    "samples": f"""SELECT event_id AS id, {_case(("transcode", "normalize"), "event_id")} AS phase_name, {_case(("hevc", "av1", "h264"), "user_id")} AS codec, {_case(("fast", "slow"), "user_id")} AS preset, {_case(("sw", "nvenc"), "event_id")} AS backend,
      ((user_id % 90 + 10) * 1000)::DOUBLE AS pixels_per_second, (event_id % 80 + 20)::DOUBLE / 100 AS output_size_ratio, event_id % 400 AS fixed_overhead_ms, ts AS completed_at FROM events WHERE event_type IN ('purchase', 'view')""",
}


def oracle(sql: str) -> str:
    """A query with the definitions of the views it names put before it."""
    import re

    used = [name for name in VIEWS if re.search(rf"\b{name}\b", sql)]
    if not used:
        return sql
    body = ", ".join(f"{name} AS ({VIEWS[name]})" for name in used)
    if sql.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {body}, {sql[15:]}"
    return f"WITH {body}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {body} {sql}"
