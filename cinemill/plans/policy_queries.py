"""Registered queries of track filters, file conditions and operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinemill.plans import policy as P
from cinemill.plans import settings as S
from cinemill.plans.registry import query
from cinemill.sources import library as L

#: Track filters with the same predicate as SQL over a row of tracks t (and the file f).
FILTERS = {
    "p01_lang_in": ({"lang": ["eng", "jpn"]}, "t.language IN ('eng', 'jpn')"),
    "p02_lang_not": ({"lang_not": "eng"}, "coalesce(t.language <> 'eng', false)"),
    "p03_lang_field": ({"lang_field": "audio.language"}, "coalesce(t.language = (SELECT arg_min(u.language, u.stream_index) FROM tracks u WHERE u.file_id = t.file_id AND u.track_type LIKE 'audio%'), false)"),
    "p04_codec_in": ({"codec": ["aac", "hevc"]}, "t.codec IN ('aac', 'hevc')"),
    "p05_codec_not": ({"codec_not": "aac"}, "t.codec <> 'aac'"),
    "p06_codec_field": ({"codec_field": "video.codec", "equal": False}, "coalesce(t.codec <> (SELECT arg_min(u.codec, u.stream_index) FROM tracks u WHERE u.file_id = t.file_id AND u.track_type = 'video'), false)"),
    "p07_channels": ({"channels": [">=", 6]}, "coalesce(t.channels >= 6, false)"),
    "p08_commentary": ({"commentary": 1}, "t.track_type IN ('audio_commentary', 'subtitle_commentary')"),
    "p09_forced_or_default": ({"any": [{"forced": 1}, {"default": 1}]}, "t.is_forced OR t.is_default"),
    "p10_font": ({"font": 1}, "t.track_type = 'attachment' AND (contains(t.codec, 'ttf') OR regexp_matches(lower(t.title), '\\.(ttf|otf|woff)$'))"),
    "p11_title_contains": ({"title_contains": "COMMENT"}, "contains(lower(t.title), 'comment')"),
    "p12_title_matches": ({"title_matches": "^Track [0-3]$"}, "regexp_matches(t.title, '^Track [0-3]$')"),
    "p13_two_valued": ({"all": [{"not": {"channels": ["<", 6]}}, {"any": [{"lang": ["eng"]}, {"not": {"default": 1}}]}]}, "NOT coalesce(t.channels < 6, false) AND (t.language = 'eng' OR NOT t.is_default)"),
    "p14_title_patterns": ({"title_any": ["director", "font"]}, "contains(lower(t.title), 'director') OR contains(lower(t.title), 'font')"),
}
for _name, (_spec, _sql) in FILTERS.items():

    @query(_name, f"SELECT t.file_id AS id, t.stream_index FROM tracks t WHERE {_sql}")
    def _filter(spark, d, spec=_spec):
        return L.with_tracks(spark, d).select("id", F.explode(P.selected("any", spec)).alias("t")).select("id", "t.stream_index")


@query("p15_targets", "SELECT file_id AS id, count(*) FILTER (track_type = 'video') AS video, count(*) FILTER (track_type LIKE 'audio%') AS audio, count(*) FILTER (track_type LIKE 'subtitle%') AS subtitle, count(*) FILTER (track_type = 'attachment') AS attachment, count(*) AS any FROM tracks GROUP BY 1")
def targets(spark, d):
    return L.with_tracks(spark, d).where("size(tracks) > 0").select("id", *(F.size(P.selected(k)).alias(k) for k in ("video", "audio", "subtitle", "attachment", "any")))


def _library(spark, d):
    """Files with tags and plugin metadata."""
    k = F.col("id")
    meta = F.create_map(F.lit("radarr"), F.parse_json(F.concat(F.lit('{"movie":{"year":'), (1990 + k % 30).cast("string"), F.lit("}}"))))
    return L.with_tracks(spark, d).withColumn("tags", F.when(k % 3 == 0, F.create_map(F.lit("title"), F.lit("x"), F.lit("artist"), F.lit("y"))).otherwise(F.create_map(F.lit("genre"), F.lit("z")))).withColumn("plugin_metadata", meta)


_LANGS = "(SELECT count(DISTINCT language) FROM tracks t WHERE t.file_id = f.id AND t.track_type LIKE 'audio%' AND t.language <> 'und')"
_FIRST = "(SELECT arg_min({0}, t.stream_index) FROM tracks t WHERE t.file_id = f.id AND t.track_type LIKE '{1}%')"
CONDITIONS = {
    "c01_exists": ({"exists": "audio", "where": {"lang": ["jpn"]}}, "EXISTS (SELECT 1 FROM tracks t WHERE t.file_id = f.id AND t.track_type LIKE 'audio%' AND t.language = 'jpn')"),
    "c02_count": ({"count": "subtitle", "where": {"forced": 1}, "is": [">=", 2]}, "(SELECT count(*) FROM tracks t WHERE t.file_id = f.id AND t.track_type LIKE 'subtitle%' AND t.is_forced) >= 2"),
    "c03_field_compare": ({"any": [{"field": "video.width", "is": [">", 1920]}, {"field": "file.container", "is": ["!=", 5]}, {"not": {"field": "audio.channels", "is": ["!=", 2]}}]}, f"coalesce({_FIRST.format('t.width', 'video')} > 1920, false) OR NOT coalesce((SELECT u.channels FROM tracks u WHERE u.file_id = f.id AND u.track_type LIKE 'audio%' ORDER BY u.stream_index LIMIT 1) <> 2, false)"),
    "c04_field_in": ({"field": "file.container", "in": ["mkv", "webm"]}, "f.container IN ('mkv', 'webm')"),
    "c05_field_exists": ({"field": "video.hdr_format", "exists": 1}, "(SELECT u.hdr_format FROM tracks u WHERE u.file_id = f.id AND u.track_type = 'video' ORDER BY u.stream_index LIMIT 1) IS NOT NULL"),
    "c06_multi_language": ({"multi_language": 1}, f"{_LANGS} > 1"),
    "c07_dubbed_or_original": ({"any": [{"dubbed": 1}, {"all": [{"original": 1}, {"field": "file.container", "is": ["==", "mp4"]}]}]}, f"({_LANGS} > 1 AND EXISTS (SELECT 1 FROM tracks t WHERE t.file_id = f.id AND t.track_type LIKE 'subtitle%')) OR ({_LANGS} <= 1 AND f.container = 'mp4')"),
    "c08_not_missing": ({"not": {"field": "video.width", "is": ["<", 5000]}}, f"NOT coalesce((SELECT u.width FROM tracks u WHERE u.file_id = f.id AND u.track_type = 'video' ORDER BY u.stream_index LIMIT 1) < 5000, false)"),
    "c09_first_track": ({"field": "audio.codec", "is": ["==", "aac"]}, f"coalesce({_FIRST.format('t.codec', 'audio')} = 'aac', false)"),
    "c10_file_and_tag": ({"all": [{"field": "file.size", "is": [">", 10_000_000]}, {"field": "tag.artist", "is": ["==", "y"]}]}, "f.size > 10000000 AND f.id % 3 = 0"),
    "c11_plugin_path": ({"field": "plugin.radarr.movie.year", "is": ["==", "2000"]}, "1990 + f.id % 30 = 2000"),
}
for _name, (_spec, _sql) in CONDITIONS.items():

    @query(_name, f"SELECT f.id FROM files f WHERE {_sql}")
    def _condition(spark, d, spec=_spec):
        df = _library(spark, d)
        return df.where(P.condition(spec, df)).select("id")


def _rows(df, actions):
    return df.select("id", F.posexplode(actions).alias("pos", "a")).select("id", "pos", "a.op", "a.track", "a.value")


_POS = "row_number() OVER (PARTITION BY id ORDER BY track) - 1"
_T = "FROM files f JOIN tracks t ON t.file_id = f.id"
_WIDE = "CAST(NULL AS VARCHAR) AS value"
OPERATIONS = {
    "o01_container": ({"container": "mkv"}, "SELECT id, 'convert_container' AS op, CAST(NULL AS INTEGER) AS track, 'mkv' AS value FROM files WHERE container <> 'mkv'"),
    "o02_keep": ({"keep": "audio", "where": {"lang": ["eng"]}}, f"SELECT f.id, 'remove_track' AS op, t.stream_index AS track, {_WIDE} {_T} WHERE t.track_type LIKE 'audio%' AND t.language <> 'eng' AND EXISTS (SELECT 1 FROM tracks u WHERE u.file_id = f.id AND u.track_type LIKE 'audio%' AND u.language = 'eng')"),
    "o03_remove": ({"remove": "audio", "where": {"commentary": 1}}, f"SELECT f.id, 'remove_track' AS op, t.stream_index AS track, {_WIDE} {_T} WHERE t.track_type = 'audio_commentary' AND EXISTS (SELECT 1 FROM tracks u WHERE u.file_id = f.id AND u.track_type = 'audio_main')"),
    "o03_remove_all_subtitles": ({"remove": "subtitle"}, f"SELECT f.id, 'remove_track' AS op, t.stream_index AS track, {_WIDE} {_T} WHERE t.track_type LIKE 'subtitle%'"),
    "o04_order": ({"order": ["video", "audio"]}, "SELECT id, 'reorder_tracks' AS op, CAST(NULL AS INTEGER) AS track, 'video,audio' AS value FROM files"),
    "o05_defaults_first_per_language": (
        {"defaults": "first_per_language", "of": "audio"},
        "SELECT id, CASE WHEN rn = 1 THEN 'set_default' ELSE 'clear_default' END AS op, track, 'audio' AS value FROM (SELECT f.id, t.stream_index AS track, t.is_default, row_number() OVER (PARTITION BY f.id, t.language ORDER BY t.stream_index) AS rn FROM files f JOIN tracks t ON t.file_id = f.id WHERE t.track_type LIKE 'audio%') WHERE (rn = 1) <> is_default",
    ),
    "o05_defaults_none": ({"defaults": "none", "of": "subtitle"}, f"SELECT f.id, 'clear_default' AS op, t.stream_index AS track, {_WIDE} {_T} WHERE t.track_type LIKE 'subtitle%' AND t.is_default"),
    "o07_transcode": ({"transcode": "hevc", "of": "video", "preserve": ["av1"], "settings": {"crf": 20}}, f"SELECT f.id, 'transcode_video' AS op, t.stream_index AS track, '{{\"codec\": \"hevc\", \"crf\": 20}}' AS value {_T} WHERE t.track_type = 'video' AND t.codec NOT IN ('hevc', 'av1')"),
    "o08_normalize": ({"normalize": [-23.0, 0.5]}, f"SELECT f.id, 'normalize_audio' AS op, t.stream_index AS track, '-23.0' AS value {_T} WHERE t.track_type LIKE 'audio%' AND (t.lufs IS NULL OR abs(t.lufs + 23) > 0.5)"),
    "o09_synthesize": (
        {"synthesize": "aac", "preset": "stereo", "where": {"channels": [">=", 6]}, "skip_if": {"channels": ["==", 2]}},
        "SELECT f.id, 'synthesize_audio' AS op, min(t.stream_index) AS track, 'aac/2/' || arg_min(t.language, t.stream_index) AS value FROM files f JOIN tracks t ON t.file_id = f.id WHERE t.channels >= 6 AND NOT EXISTS (SELECT 1 FROM tracks u WHERE u.file_id = f.id AND u.channels = 2) GROUP BY f.id",
    ),
    "o10_clear_tags": ({"clear_tags": 1}, "SELECT id, 'delete_tag' AS op, CAST(NULL AS INTEGER) AS track, unnest(CASE WHEN id % 3 = 0 THEN ['artist', 'title'] ELSE ['genre'] END) AS value FROM files"),
    "o11_o16_set_tag_template": ({"set_tag": "name", "value": "{filename}!"}, "SELECT id, 'set_tag' AS op, CAST(NULL AS INTEGER) AS track, 'name=' || id || '!' AS value FROM files"),
    "o11_set_tag_field": ({"set_tag": "w", "field": "video.width"}, "SELECT f.id, CASE WHEN w IS NULL THEN 'fail' ELSE 'set_tag' END AS op, CAST(NULL AS INTEGER) AS track, 'w=' || coalesce(CAST(w AS VARCHAR), '?') AS value FROM (SELECT f.id, max(t.width) FILTER (t.stream_index = 0) AS w FROM files f LEFT JOIN tracks t ON t.file_id = f.id GROUP BY 1) f"),
    "o12_delete_tag": ({"delete_tag": "genre"}, "SELECT id, 'delete_tag' AS op, CAST(NULL AS INTEGER) AS track, 'genre' AS value FROM files WHERE id % 3 <> 0"),
    "o13_when_else": ({"when": {"exists": "attachment"}, "then": [{"warn": "has fonts"}], "else": [{"verify": "quick"}]}, "SELECT f.id, CASE WHEN EXISTS (SELECT 1 FROM tracks t WHERE t.file_id = f.id AND t.track_type = 'attachment') THEN 'warn' ELSE 'verify' END AS op, CAST(NULL AS INTEGER) AS track, CASE WHEN EXISTS (SELECT 1 FROM tracks t WHERE t.file_id = f.id AND t.track_type = 'attachment') THEN 'has fonts' ELSE 'quick' END AS value FROM files f"),
    "o15_set_language": ({"set_language": "eng", "of": "audio", "where": {"lang": ["und"]}}, f"SELECT f.id, 'set_language' AS op, t.stream_index AS track, 'eng' AS value {_T} WHERE t.track_type LIKE 'audio%' AND t.language = 'und'"),
    "o17_verify": ({"verify": "thorough"}, "SELECT id, 'verify' AS op, CAST(NULL AS INTEGER) AS track, 'thorough' AS value FROM files"),
}
for _name, (_spec, _sql) in OPERATIONS.items():
    _order = "value" if _name == "o10_clear_tags" else "track"

    @query(_name, f"SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY {_order}) - 1 AS INTEGER) AS pos, op, track, value FROM ({_sql})")
    def _operation(spark, d, spec=_spec):
        df = _library(spark, d)
        return _rows(df, P.operation(spec, df))


@query(
    "o06_clear_interleaved",
    "SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY track, k) - 1 AS INTEGER) AS pos, op, track, CAST(NULL AS VARCHAR) AS value FROM (SELECT file_id AS id, stream_index AS track, 0 AS k, 'clear_default' AS op FROM tracks WHERE track_type LIKE 'audio%' AND is_default UNION ALL SELECT file_id, stream_index, 1, 'clear_forced' FROM tracks WHERE track_type LIKE 'audio%' AND is_forced)",
)
def clear(spark, d):
    df = _library(spark, d)
    return _rows(df, P.operation({"clear": ["default", "forced"], "of": "audio"}, df))


@query(
    "o14_rules_first",
    """SELECT f.id, CASE WHEN f.container = 'mkv' THEN 'a' WHEN f.size > 20000000 THEN 'not-mkv,b' ELSE 'not-mkv,small' END AS messages FROM files f""",
)
def rules(spark, d):
    df = _library(spark, d)
    spec = {
        "rules": [
            {"when": {"field": "file.container", "is": ["==", "mkv"]}, "then": [{"warn": "a"}], "else": [{"warn": "not-mkv"}]},
            {"when": {"field": "file.size", "is": [">", 20_000_000]}, "then": [{"warn": "b"}], "else": [{"warn": "small"}]},
        ],
        "mode": "first",
    }
    return df.select("id", F.array_join(F.transform(P.operation(spec, df), lambda a: a["value"]), ",").alias("messages"))


POLICY = {
    "phases": [
        {"name": "verify", "depends_on": ["transcode"], "run_if": ["transcode", "modified"], "operations": [{"verify": "quick"}]},
        {"name": "normalize", "skip_when": {"field": "file.container", "is": ["==", "webm"]}, "operations": [{"keep": "audio", "where": {"lang": ["eng", "und"]}}, {"container": "mkv"}]},
        {"name": "transcode", "depends_on": ["normalize"], "on_error": "abort", "operations": [{"transcode": "hevc", "of": "video"}, {"set_tag": "w", "field": "video.width"}, {"verify": "hash"}]},
        {"name": "cleanup", "on_error": "continue", "operations": [{"set_tag": "w", "field": "video.width"}, {"when": {"field": "file.size", "is": ["<", 5_000_000]}, "then": [{"skip": "tiny {filename}"}]}]},
    ]
}


@query(
    "o18_o19_o23_o25_policy",
    """WITH v AS (SELECT f.id, f.container, f.size, max(t.width) FILTER (t.stream_index = 0) AS w, max(t.codec) FILTER (t.track_type = 'video') AS vc, count(*) FILTER (t.track_type LIKE 'audio%' AND t.language NOT IN ('eng', 'und')) AS bad, count(*) FILTER (t.track_type LIKE 'audio%' AND t.language IN ('eng', 'und')) AS good FROM files f LEFT JOIN tracks t ON t.file_id = f.id GROUP BY ALL),
    n AS (SELECT id, CASE WHEN container = 'webm' THEN 0 ELSE (CASE WHEN good > 0 THEN bad ELSE 0 END) + CASE WHEN container <> 'mkv' THEN 1 ELSE 0 END END AS k, container = 'webm' AS sk FROM v),
    x AS (SELECT id, (CASE WHEN coalesce(vc <> 'hevc', false) THEN 1 ELSE 0 END) + (CASE WHEN w IS NULL THEN 0 ELSE 2 END) AS k FROM v)
    SELECT id, 'normalize' AS phase, CASE WHEN sk THEN 'skipped' WHEN k = 0 THEN 'completed' ELSE 'pending' END AS status, CASE WHEN sk THEN 'skip_when' END AS reason, CAST(k AS INTEGER) AS n FROM n
    UNION ALL SELECT id, 'transcode', CASE WHEN k = 0 THEN 'completed' ELSE 'pending' END, NULL, CAST(k AS INTEGER) FROM x
    UNION ALL SELECT id, 'verify', CASE WHEN k = 0 THEN 'skipped' ELSE 'pending' END, CASE WHEN k = 0 THEN 'run_if' END, CAST(CASE WHEN k = 0 THEN 0 ELSE 1 END AS INTEGER) FROM x
    UNION ALL SELECT id, 'cleanup', CASE WHEN size < 5000000 THEN 'skipped' WHEN w IS NULL THEN 'completed' ELSE 'pending' END, CASE WHEN size < 5000000 THEN 'tiny ' || id END, CAST(CASE WHEN w IS NULL THEN 0 ELSE 1 END AS INTEGER) FROM v""",
)
def whole_policy(spark, d):
    out = P.evaluate(_library(spark, d), POLICY)
    return out.select("id", "phase", "status", "reason", F.size("actions").alias("n"))


@query("o20_safeguard_all_removed", "SELECT f.id, count(*) AS removals FROM files f JOIN tracks t ON t.file_id = f.id WHERE t.track_type LIKE 'subtitle%' GROUP BY 1")
def safeguard(spark, d):
    df = _library(spark, d)
    gone = F.flatten(F.array(*(P._each(P.selected(k), "remove_track") for k in ("video", "audio", "subtitle"))))
    left = P.safeguarded(gone)
    return df.select("id", F.size(left).cast("long").alias("removals")).where("removals > 0")


@query("o21_container_safeguard", "SELECT f.id, string_agg(DISTINCT t.codec, ',' ORDER BY t.codec) AS unfit FROM files f JOIN tracks t ON t.file_id = f.id WHERE t.track_type <> 'attachment' AND t.codec NOT IN ('h264', 'hevc', 'av1', 'mpeg2video', 'aac', 'ac3', 'opus', 'flac') GROUP BY 1")
def container_safeguard(spark, d):
    df = _library(spark, d)
    return df.select("id", F.array_join(P.unfit(F.lit("mp4"), P.none()), ",").alias("unfit")).where("unfit <> ''")


_HELD = "codec IN ('h264', 'avc1', 'hevc', 'h265', 'hev1', 'hvc1', 'av1', 'mpeg4', 'mpeg2video', 'vp9', 'aac', 'mp3', 'ac3', 'eac3', 'opus', 'alac', 'flac', 'mov_text', 'tx3g')"


@query(
    "o21_conversion_taken_back",
    f"""
    WITH t AS (SELECT t.*, f.container, f.filename, CASE WHEN track_type LIKE 'audio%' AND codec = 'dts' THEN 'aac' ELSE codec END AS codec2 FROM tracks t JOIN files f ON f.id = t.file_id WHERE track_type NOT LIKE 'subtitle%'),
    b AS (SELECT file_id, list('track ' || stream_index || ' (' || codec2 || ')' ORDER BY stream_index) AS bad FROM t WHERE NOT {_HELD.replace('codec', 'codec2')} GROUP BY 1),
    n AS (SELECT f.id, f.container, f.filename, b.bad, count(t.file_id) FILTER (t.track_type LIKE 'subtitle%') + count(t.file_id) FILTER (t.track_type LIKE 'audio%' AND t.codec NOT IN ('aac', 'opus', 'flac', 'ac3')) AS others
      FROM files f LEFT JOIN b ON b.file_id = f.id LEFT JOIN tracks t ON t.file_id = f.id GROUP BY ALL)
    SELECT id, CAST(others + CASE WHEN container <> 'mp4' AND bad IS NULL THEN 1 ELSE 0 END AS INTEGER) AS n, CASE WHEN container <> 'mp4' AND bad IS NOT NULL THEN 'container_incompatible' END AS kind,
      CASE WHEN container <> 'mp4' AND bad IS NOT NULL THEN 'Safeguard: container conversion from ' || container || ' to mp4 would leave incompatible codecs in ' || filename || ': ' || array_to_string(bad[1:4], ', ')
        || CASE WHEN len(bad) > 4 THEN ' and ' || (len(bad) - 4) || ' more' ELSE '' END || '; keeping original container' END AS warning
    FROM n
    """,
)
def conversion_taken_back(spark, d):
    phases = [{"name": "a", "operations": [{"container": "mp4"}, {"remove": "subtitle"}, {"transcode": "aac", "of": "audio", "preserve": ["opus", "flac", "ac3"]}]}]
    out = P.evaluate(_library(spark, d), {"phases": phases})
    return out.select("id", F.size("actions").alias("n"), F.try_element_at("violations", F.lit(1))["kind"].alias("kind"), F.try_element_at("warnings", F.lit(1)).alias("warning"))


@query(
    "o19_error_strategies",
    """
    WITH v AS (SELECT f.id, f.filename, max(t.width) FILTER (t.stream_index = 0) AS w FROM files f LEFT JOIN tracks t ON t.file_id = f.id GROUP BY ALL),
    s AS (SELECT * FROM (VALUES ('abort', 'aborting'), ('continue', 'continuing'), ('quarantine', 'aborting'), ('skip', 'skipping phase')) AS x(phase, word))
    SELECT id, phase, CASE WHEN w IS NULL AND phase = 'skip' THEN 'skipped' ELSE 'pending' END AS status, CASE WHEN w IS NULL AND phase = 'skip' THEN 'Error (skipping phase): w=?' END AS reason,
      CAST(CASE WHEN w IS NULL AND phase <> 'continue' THEN 1 WHEN w IS NULL THEN 2 ELSE 3 END AS INTEGER) AS n,
      CASE WHEN w IS NULL AND phase <> 'skip' THEN ['check ' || id, 'Error (' || word || '): w=?'] ELSE ['check ' || id] END AS warnings
    FROM v, s
    """,
)
def error_strategies(spark, d):
    operations = [{"warn": "check {filename}"}, {"verify": "quick"}, {"set_tag": "w", "field": "video.width"}, {"verify": "hash"}]
    out = P.evaluate(_library(spark, d), {"phases": [{"name": n, "on_error": n, "operations": operations} for n in P.STRATEGIES]})
    return out.select("id", "phase", "status", "reason", F.size("actions").alias("n"), "warnings")


@query("c12_system_fields", "SELECT id FROM files WHERE id % 2 = 0")
def system_fields(spark, d):
    df = _library(spark, d).withColumn("system", F.when(F.col("id") % 2 == 0, F.create_map(F.lit("hwaccel"), F.lit("nvenc"))).otherwise(F.create_map(F.lit("cpu"), F.lit("x"))))
    return df.where(P.condition({"field": "system.hwaccel", "is": ["==", "nvenc"]}, df)).select("id")


@query("c13_o24_phase_fields", "SELECT id, 'a' AS phase, CASE WHEN container = 'mkv' THEN 'completed' ELSE 'pending' END AS status FROM files UNION ALL SELECT id, 'b', CASE WHEN container = 'mkv' THEN 'skipped' ELSE 'pending' END FROM files")
def phase_fields(spark, d):
    phases = [{"name": "a", "operations": [{"container": "mkv"}]}, {"name": "b", "skip_when": {"not": {"field": "phase.a.modified", "is": ["==", True]}}, "operations": [{"verify": "quick"}]}]
    return P.evaluate(_library(spark, d), {"phases": phases}).select("id", "phase", "status")


@query("o22_capability_hints", "SELECT f.id, CASE f.id % 2 WHEN 0 THEN 'only ffmpeg encodes hevc' ELSE 'no encoder for vp9' END AS hint FROM files f WHERE EXISTS (SELECT 1 FROM tracks t WHERE t.file_id = f.id AND t.track_type = 'video' AND t.codec <> CASE f.id % 2 WHEN 0 THEN 'hevc' ELSE 'vp9' END)")
def hints(spark, d):
    df = _library(spark, d)
    even, odd = ({"transcode": c, "of": "video"} for c in ("hevc", "vp9"))
    actions = F.when(F.col("id") % 2 == 0, P.operation(even, df)).otherwise(P.operation(odd, df))
    return df.select("id", F.explode(P.capability_hints(actions, {"hevc": ["ffmpeg"], "h264": ["ffmpeg", "handbrake"]})).alias("hint"))


@query("o25_orchestration", "SELECT id, CASE WHEN container = 'webm' THEN 'skipped' ELSE 'pending' END AS last, container <> 'webm' AS modified FROM files")
def orchestration(spark, d):
    phases = [{"name": "a", "skip_when": {"field": "file.container", "is": ["==", "webm"]}, "operations": [{"verify": "quick"}]}]
    out = P.evaluate(_library(spark, d), {"phases": phases})
    return out.groupBy("id").agg(F.max("status").alias("last"), F.bool_or(F.col("status") == "pending").alias("modified"))


@query("o26_dry_run_text", "SELECT f.id, f.id || ': ' || count(t.file_id) || ' to remove' AS text FROM files f LEFT JOIN tracks t ON t.file_id = f.id AND t.track_type LIKE 'subtitle%' GROUP BY f.id")
def dry_run(spark, d):
    df = _library(spark, d)
    return df.select("id", F.concat(F.col("id").cast("string"), F.lit(": "), F.size(P.operation({"remove": "subtitle"}, df)).cast("string"), F.lit(" to remove")).alias("text"))


@query("l09_policy_by_longest_root", "SELECT id, CASE WHEN path LIKE '/media/1-URGENT/%' THEN NULL WHEN path LIKE '/media/%' THEN 'standard' ELSE 'fallback' END AS policy FROM files")
def resolve(spark, d):
    return L.files(spark, d).select("id", P.policy_for(F.col("path"), {"/media": "standard", "/media/1-URGENT": None, "/med": "wrong"}, "fallback").alias("policy"))


@query(
    "o07_missing_hardware",
    """
    SELECT f.id, CASE WHEN f.id % 2 = 1 THEN 'hw backend ''nvenc'' unavailable and hw_fallback is false' END AS reason, CASE WHEN f.id % 2 = 1 THEN 'skipped' ELSE 'pending' END AS status,
      CAST(CASE WHEN f.id % 2 = 1 THEN 1 ELSE 2 + count(t.file_id) FILTER (t.track_type = 'video' AND t.codec <> 'hevc') END AS INTEGER) AS n
    FROM files f LEFT JOIN tracks t ON t.file_id = f.id GROUP BY f.id
    """,
)
def missing_hardware(spark, d):
    df = _library(spark, d).withColumn("system", F.create_map(F.lit("hwaccels"), F.when(F.col("id") % 2 == 0, "qsv,nvenc").otherwise("qsv")))
    phases = [{"name": "a", "operations": [{"verify": "quick"}, {"transcode": "hevc", "of": "video", "hw": "nvenc", "hw_fallback": False}, {"verify": "hash"}]}]
    return P.evaluate(df, {"phases": phases}).select("id", "reason", "status", F.size("actions").alias("n"))


_OFF = "(t.lufs IS NULL OR abs(t.lufs + 24) > 0.5)"


@query(
    "o08_normalize_preset_keeps_first",
    f"""
    WITH t AS (SELECT * FROM tracks t WHERE track_type LIKE 'audio%'), k AS (SELECT file_id FROM t WHERE language = 'eng' GROUP BY 1)
    SELECT file_id AS id, 'remove_track' AS op, stream_index AS track, NULL AS codec, NULL AS target FROM t WHERE language <> 'eng' AND file_id IN (FROM k)
    UNION ALL SELECT file_id, 'transcode_audio', stream_index, codec, '-24.0' FROM t WHERE language = 'eng' AND {_OFF}
    """,
)
def normalize_preset(spark, d):
    df = _library(spark, d)
    actions = P.operation({"normalize": {"preset": "streaming_movies"}, "where": {"lang": ["eng"]}}, df)
    out = _rows(df, actions)
    return out.select("id", "op", "track", F.get_json_object("value", "$.codec").alias("codec"), F.get_json_object("value", "$.loudness.target_lufs").alias("target"))


@query(
    "o22_capabilities_of_plans",
    """
    WITH v AS (SELECT f.id, f.container, coalesce(bool_or(t.track_type = 'video' AND t.codec <> 'hevc'), false) AS v, coalesce(bool_or(t.track_type LIKE 'audio%' AND t.codec <> 'opus'), false) AS a,
        count(*) FILTER (t.track_type LIKE 'audio%' AND t.codec <> 'opus') AS n FROM files f LEFT JOIN tracks t ON t.file_id = f.id GROUP BY ALL)
    SELECT id, CASE WHEN id % 2 = 0 THEN n ELSE 0 END + CASE WHEN container <> 'wmv' THEN 1 ELSE 0 END AS n_warnings,
      CASE WHEN id % 2 = 0 AND a THEN NULL WHEN id % 2 = 1 AND a THEN 'ffmpeg' WHEN v THEN NULL END AS executor FROM v
    """,
)
def capabilities_of_plans(spark, d):
    df = _library(spark, d)
    actions = P.sequence([{"transcode": "hevc", "of": "video"}, {"transcode": "opus", "of": "audio"}, {"container": "wmv"}], df)
    hevc = ["ffmpeg", "handbrake"]
    known = F.when(F.col("id") % 2 == 0, P.capabilities(actions, {"hevc": hevc}, ["matroska"])).otherwise(P.capabilities(actions, {"hevc": hevc, "opus": ["ffmpeg"]}, ["matroska"]))
    return df.select("id", known.alias("c")).select("id", F.size("c.warnings").cast("long").alias("n_warnings"), "c.executor")


@query(
    "c10_c14_tags_and_numbers",
    """
    SELECT f.id, 'genre=' || CASE WHEN f.id % 3 = 0 THEN '?' ELSE 'z' END AS genre, 'd=' || CASE WHEN duration = floor(duration) THEN CAST(CAST(duration AS BIGINT) AS VARCHAR) || '.0' ELSE CAST(duration AS VARCHAR) END AS duration,
      'v=' || coalesce(CASE WHEN f.id % 2 = 0 THEN 'x' END, '?') AS system
    FROM files f
    """,
)
def tags_and_numbers(spark, d):
    df = _library(spark, d).withColumn("system", F.create_map(F.lit("hwaccel"), F.when(F.col("id") % 2 == 0, "x")))
    made = lambda name, path: P.operation({"set_tag": name, "field": path}, df)[0]["value"]
    return df.select("id", made("genre", "file.genre").alias("genre"), made("d", "file.duration").alias("duration"), made("v", "system.hwaccel").alias("system"))


@query(
    "c13_phase_counts",
    """
    WITH v AS (SELECT f.id, f.container, max(t.width) FILTER (t.stream_index = 0) AS w, bool_or(t.codec = 'ttf') AS ttf FROM files f LEFT JOIN tracks t ON t.file_id = f.id GROUP BY ALL)
    SELECT id, CASE WHEN w IS NULL THEN 'pending' ELSE 'skipped' END AS warned, CASE WHEN container <> 'webm' AND coalesce(ttf, false) THEN 'pending' ELSE 'skipped' END AS failed FROM v
    """,
)
def phase_counts(spark, d):
    df = _library(spark, d)
    only = df.withColumn("tracks", F.filter("tracks", lambda t: (t["codec"] == "ttf") | (t["stream_index"] == 0))).withColumn("tracks", F.transform("tracks", lambda t: t.withField("codec", F.when(t["codec"] == "ttf", "ttf").otherwise("vp9"))))
    phases = [
        {"name": "a", "on_error": "continue", "operations": [{"set_tag": "w", "field": "video.width"}]}, {"name": "b", "operations": [{"container": "webm"}]},
        {"name": "warned", "skip_when": {"field": "phase.a.warning_count", "is": ["==", 0]}, "operations": [{"verify": "quick"}]}, {"name": "failed", "skip_when": {"not": {"field": "phase.b.error_count", "is": [">", 0]}}, "operations": [{"verify": "quick"}]},
    ]
    out = P.evaluate(only, {"phases": phases}).groupBy("id")
    return out.agg(*(F.max(F.when(F.col("phase") == p, F.col("status"))).alias(p) for p in ("warned", "failed")))


#: Settings of rules by the remainder of their file's id, with what is wrong with each (found by hand).
SETTINGS = [
    ("video", "hevc", '{"crf": 20, "preset": "slow", "hw": "auto", "hw_fallback": true, "target_vmaf": 95, "min_bitrate": "500k", "max_bitrate": "8M"}', []),
    ("video", "aac", '{"crf": 20}', [("error", "codec", 'codec "aac" is an audio codec but target is video')]),
    ("audio", "h264", '{"bitrate": "192k", "crop": "auto"}', [("error", "codec", 'codec "h264" is a video codec but target is audio'), ("error", "crop", "crop is only valid for video transcodes, not audio")]),
    ("video", "av1", '{"hw_fallback": true, "speed": 4}', [("error", "hw_fallback", "hw_fallback has no effect without hw"), ("error", "speed", 'unknown transcode setting "speed"')]),
    ("video", "av1", '{"hw": "cuda"}', [("error", "hw", 'invalid hw "cuda", expected one of: auto, nvenc, qsv, vaapi, videotoolbox, none')]),
    ("video", "av1", '{"max_resolution": 1080, "preserve_hdr": "yes"}', [("error", "max_resolution", 'invalid max_resolution "1080", expected one of: 480p, 720p, 1080p, 1440p, 2160p, 4k, 8k'), ("error", "preserve_hdr", "preserve_hdr must be true or false")]),
    ("video", "av1", '{"crop_threshold": 300, "crop_sample_count": 0}', [
        ("error", "crop_threshold", "crop_threshold has no effect without crop: auto"), ("error", "crop_threshold", "crop_threshold must be from 0 to 255"),
        ("error", "crop_sample_count", "crop_sample_count has no effect without crop: auto"), ("error", "crop_sample_count", "crop_sample_count must be greater than 0")]),
    ("video", "av1", '{"crop": "auto", "crop_minimum": "x", "crop_aspect_lock": ["16/9", "4/0", 3]}', [
        ("error", "crop_minimum", "crop_minimum must be an integer"), ("error", "crop_aspect_lock", 'invalid crop_aspect_lock ratio "4/0", expected WIDTH/HEIGHT'), ("error", "crop_aspect_lock", 'invalid crop_aspect_lock ratio "3", expected WIDTH/HEIGHT')]),
    ("video", "av1", '{"target_vmaf": 59, "target_vmaf_when content.anime": 70, "target_vmaf_when genre": "x"}', [
        ("error", "target_vmaf", "target_vmaf must be from 60 to 100"), ("warning", "target_vmaf_when content.anime", "target_vmaf_when value 70 is outside the typical 80-99 range"),
        ("error", "target_vmaf_when genre", "target_vmaf_when requires a content.<type> path"), ("error", "target_vmaf_when genre", "target_vmaf_when must be an integer from 60 to 100")]),
    ("video", "av1", '{"min_bitrate": "2M", "max_bitrate": "1999k"}', [("error", "min_bitrate", "min_bitrate must be less than or equal to max_bitrate")]),
    ("video", "av1", '{"min_bitrate": "2 M", "max_bitrate": "99999999999999999999G"}', [("error", "min_bitrate", 'min_bitrate has invalid bitrate "2 M"'), ("error", "max_bitrate", 'max_bitrate has invalid bitrate "99999999999999999999G"')]),
    ("video", "av1", '{"sample_strategy": {"scenes": {"count": "a"}}, "fallback": {"crf": 60}}', [
        ("error", "sample_strategy", "scenes sample_strategy requires integer count"), ("error", "sample_strategy", "scenes sample_strategy requires duration"), ("error", "fallback", "fallback.crf must be from 0 to 51"), ("error", "fallback", "fallback requires preset")]),
    ("video", "av1", '{"sample_strategy": "some", "fallback": 5}', [("error", "sample_strategy", "sample_strategy must be full, scenes(count, duration) or uniform(count, duration)"), ("error", "fallback", "fallback must be a nested block")]),
    ("video", "av1", '{"sample_strategy": {"uniform": {"count": 3, "duration": "10s"}}, "fallback": {"crf": 20, "preset": "slow"}, "crop": "auto", "crop_aspect_lock": ["16/9"]}', []),
    ("video", "unheard", '{"crop": "manual"}', [("error", "crop", "crop must be auto")]),
    ("audio", "opus", '[1]', [("error", "", "settings are no JSON object")]),
    ("video", "av1", '{"' + "k" * 65 + '": 1}', [("error", "k" * 65, 'transcode setting key too long: "' + "k" * 65 + '"')]),
]
_EXPECTED = ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in (k, *p)) + ")" for k, (*_, problems) in enumerate(SETTINGS) for p in problems)


@query("l12_settings_problems", f"SELECT f.id AS rule, level, key, problem FROM files f JOIN (VALUES {_EXPECTED}) AS e(kind, level, key, problem) ON f.id % {len(SETTINGS)} = e.kind")
def settings_problems(spark, d):
    k = F.col("id")
    pick = lambda i: L.pick([s[i] for s in SETTINGS], k)
    return S.settings_problems(L.files(spark, d).select(k.alias("rule"), pick(0).alias("target"), pick(1).alias("codec"), pick(2).alias("settings")))
