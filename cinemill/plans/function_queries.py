"""Registered queries of the scalar functions, probe parsing and catalogue look-ups."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinemill.functions import media as M
from cinemill.plans.registry import query
from cinemill.sources import library as L

_ALIASES = ("AVC1", "x265", "av01", "m2v", "vc-1", "mp4a", "A_AC3", "mlp", "dts-hd", "pcm_s24le", "srt", "s_hdmv/pgs", "vobsub", "theora")
_ALIAS_SQL = L._case(_ALIASES, "o_orderkey")
_canon = {a: next((k for g in M.CODECS.values() for k, v in g.items() if a.lower() in v.split()), a) for a in _ALIASES}
_kind = {a: next((kind for kind, g in M.CODECS.items() if any(a.lower() in v.split() for v in g.values())), None) for a in _ALIASES}
_map = lambda d, x: "CASE " + x + " " + " ".join(f"WHEN '{k}' THEN {'NULL' if v is None else repr(v)}" for k, v in d.items()) + " END"


@query("x01_x02_canonical_codec", f"SELECT id, {_map(_canon, 'a')} AS codec, {_map(_kind, 'a')} AS kind FROM (SELECT o_orderkey AS id, {_ALIAS_SQL} AS a FROM orders)")
def codecs(spark, d):
    a = L.pick(_ALIASES, F.col("o_orderkey"))
    return L.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), M.canonical_codec(a).alias("codec"), M.codec_kind(a).alias("kind"))


@query("x03_languages", "SELECT doc_id, CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fre' WHEN 'de' THEN 'ger' WHEN 'es' THEN 'spa' END AS code, length(lang) = 3 AS three FROM documents")
def languages(spark, d):
    return L.read(spark, d, "documents").select("doc_id", M.canonical_language(F.col("lang")).alias("code"), (F.length("lang") == 3).alias("three"))


@query("x04_l03_suggestion", "SELECT w, arg_min(c, (levenshtein(w, c), c)) AS suggestion FROM (SELECT DISTINCT codec AS w FROM tracks) a, (SELECT unnest(['h264', 'hevc', 'aac', 'opus', 'subrip', 'mpeg4', 'ttf']) AS c) b GROUP BY 1")
def suggestion(spark, d):
    words = L.tracks(spark, d).select(F.col("codec").alias("w")).distinct()
    best = F.array_min(F.array(*(F.struct(F.levenshtein(F.col("w"), F.lit(c)).alias("d"), F.lit(c).alias("c")) for c in ("h264", "hevc", "aac", "opus", "subrip", "mpeg4", "ttf"))))
    return words.select("w", best["c"].alias("suggestion"))


@query(
    "x05_formats",
    """SELECT id, CASE WHEN size >= 1073741824 THEN format('{:.2f} GiB', size / 1073741824.0::DOUBLE) WHEN size >= 1048576 THEN format('{:.1f} MiB', size / 1048576.0::DOUBLE) WHEN size >= 1024 THEN format('{:.0f} KiB', size / 1024.0::DOUBLE) ELSE size || ' B' END AS size_text,
    CASE WHEN t >= 3600 THEN format('{}h {:02d}m {:02d}s', t // 3600, t % 3600 // 60, t % 60) WHEN t >= 60 THEN format('{}m {:02d}s', t // 60, t % 60) ELSE t || 's' END AS time_text FROM (SELECT id, size * 128 AS size, CAST(round(duration) AS BIGINT) AS t FROM files)""",
)
def formats(spark, d):
    return L.files(spark, d).select("id", M.format_size(F.col("size") * 128).alias("size_text"), M.format_duration(F.col("duration")).alias("time_text"))


@query("x06_x25_names", "SELECT id, regexp_extract(path, '([^/]+)$', 1) AS base, regexp_extract(path, '([^/]+)\\.[^.]+$', 1) AS stem, lower(regexp_extract(path, '\\.([^.]+)$', 1)) AS ext, trim(regexp_replace(replace(path, '-', '  '), '\\s+', ' ', 'g')) AS title FROM files")
def names(spark, d):
    p = F.col("path")
    return L.files(spark, d).select("id", M.basename(p).alias("base"), M.stem(p).alias("stem"), M.extension(p).alias("ext"), M.normal_title(F.replace(p, F.lit("-"), F.lit("  "))).alias("title"))


@query("s03_media_extension", "SELECT id, container IN ('mkv', 'mp4', 'avi') AS is_media FROM files")
def is_media(spark, d):
    return L.files(spark, d).select("id", M.extension(F.upper("path")).isin("mkv", "mp4", "avi").alias("is_media"))


@query("x08_frame_rate_fraction", "SELECT event_id, CASE WHEN d <> 0 THEN n::DOUBLE / d END AS rate, coalesce(d <> 0 AND abs(n::DOUBLE / d - 24) / 24 > 0.01, false) AS vfr FROM (SELECT event_id, event_id % 60 * 1000 AS n, event_id % 4 * 250 AS d FROM events)")
def fractions(spark, d):
    e = F.col("event_id")
    text = F.concat((e % 60 * 1000).cast("string"), F.lit("/"), (e % 4 * 250).cast("string"))
    return L.read(spark, d, "events").select("event_id", M.fraction(text).alias("rate"), M.variable_rate(text, F.lit("24/1")).alias("vfr"))


@query("x09_x11_probe_types", "SELECT file_id, stream_index, CASE WHEN contains(lower(title), 'comment') THEN 'audio_commentary' WHEN is_default THEN 'audio_main' ELSE 'audio_alternate' END AS type, CASE stream_index % 3 WHEN 0 THEN 'HDR10' WHEN 1 THEN 'HLG' ELSE CASE WHEN is_forced THEN 'Dolby Vision' END END AS hdr FROM tracks")
def probe_types(spark, d):
    i = F.col("stream_index")
    side = F.when((i % 3 == 2) & F.col("is_forced"), F.array(F.lit("DOVI configuration record"))).otherwise(F.array().cast("array<string>"))
    transfer = F.when(i % 3 == 0, "smpte2084").when(i % 3 == 1, "arib-std-b67").otherwise("bt709")
    return L.tracks(spark, d).select("file_id", "stream_index", M.audio_type(F.col("title"), F.col("is_default"), F.lit(False)).alias("type"), M.hdr_format(transfer, F.lit("bt2020"), side).alias("hdr"))


@query("x14_rounding", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_discount * 100) / 100 AS r2, round(l_tax * 10000) / 10000 AS r4, l_partkey FROM lineitem")
def rounding(spark, d):
    from cinemill.operators.history import round2, round4

    return L.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", round2(F.col("l_extendedprice") * F.col("l_discount")).alias("r2"), round4(F.col("l_tax")).alias("r4"), "l_partkey")


@query("x15_x16_space_and_safeguards", "SELECT id, size * CASE WHEN container <> 'mkv' THEN 2 ELSE 1 END + id % 1000 + 52428800 AS need, size * 2 > 20000000 AS grew, CASE WHEN duration <= 0 OR duration * 0.5 >= duration THEN 0.0 ELSE (duration - duration * 0.5) / duration * 100 END AS shrunk FROM files")
def space(spark, d):
    return L.files(spark, d).select(
        "id", M.required_space(F.col("size"), F.col("container") != "mkv", F.col("id") % 1000).alias("need"), (F.col("size") * 2 > 20_000_000).alias("grew"), M.shrunk_percent(F.col("duration"), F.col("duration") * 0.5).alias("shrunk")
    )


_EPS = ("/tv/My.Show.S01E02.mkv", "/tv/Other Show - 3x07 - Title.mkv", "/tv/Third Show/Season 2/Episode 5.mp4", "/tv/movie.mkv", "/tv/A_B.s10e101.720p.avi")


@query(
    "x17_episode_names",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'My Show' WHEN 1 THEN 'Other Show' WHEN 2 THEN 'Third Show' WHEN 4 THEN 'A B' END AS series, CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 4 THEN 10 END AS season, CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 7 WHEN 2 THEN 5 WHEN 4 THEN 101 END AS episode FROM events""",
)
def episodes(spark, d):
    return L.read(spark, d, "events").select("event_id", M.episode(L.pick(_EPS, F.col("event_id"))).alias("e")).select("event_id", "e.series", "e.season", "e.episode")


@query("x18_b10_scrubbed_errors", "SELECT id, trim(regexp_replace(regexp_replace(error_message, '/[^\\s'':\"]+', '<path>', 'g'), '[0-9]+', '<n>', 'g')) AS scrubbed FROM transitions WHERE outcome = 'failure'")
def signatures(spark, d):
    m = F.col("error_message")
    return L.transitions(spark, d).where("outcome = 'failure'").select("id", M.scrubbed(m).alias("scrubbed"))


@query("x19_hour_bucket", "SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1")
def hours(spark, d):
    return L.events(spark, d).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query("x21_x22_tiers", "SELECT file_id, CASE WHEN h IS NULL THEN NULL WHEN h >= 2160 THEN '4K+' WHEN h >= 1080 THEN '1080p' WHEN h >= 720 THEN '720p' WHEN h >= 480 THEN 'SD' ELSE 'sub-SD' END AS tier, CASE WHEN h >= 2160 OR width >= 3840 THEN '4k' ELSE 'default' END AS model FROM (SELECT file_id, width, width * 9 // 16 AS h FROM tracks)")
def tiers(spark, d):
    w = F.col("width")
    h = F.floor(w * 9 / 16)
    return L.tracks(spark, d).select("file_id", M.resolution_tier(w, h).alias("tier"), M.vmaf_model(w, h).alias("model"))


@query("x21_layout_names", "SELECT channels, CASE channels WHEN 2 THEN 'stereo' WHEN 6 THEN '5.1' WHEN 8 THEN '7.1' END AS name, count(*) AS n FROM tracks WHERE channels IS NOT NULL GROUP BY 1")
def layouts(spark, d):
    return L.tracks(spark, d).where("channels is not null").groupBy("channels").agg(M.layout_name(F.first("channels")).alias("name"), F.count(F.lit(1)).alias("n"))


@query("x23_sample_times", "SELECT id, list_transform(range(4), lambda i: floor((i + 0.5::DOUBLE) * ((duration - 10) / 4) * 1000) / 1000) AS times FROM files WHERE duration > 10 UNION ALL SELECT id, [0.0::DOUBLE] FROM files WHERE duration <= 10")
def sample_times(spark, d):
    return L.files(spark, d).select("id", M.sample_times(F.col("duration"), 4, 10).alias("times"))


@query("x24_subtitle_blocks", "SELECT conv_id, string_agg((turn + 1) || ' ' || format('{:02d}:{:02d}:{:02d},{:03d}', turn * 61500 // 3600000, turn * 61500 % 3600000 // 60000, turn * 61500 % 60000 // 1000, turn * 61500 % 1000) || ' ' || length(text), ';' ORDER BY turn) AS blocks FROM conversations GROUP BY 1")
def subtitles(spark, d):
    line = F.concat((F.col("turn") + 1).cast("string"), F.lit(" "), M.subtitle_time(F.col("turn") * 61500), F.lit(" "), F.length("text").cast("string"))
    rows = L.read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("x"))
    return rows.select("conv_id", F.array_join(F.transform("x", lambda r: r["line"]), ";").alias("blocks"))


@query("x26_container_holds", "SELECT f.container, t.codec, CASE WHEN f.container = 'mkv' THEN true WHEN f.container = 'mp4' THEN t.codec IN ('h264', 'hevc', 'av1', 'mpeg2video', 'aac', 'ac3', 'opus', 'flac') WHEN f.container = 'webm' THEN t.codec IN ('av1', 'opus') WHEN f.container = 'avi' THEN t.codec IN ('mpeg2video', 'mjpeg', 'h264', 'ac3', 'aac') END AS ok, count(*) AS n FROM files f JOIN tracks t ON t.file_id = f.id GROUP BY ALL")
def container_holds(spark, d):
    df = L.tracks(spark, d).join(L.files(spark, d).select(F.col("id").alias("file_id"), "container"), "file_id")
    return df.groupBy("container", "codec").agg(F.count(F.lit(1)).alias("n")).select("container", "codec", M.holds(F.col("container"), F.col("codec")).alias("ok"), "n")


@query("x27_size_suffix", "SELECT event_id, (event_id % 50) * CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 1000000 END AS bits FROM events")
def suffix(spark, d):
    e = F.col("event_id")
    text = F.concat((e % 50).cast("string"), L.pick(("", "k", "M"), e))
    unit = F.lower(F.regexp_extract(text, r"([kKmM]?)$", 1))
    return L.read(spark, d, "events").select("event_id", (F.regexp_extract(text, r"^(\d+)", 1).cast("long") * F.when(unit == "k", 1000).when(unit == "m", 1_000_000).otherwise(1)).alias("bits"))


@query("x30_timeouts", "SELECT id, CAST(greatest(60, ceil(duration * 2)) AS BIGINT) AS timeout_s FROM files")
def timeouts(spark, d):
    return L.files(spark, d).select("id", F.greatest(F.lit(60), F.ceil(F.col("duration") * 2)).cast("long").alias("timeout_s"))


@query("f24_since", "SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '1998-08-01' - INTERVAL 30 DAY")
def since(spark, d):
    at = M.since("30d", dt.datetime(1998, 8, 1))
    return L.events(spark, d).where(F.col("ts") >= F.lit(at).cast("timestamp_ntz")).agg(F.count(F.lit(1)).alias("n"))


@query("f26_redaction", "SELECT id, 'see <file> token=<redacted> mail <email>' AS text FROM files")
def redaction(spark, d):
    text = F.concat(F.lit("see "), F.col("filename"), F.lit(" token=abc"), F.col("id").cast("string"), F.lit(" mail a.b@"), F.col("container"), F.lit(".org"))
    return L.files(spark, d).select("id", M.redacted(text).alias("text"))


@query("s06_s18_probe_json", "SELECT event_id, 'h' || (event_id % 3) AS video_codec, 2 AS n_streams, (event_id % 100)::DOUBLE AS duration FROM events")
def probe(spark, d):
    e = F.col("event_id")
    text = F.format_string('{"format":{"duration":"%d"},"streams":[{"codec_type":"video","codec_name":"h%d"},{"codec_type":"audio","codec_name":"aac","tags":{"language":"eng"}}]}', e % 100, e % 3)
    schema = "format struct<duration:string>, streams array<struct<codec_type:string, codec_name:string, tags:map<string,string>>>"
    p = L.read(spark, d, "events").select("event_id", F.from_json(text, schema).alias("p"))
    video = F.try_element_at(F.filter("p.streams", lambda s: s["codec_type"] == "video"), F.lit(1))
    return p.select("event_id", video["codec_name"].alias("video_codec"), F.size("p.streams").alias("n_streams"), F.col("p.format.duration").cast("double").alias("duration"))


@query("s05_hash_reuse", "SELECT id, CASE WHEN id % 4 <> 0 AND id % 5 <> 0 THEN content_hash END AS reused FROM files")
def hash_reuse(spark, d):
    now = L.files(spark, d).select("id", "path", F.when(F.col("id") % 4 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(F.col("id") % 5 == 0, 20).otherwise(5).alias("mtime"))
    kept = L.files(spark, d).select("path", F.col("size").alias("known_size"), "content_hash", F.lit(10).alias("last_seen"))
    same = (F.col("size") == F.col("known_size")) & (F.col("mtime") <= F.col("last_seen"))
    return now.join(kept, "path", "left").select("id", F.when(same, F.col("content_hash")).alias("reused"))


@query("roots_by_equality", "SELECT f.id, max(c.n_name) AS name FROM files f LEFT JOIN (SELECT '/media/' || substr(o_orderpriority, 1, 2) AS root, min(o_orderpriority) AS n_name FROM orders GROUP BY 1) c ON starts_with(f.path, c.root) GROUP BY 1")
def prefix_lookup(spark, d):
    roots = L.read(spark, d, "orders").groupBy(F.concat(F.lit("/media/"), F.substring("o_orderpriority", 1, 2)).alias("root")).agg(F.min("o_orderpriority").alias("name"))
    # roots of one length: the raw prefix is an equality on the path's first characters
    return L.files(spark, d).withColumn("root", F.substring("path", 1, 9)).join(roots, "root", "left").select("id", "name")


@query("j13_best_match", "WITH c AS (SELECT p_partkey, p_name, p_size FROM part), q AS (SELECT DISTINCT p_brand AS brand, min(p_name) OVER (PARTITION BY p_brand) AS name, min(p_size) OVER (PARTITION BY p_brand) AS yr FROM part), m AS (SELECT q.brand, c.p_partkey, row_number() OVER (PARTITION BY q.brand ORDER BY CASE WHEN c.p_name = q.name AND c.p_size = q.yr THEN 0 WHEN c.p_name = q.name THEN 1 ELSE 2 END, c.p_partkey) AS rn FROM q JOIN part c ON c.p_brand = q.brand) SELECT brand, p_partkey FROM m WHERE rn = 1")
def best_match(spark, d):
    part = L.read(spark, d, "part")
    wanted = part.groupBy("p_brand").agg(F.min("p_name").alias("name"), F.min("p_size").alias("yr"))
    rank = F.when((F.col("p_name") == F.col("name")) & (F.col("p_size") == F.col("yr")), 0).when(F.col("p_name") == F.col("name"), 1).otherwise(2)
    best = part.join(wanted, "p_brand").groupBy("p_brand").agg(F.min_by("p_partkey", F.struct(rank, "p_partkey")).alias("p_partkey"))
    return best.select(F.col("p_brand").alias("brand"), "p_partkey")


@query("j16_detected_languages", "SELECT f.id, string_agg(CASE WHEN t.stream_index = f.id % 3 THEN 'fre' ELSE t.language END, ',' ORDER BY t.stream_index) AS languages FROM files f JOIN tracks t ON t.file_id = f.id GROUP BY 1")
def detected(spark, d):
    df = L.with_tracks(spark, d).where("size(tracks) > 0").withColumn("found", F.create_map((F.col("id") % 3).cast("int"), F.lit("fr")))
    langs = F.transform("tracks", lambda t: F.coalesce(M.canonical_language(F.try_element_at(F.col("found"), t["stream_index"])), t["language"]))
    return df.select("id", F.array_join(langs, ",").alias("languages"))


@query("t27_metadata_merge", "SELECT id, 'a=old;b=new' || (id % 3) AS merged FROM files")
def merge(spark, d):
    old = F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("old"))
    new = F.create_map(F.lit("b"), F.concat(F.lit("new"), (F.col("id") % 3).cast("string")))
    both = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)
    return L.files(spark, d).select("id", F.array_join(F.transform(F.array_sort(F.map_entries(both)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("merged"))


@query("property_counts", "SELECT event_id, len(json_keys(props)) AS n FROM events WHERE len(json_keys(props)) > 0")
def issues(spark, d):
    keys = F.json_object_keys("props")
    return L.read(spark, d, "events").select("event_id", F.size(keys).cast("long").alias("n")).where("n > 0")


@query("u03_executor_intersection", "SELECT l_orderkey, len(list_intersect(list(DISTINCT l_suppkey % 5), [0, 1, 2])) AS n FROM lineitem GROUP BY 1")
def intersection(spark, d):
    rows = L.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set((F.col("l_suppkey") % 5).cast("int")).alias("x"))
    return rows.select("l_orderkey", F.size(F.array_intersect("x", F.array(F.lit(0), F.lit(1), F.lit(2)))).alias("n"))


@query("w08_state_changes", "SELECT user_id, count(*) FILTER (prev IS NOT NULL AND prev <> event_type) AS changes, max(streak) AS longest FROM (SELECT *, count(*) OVER (PARTITION BY user_id, grp) AS streak FROM (SELECT *, sum(CASE WHEN prev = event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events))) GROUP BY 1")
def changes(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    df = L.events(spark, d).withColumn("prev", F.lag("event_type").over(w)).withColumn("grp", F.sum(F.when(F.col("prev") == F.col("event_type"), 0).otherwise(1)).over(w))
    runs = df.groupBy("user_id", "grp").agg(F.count(F.lit(1)).alias("streak"), F.count_if(F.col("prev").isNotNull() & (F.col("prev") != F.col("event_type"))).alias("changes"))
    return runs.groupBy("user_id").agg(F.sum("changes").alias("changes"), F.max("streak").alias("longest"))


@query(
    "x07_metadata_text",
    r"""SELECT doc_id, k <> '' AND NOT contains(k, '=') AND NOT regexp_matches(k, '[\x01-\x08\x0B\x0C\x0E-\x1F]') AS key_ok, NOT regexp_matches(k, '[\x01-\x08\x0B\x0C\x0E-\x1F]') AS value_ok
    FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'title' WHEN 1 THEN '' WHEN 2 THEN 'a=b' WHEN 3 THEN 'a' || chr(9) || 'b' ELSE 'a' || chr(1) END AS k FROM documents)""",
)
def metadata_text(spark, d):
    m = F.col("doc_id") % 5
    k = F.when(m == 0, "title").when(m == 1, "").when(m == 2, "a=b").when(m == 3, "a\tb").otherwise("a\x01")
    return L.read(spark, d, "documents").select("doc_id", M.metadata_key_ok(k).alias("key_ok"), M.metadata_value_ok(k).alias("value_ok"))


@query(
    "x10_cover_art",
    """SELECT file_id, stream_index, codec IN ('mjpeg', 'png', 'bmp', 'gif', 'webp') AND CASE WHEN regexp_full_match(f, '[0-9]+') THEN TRY_CAST(f AS BIGINT) <= 1 ELSE coalesce(TRY_CAST(t AS DOUBLE), 0) <= 0 END AS cover
    FROM (SELECT *, CASE stream_index % 4 WHEN 0 THEN '1' WHEN 1 THEN '24' WHEN 2 THEN 'N/A' END AS f, CASE WHEN is_default THEN 'N/A' WHEN is_forced THEN '0.000' ELSE '12.5' END AS t FROM tracks)""",
)
def cover_art(spark, d):
    m = F.col("stream_index") % 4
    frames = F.when(m == 0, "1").when(m == 1, "24").when(m == 2, "N/A")
    duration = F.when(F.col("is_default"), "N/A").when(F.col("is_forced"), "0.000").otherwise("12.5")
    return L.tracks(spark, d).select("file_id", "stream_index", M.cover_art(F.col("codec"), frames, duration).alias("cover"))


@query(
    "x12_animation",
    """SELECT file_id, stream_index, CASE WHEN g = 'Anime Series' THEN true WHEN g = 'Live-Action' THEN false WHEN is_default THEN true WHEN stream_index % 3 = 0 THEN false WHEN is_forced AND stream_index >= 2 THEN true END AS animated
    FROM (SELECT *, CASE stream_index % 4 WHEN 0 THEN 'Anime Series' WHEN 1 THEN 'Live-Action' WHEN 2 THEN 'Drama' END AS g FROM tracks)""",
)
def animated(spark, d):
    i = F.col("stream_index")
    tags = [F.when(i % 4 == 0, "Anime Series").when(i % 4 == 1, "Live-Action").when(i % 4 == 2, "Drama"), F.when(F.col("is_default"), "ANIMATION")]
    pixels = F.when(F.col("is_forced"), "pal8").otherwise("yuv420p")
    found = M.animation(tags, i % 3 == 0, F.lit("bt709"), pixels, i * 100.0, F.lit(10.0))
    return L.tracks(spark, d).select("file_id", "stream_index", found.alias("animated"))


@query(
    "x13_mastering_display",
    """SELECT file_id, stream_index, CASE WHEN is_default THEN 'G(' || stream_index || ',2)B(3,4)R(5,6)WP(7,8)L(1000,1)' WHEN is_forced THEN 'as given' END AS display FROM tracks""",
)
def mastering(spark, d):
    values = {"green_y": "2/50000", "blue_x": "3", "blue_y": "4", "red_x": "5/50000", "red_y": "6", "white_point_x": "7", "white_point_y": "8", "max_luminance": "1000/1", "min_luminance": "1/10000"}
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    whole = F.create_map(F.lit("green_x"), F.concat(F.col("stream_index").cast("string"), F.lit("/50000")), *pairs)
    side = F.when(F.col("is_default"), whole).when(F.col("is_forced"), F.create_map(F.lit("master_display"), F.lit("as given"))).otherwise(F.create_map(F.lit("red_x"), F.lit("1")))
    return L.tracks(spark, d).select("file_id", "stream_index", M.mastering_display(side).alias("display"))
