"""Queries over probe documents, which are made here from the library's files and tracks, bad ones among them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinemill.operators import probe as P
from cinemill.plans.registry import query
from cinemill.sources import library as L


def documents(spark, d):
    """(path, size, mtime, content_hash, document): every seventeenth is cut short, has no streams or has each stream twice."""
    i, kind, even = F.col("stream_index"), F.col("track_type"), F.col("file_id") % 2 == 0
    still, font = F.col("codec") == "mjpeg", F.col("codec") == "ttf"
    one = lambda c: F.when(c, 1).otherwise(0)
    codec_type = F.when(still | (kind == "video"), "video").when(font, "attachment").when(i == 5, "data").otherwise(F.split_part(kind, F.lit("_"), F.lit(1)))
    stream = F.struct(
        i.alias("index"), codec_type.alias("codec_type"), F.upper("codec").alias("codec_name"),
        F.struct(F.when(i == 4, "xx").otherwise(F.col("language")).alias("language"), F.when(i != 3, F.col("title")).alias("title"), F.when(font, "a.ttf").alias("filename")).alias("tags"),
        F.struct(one(F.col("is_default")).alias("default"), one(F.col("is_forced")).alias("forced"), one(kind == "audio_commentary").alias("comment"), one(still & even).alias("attached_pic")).alias("disposition"),
        F.when(still & ~even, "1").alias("nb_frames"), F.col("width"), (F.col("width") / 2).cast("int").alias("height"), F.when(kind == "video", "25/1").alias("r_frame_rate"),
        F.when(F.col("is_vfr"), "24/1").when(kind == "video", "25/1").alias("avg_frame_rate"), F.col("pixel_format").alias("pix_fmt"), F.when(F.col("is_hdr"), "smpte2084").alias("color_transfer"),
        F.when(F.col("is_hdr") & even, F.array(F.struct(F.lit("Content light level metadata").alias("side_data_type"), F.lit(1000).alias("max_content"), F.lit("400").alias("max_average")))).alias("side_data_list"),
        F.col("channels"), F.col("channel_layout"), F.col("sample_rate").cast("string").alias("sample_rate"), F.col("bit_depth").cast("string").alias("bits_per_raw_sample"),
    )
    nested = L.tracks(spark, d).select("file_id", stream.alias("s")).groupBy(F.col("file_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("s.index").alias("o"), "s"))).alias("streams"))
    k = F.col("id")
    streams = F.transform("streams", lambda x: x["s"])
    streams = F.when(k % 17 == 7, F.concat(streams, streams)).otherwise(streams)
    # some durations are numbers instead of texts
    form = lambda duration: F.to_json(F.struct(F.struct(duration.alias("duration"), (k * 10).cast("string").alias("bit_rate"), F.create_map(F.lit("Title"), F.concat(F.lit("t"), k.cast("string"))).alias("tags")).alias("format"), F.when(k % 17 != 5, streams).alias("streams")))
    text = F.when(k % 4 == 1, form(k.cast("int"))).otherwise(form(k.cast("string")))
    files = L.files(spark, d).join(nested, "id", "left")
    return files.select("path", "size", k.alias("mtime"), "content_hash", F.when(k % 17 == 3, F.substring(text, F.lit(1), F.length(text) - 1)).when(k % 17 != 4, text).alias("document"))


_T = """t AS (
      SELECT *, CASE WHEN codec = 'mjpeg' OR track_type = 'video' THEN 'video' WHEN codec = 'ttf' THEN 'attachment' WHEN stream_index = 5 THEN 'data' ELSE split_part(track_type, '_', 1) END AS kind,
        count(*) OVER (PARTITION BY file_id) AS n FROM tracks),
    s AS (
      SELECT t.*, stream_index + r * n AS pos, f.path FROM t JOIN files f ON f.id = t.file_id, unnest([0, 1]) AS u(r)
      WHERE (r = 0 OR file_id % 17 = 7) AND file_id % 17 NOT IN (3, 4, 5))"""


@query(
    "s06_probed_tracks",
    f"""
    WITH {_T}
    SELECT path, CAST(pos AS BIGINT) AS "index",
      CASE WHEN track_type = 'video' THEN 'video' WHEN kind IN ('video', 'attachment') THEN 'attachment'
        WHEN kind = 'audio' AND (track_type = 'audio_commentary' OR stream_index <> 3 AND contains(title, 'Comment')) THEN 'audio_commentary'
        WHEN kind = 'audio' AND is_default THEN 'audio_main' WHEN kind = 'audio' THEN 'audio_alternate' WHEN is_forced THEN 'subtitle_forced'
        WHEN stream_index <> 3 AND contains(title, 'Comment') THEN 'subtitle_commentary' ELSE 'subtitle_main' END AS track_type,
      codec, CASE WHEN stream_index = 4 THEN 'und' ELSE language END AS language, CASE WHEN stream_index = 3 THEN '' ELSE title END AS title,
      is_default AND kind <> 'attachment' AS is_default, is_forced AND kind <> 'attachment' AS is_forced, width, width // 2 AS height,
      CASE WHEN track_type = 'video' THEN 25::DOUBLE END AS frame_rate, CASE WHEN track_type = 'video' THEN is_vfr END AS is_vfr, CASE WHEN track_type = 'video' THEN is_hdr END AS is_hdr,
      CASE WHEN is_hdr THEN 'HDR10' END AS hdr_format, pixel_format, CASE WHEN is_hdr AND file_id % 2 = 0 THEN 1000 END AS max_cll, CASE WHEN is_hdr AND file_id % 2 = 0 THEN 400 END AS max_fall,
      CASE WHEN kind = 'audio' THEN channels END AS channels, CASE WHEN kind = 'audio' THEN channel_layout END AS channel_layout,
      CASE WHEN kind = 'audio' THEN sample_rate END AS sample_rate, CASE WHEN kind = 'audio' THEN bit_depth END AS bit_depth
    FROM s WHERE kind <> 'data'
    """,
)
def probed_tracks(spark, d):
    found = P.probed_tracks(documents(spark, d))
    return found.drop("color_primaries", "color_transfer", "color_matrix", "master_display", "dolby_vision_profile", "is_animation")


@query(
    "s06_probed_files",
    f"""
    WITH {_T}, n AS (SELECT file_id, count(*) AS n_tracks FROM s WHERE kind <> 'data' GROUP BY 1)
    SELECT f.path, size, content_hash, container, CASE WHEN id % 17 IN (3, 4) OR id % 4 = 1 THEN 0 ELSE id END::DOUBLE AS duration, CASE WHEN id % 17 NOT IN (3, 4) THEN id * 10 END AS bitrate,
      CASE WHEN id % 17 NOT IN (3, 4) THEN 't' || id END AS title, coalesce(n_tracks, 0) AS n_tracks,
      CASE WHEN id % 17 = 3 THEN 'malformed' WHEN id % 17 = 4 THEN 'missing' WHEN id % 17 = 5 OR id NOT IN (SELECT file_id FROM tracks) THEN 'no streams' END AS problem
    FROM files f LEFT JOIN n ON n.file_id = f.id
    """,
)
def probed_files(spark, d):
    return P.probed_files(documents(spark, d)).withColumn("title", F.try_element_at("tags", F.lit("title"))).drop("tags")


_COMMON = """'index': stream_index, 'codec': upper(codec), 'language': CASE WHEN stream_index = 4 THEN 'xx' ELSE language END, 'title': CASE WHEN stream_index = 3 THEN '' ELSE title END,
        'is_default': is_default, 'is_forced': is_forced"""


@query(
    "s18_canonical_records",
    f"""
    WITH {_T}, r AS (
      SELECT path, list({{{_COMMON}, 'track_type': 'video', 'width': width, 'height': width // 2, 'frame_rate': CASE WHEN track_type = 'video' THEN 25::DOUBLE END, 'is_vfr': false, 'is_hdr': is_hdr AND track_type = 'video',
          'hdr_format': CASE WHEN is_hdr AND track_type = 'video' THEN 'PQ' END, 'pixel_format': pixel_format}} ORDER BY pos) FILTER (kind = 'video') AS video,
        list({{{_COMMON}, 'track_type': 'audio_main', 'channels': channels, 'channel_layout': channel_layout, 'sample_rate': sample_rate, 'bit_depth': bit_depth}} ORDER BY pos) FILTER (kind = 'audio') AS audio,
        list({{{_COMMON}, 'track_type': 'subtitle_main'}} ORDER BY pos) FILTER (kind = 'subtitle') AS subtitle,
        list({{{_COMMON}, 'track_type': 'attachment', 'filename': 'a.ttf'}} ORDER BY pos) FILTER (kind = 'attachment') AS attachment FROM s GROUP BY 1)
    SELECT f.path, size, id AS mtime, container, CASE WHEN id % 17 IN (3, 4) THEN 0 ELSE id END::DOUBLE AS duration, CASE WHEN id % 17 NOT IN (3, 4) THEN id * 10 END AS bitrate,
      CAST(coalesce(len(video), 0) AS BIGINT) AS n_video, CAST(coalesce(len(audio), 0) AS BIGINT) AS n_audio, CAST(coalesce(len(subtitle), 0) AS BIGINT) AS n_subtitle, CAST(coalesce(len(attachment), 0) AS BIGINT) AS n_attachment,
      video[1].codec AS first_video, video[1].hdr_format AS hdr_format, video[1].height AS height, audio[-1].language AS last_language, audio[-1].bit_depth AS bit_depth,
      list_transform(coalesce(subtitle, []), lambda t: t.index || ':' || t.title || ':' || t.is_forced) AS subtitles, attachment[1].filename AS filename
    FROM files f LEFT JOIN r ON r.path = f.path
    """,
)
def canonical_records(spark, d):
    df = P.records(documents(spark, d))
    n = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    at = lambda c, i, f: F.try_element_at(c, F.lit(i))[f]
    return df.select(
        "path", "size", "mtime", "container", "duration", "bitrate", *(n(c) for c in ("video", "audio", "subtitle", "attachment")), at("video", 1, "codec").alias("first_video"), at("video", 1, "hdr_format").alias("hdr_format"),
        at("video", 1, "height").alias("height"), at("audio", -1, "language").alias("last_language"), at("audio", -1, "bit_depth").alias("bit_depth"),
        F.transform("subtitle", lambda t: F.concat_ws(":", t["index"].cast("string"), t["title"], t["is_forced"].cast("string"))).alias("subtitles"), at("attachment", 1, "filename").alias("filename"),
    )
