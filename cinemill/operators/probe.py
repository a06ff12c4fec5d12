"""Probe documents (one JSON text a file) as rows: files, tracks, canonical records and what is wrong with a document.

A document is parsed once, into a VARIANT; fields are read by path with the JSON type that they must
have, so a number where a text belongs counts as absent. Nothing fails on a bad document: it gives a
file without tracks, and its problem in a column. A document that repeats a key in one object counts
as malformed. Streams are cast to structs once; what a table needs of them is typed in the same step, so
no row carries a VARIANT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinemill.functions import media as M

# Transfers that mean HDR, side data that does, layout names that titles quote.
HDR_TRANSFERS = ("smpte2084", "arib-std-b67", "smpte428", "bt2020-10", "bt2020-12")
DOVI, DYNAMIC, STATIC = "DOVI|Dolby Vision", "HDR10\\+|Dynamic HDR", "Mastering display|Content light level"
LAYOUTS = ("1.0", "2.0", "5.1", "6.1", "7.1")
UINT32, UINT8 = (1 << 32) - 1, 255
TEXTS = ("codec_type", "codec_name", "nb_frames", "duration", "color_transfer", "color_primaries", "color_space", "r_frame_rate", "avg_frame_rate", "pix_fmt", "channel_layout", "sample_rate", "bits_per_raw_sample")
FLAGS = ("default", "forced", "comment", "attached_pic")
STREAMS = (
    "array<struct<" + ",".join(f"`{n}`:variant" for n in ("index", "width", "height", "channels", *TEXTS)) + ",tags:map<string,variant>,disposition:struct<" + ",".join(f"`{n}`:variant" for n in FLAGS)
    + ">,side_data_list:array<variant>>>"
)
POINTS = ("green", "blue", "red", "white_point")


def kind_of(v: Column, path: str) -> Column:
    return F.schema_of_variant(v if path == "$" else F.try_variant_get(v, path, "variant"))


def text(v: Column, path: str = "$") -> Column:
    """A field that is a JSON text, else NULL."""
    return F.when(kind_of(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def whole(v: Column, path: str = "$", most: int = UINT32) -> Column:
    """A field that is a JSON number without fraction or sign, at most `most`, else NULL."""
    n = F.try_variant_get(v, path, "long")
    return F.when(kind_of(v, path) == "BIGINT", F.when(n >= 0, F.least(n, F.lit(most))))


def number(value: Column, most: int = UINT32) -> Column:
    """A text of digits as a number, NULL beyond `most`."""
    n = value.try_cast("long")
    return F.when(value.rlike("^[+]?[0-9]{1,18}$") & (n <= most), n)


def number_or_text(v: Column, most: int, *paths: str) -> Column:
    """The first of the fields that is a number or a text of digits."""
    plain = lambda p: F.when(kind_of(v, p) == "BIGINT", F.try_variant_get(v, p, "long"))
    fits = lambda n: F.when((n >= 0) & (n <= most), n)
    return F.coalesce(*(fits(F.coalesce(plain(p), number(text(v, p), most))) for p in paths))


def flag(s: Column, name: str) -> Column:
    v = s["disposition"][name]
    return F.coalesce((kind_of(v, "$") == "BIGINT") & (F.to_json(v) == "1"), F.lit(False))


def tag(s: Column, name: str) -> Column:
    return text(F.try_element_at(s["tags"], F.lit(name)))


def real(value: Column) -> Column:
    return F.when(value.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), value.try_cast("double"))


def ratio(value: Column) -> Column:
    """"24000/1001" or a plain number as a double."""
    a, b = real(F.split_part(value, F.lit("/"), F.lit(1))), real(F.substring_index(value, "/", -1))
    return F.when(F.contains(value, F.lit("/")), F.when(b > 0, a / b)).otherwise(real(value))


def parsed(documents: DataFrame, stream, document: str = "document") -> DataFrame:
    """The table with v (VARIANT, NULL where malformed), streams (array of stream(s) over structs STREAMS) and problem (NULL if none)."""
    df = documents.withColumn("v", F.try_parse_json(F.col(document)))
    df = df.withColumn("streams", F.transform(F.try_variant_get("v", "$.streams", STREAMS), stream))
    shape = F.schema_of_variant("v")
    problem = F.when(F.col(document).isNull(), "missing").when(F.col("v").isNull(), "malformed").when(~shape.startswith("OBJECT"), "not an object").when(F.col("streams").isNull(), "no streams")
    return df.withColumn("problem", problem)


def side_data(x: Column) -> Column:
    """What one entry of a stream's side data tells."""
    coordinate = lambda n: F.coalesce(number_or_text(x, UINT32, f"$.{n}").cast("string"), F.split_part(text(x, f"$.{n}"), F.lit("/"), F.lit(1)))
    pair = lambda label, a, b: F.concat(F.lit(label + "("), coordinate(a), F.lit(","), coordinate(b), F.lit(")"))
    points = [pair(label, f"{n}_x", f"{n}_y") for label, n in zip(("G", "B", "R", "WP"), POINTS)]
    return F.struct(
        F.coalesce(text(x, "$.side_data_type"), F.lit("")).alias("type"), number_or_text(x, UINT32, "$.max_content", "$.max_cll").alias("max_cll"), number_or_text(x, UINT32, "$.max_average", "$.max_fall").alias("max_fall"),
        F.coalesce(F.concat(*points, pair("L", "max_luminance", "min_luminance")), text(x, "$.master_display")).alias("display"), number_or_text(x, UINT8, "$.dv_profile", "$.profile").alias("profile"),
    )


def _track(s: Column) -> Column:
    """What probed_tracks() needs of a stream, typed."""
    tags = ("language", "title", "genre", "GENRE", "content_type", "CONTENT_TYPE")
    return F.struct(
        *(text(s[n]).alias(n) for n in TEXTS), *(whole(s[n]).alias(n) for n in ("width", "height", "channels")), *(flag(s, n).alias(n) for n in FLAGS), *(tag(s, n).alias(f"tag{i}") for i, n in enumerate(tags)),
        F.transform(s["side_data_list"], side_data).alias("side"),
    )


def probed_files(documents: DataFrame) -> DataFrame:
    """(path, size, content_hash, container, duration, bitrate, tags, n_tracks, problem) of (path, size, content_hash, document)."""
    df, v = parsed(documents, lambda s: text(s["codec_type"])), F.col("v")
    pairs = F.map_entries(F.try_variant_get(v, "$.format.tags", "map<string,variant>"))
    texts = F.filter(pairs, lambda e: F.schema_of_variant(e["value"]) == "STRING")
    # of keys that differ by case only the last one stays, as in a map that is filled in order
    lowered = F.transform(texts, lambda e: F.struct(F.lower(e["key"]).alias("key"), F.try_variant_get(e["value"], "$", "string").alias("value")))
    tags = F.aggregate(lowered, F.expr("map()").cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.map_from_entries(F.array(e))))
    kinds = F.filter("streams", lambda kind: kind.isin("video", "audio", "subtitle", "attachment"))
    return df.select(
        "path", "size", "content_hash", M.container_of(M.extension(F.col("path"))).alias("container"), F.coalesce(real(text(v, "$.format.duration")), F.lit(0.0)).alias("duration"),
        number(text(v, "$.format.bit_rate")).alias("bitrate"), F.coalesce(tags, F.expr("map()").cast("map<string,string>")).alias("tags"), F.coalesce(F.size(kinds), F.lit(0)).cast("long").alias("n_tracks"), "problem",
    )


def probed_tracks(documents: DataFrame) -> DataFrame:
    """One row a video, audio, subtitle or attachment stream of (path, document), in stream order.

    index counts every stream. Attached and still pictures are attachments. Fields of other kinds of
    stream are NULL.
    """
    # outer: the filter that an inner one brings along would parse every document again
    df = parsed(documents, _track).select("path", F.posexplode_outer("streams").alias("index", "s")).where(F.col("s.codec_type").isin("video", "audio", "subtitle", "attachment"))
    codec, audio = F.coalesce("codec_name", F.lit("unknown")), F.col("kind") == "audio"
    # the branches of side data exclude one another in this order
    last = lambda yes, *no: F.try_element_at(F.filter("side", lambda x: x["type"].rlike(yes) & ~x["type"].rlike("|".join(no) or "^\\b$")), F.lit(-1))
    of = lambda pattern: F.exists("side", lambda x: x["type"].rlike(pattern))
    df = df.select("path", "index", "s.*").withColumnRenamed("codec_type", "kind").select(
        "*", F.coalesce(M.canonical_codec(codec), F.lower(codec)).alias("named"), ratio(F.col("r_frame_rate")).alias("real_rate"), ratio(F.col("avg_frame_rate")).alias("mean_rate"), F.coalesce("tag1", F.lit("")).alias("title"),
        last("Content light level")["max_cll"].alias("max_cll"), last("Content light level")["max_fall"].alias("max_fall"), last("Mastering display", "Content light level")["display"].alias("display"),
        last(DOVI, "Content light level", "Mastering display")["profile"].alias("profile"), of(DOVI).alias("dovi"), of(DYNAMIC).alias("dynamic"), of(STATIC).alias("static"),
    )
    df = df.withColumn("codec", F.when(F.col("named").rlike("[A-Z]"), F.lower("named")).otherwise(F.col("named")))
    df = df.withColumn("moving", (F.col("kind") == "video") & ~(F.col("attached_pic") | M.cover_art(F.col("codec"), F.col("nb_frames"), real(F.col("duration")))))
    spoken = F.col("comment") | F.contains(F.lower("title"), F.lit("comment"))
    video, moving, transfer = F.col("kind") == "video", F.col("moving"), F.col("color_transfer")
    track_type = (
        F.when(moving, "video").when(video | (F.col("kind") == "attachment"), "attachment").when(audio, M.audio_type(F.col("title"), F.col("default"), F.col("comment")))
        .when(F.col("forced"), "subtitle_forced").when(spoken, "subtitle_commentary").otherwise("subtitle_main")
    )
    own = lambda c, n: F.when(c, n)
    hdr_format = (
        F.when(F.col("dovi"), F.concat(F.lit("Dolby Vision"), F.coalesce(F.concat(F.lit(" Profile "), F.col("profile").cast("string")), F.lit("")))).when(F.col("dynamic"), "HDR10+")
        .when(transfer == "smpte2084", "HDR10").when(transfer == "arib-std-b67", "HLG").when(F.col("static"), "HDR10")
    )
    known = lambda name: F.when(~F.col(name).isin("", "unknown"), F.col(name))
    hdr = F.coalesce(transfer.isin(*HDR_TRANSFERS), F.lit(False)) | F.coalesce(F.col("dovi") | F.col("dynamic") | F.col("static"), F.lit(False))
    tags, real_rate, mean_rate = [F.col(f"tag{i}") for i in range(2, 6)], F.col("real_rate"), F.col("mean_rate")
    return df.select(
        "path", F.col("index").cast("long").alias("index"), track_type.alias("track_type"), "codec", F.coalesce(M.canonical_language(F.col("tag0")), F.lit("und")).alias("language"), "title",
        (F.col("default") & (F.col("kind") != "attachment")).alias("is_default"), (F.col("forced") & (F.col("kind") != "attachment")).alias("is_forced"),
        own(moving, F.col("width")).alias("width"), own(moving, F.col("height")).alias("height"), own(moving, real_rate).alias("frame_rate"),
        own(moving, F.coalesce((real_rate > 0) & (mean_rate > 0) & (F.abs(real_rate - mean_rate) / real_rate > 0.01), F.lit(False))).alias("is_vfr"),
        own(moving, hdr).alias("is_hdr"), own(moving, hdr_format).alias("hdr_format"), own(moving, F.col("pix_fmt")).alias("pixel_format"),
        own(moving, known("color_primaries")).alias("color_primaries"), own(moving, known("color_transfer")).alias("color_transfer"), own(moving, known("color_space")).alias("color_matrix"),
        own(moving, F.col("max_cll")).alias("max_cll"), own(moving, F.col("max_fall")).alias("max_fall"), own(moving, F.col("display")).alias("master_display"), own(moving, F.col("profile")).alias("dolby_vision_profile"),
        own(moving, M.animation(tags, hdr, F.col("color_space"), F.col("pix_fmt"), real(F.col("nb_frames")), real(F.col("duration")))).alias("is_animation"),
        own(audio, F.col("channels")).alias("channels"), own(audio, F.col("channel_layout")).alias("channel_layout"),
        own(audio, number(F.col("sample_rate"))).alias("sample_rate"), own(audio, number(F.col("bits_per_raw_sample"))).alias("bit_depth"),
    )


def canonical_title(title: Column) -> Column:
    """A title that is a quoted layout name without its quotes; NULL is empty."""
    bare = F.btrim(title, F.lit('"'))
    return F.coalesce(F.when(title.rlike('^".*"$') & bare.isin(*LAYOUTS), bare).otherwise(title), F.lit(""))


def _record(s: Column) -> Column:
    """What records() needs of a stream, typed; fields of one kind of stream are read for that kind only."""
    kind = text(s["codec_type"])
    video, audio = lambda x: F.when(kind == "video", x), lambda x: F.when(kind == "audio", x)
    transfer = F.coalesce(text(s["color_transfer"]), F.lit(""))
    return F.struct(
        kind.alias("kind"), F.try_variant_get(s["index"], "$", "long").alias("index"), F.coalesce(text(s["codec_name"]), F.lit("unknown")).alias("codec"), F.coalesce(tag(s, "language"), F.lit("und")).alias("language"),
        canonical_title(tag(s, "title")).alias("title"), flag(s, "default").alias("is_default"), flag(s, "forced").alias("is_forced"),
        video(whole(s["width"])).alias("width"), video(whole(s["height"])).alias("height"), video(ratio(text(s["r_frame_rate"]))).alias("frame_rate"), F.lit(False).alias("is_vfr"),
        video(transfer.rlike("smpte2084|arib-std-b67")).alias("is_hdr"), video(F.when(transfer == "smpte2084", "PQ").when(transfer == "arib-std-b67", "HLG")).alias("hdr_format"), video(text(s["pix_fmt"])).alias("pixel_format"),
        audio(whole(s["channels"])).alias("channels"), audio(text(s["channel_layout"])).alias("channel_layout"), audio(number_or_text(s["sample_rate"], UINT32, "$")).alias("sample_rate"),
        audio(number_or_text(s["bits_per_raw_sample"], UINT32, "$")).alias("bit_depth"), F.when(kind == "attachment", F.coalesce(tag(s, "filename"), F.lit(""))).alias("filename"),
    )


def records(documents: DataFrame) -> DataFrame:
    """One canonical record a file of (path, size, mtime, document): scalars, and an array of structs for each kind of stream.

    Codec and language stay as the probe names them; sizes and times come from the listing.
    """
    df, v = parsed(documents, _record), F.col("v")

    def of(kind: str, track_type: str, *more: str):
        fields = lambda s: F.struct(*(s[n].alias(n) for n in ("index", "codec", "language", "title", "is_default", "is_forced")), F.lit(track_type).alias("track_type"), *(s[n].alias(n) for n in more))
        return F.coalesce(F.transform(F.filter("streams", lambda s: s["kind"] == kind), fields), F.array()).alias(kind)

    return df.select(
        "path", "size", "mtime", M.container_of(M.extension(F.col("path"))).alias("container"), F.coalesce(real(text(v, "$.format.duration")), F.try_variant_get(v, "$.format.duration", "double"), F.lit(0.0)).alias("duration"),
        F.try_variant_get(v, "$.format.bit_rate", "long").alias("bitrate"), F.lit(None).cast("string").alias("content_hash"),
        of("video", "video", "width", "height", "frame_rate", "is_vfr", "is_hdr", "hdr_format", "pixel_format"), of("audio", "audio_main", "channels", "channel_layout", "sample_rate", "bit_depth"),
        of("subtitle", "subtitle_main"), of("attachment", "attachment", "filename"), "problem",
    )
