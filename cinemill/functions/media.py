"""Scalar Columns about media: names, formats, probe fields, paths and times."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical codec names with their aliases.
CODECS = {
    "video": {
        "h264": "h264 avc avc1 x264", "hevc": "h265 hevc x265 hev1", "av1": "av1 av01", "vp9": "vp9 vp09", "vp8": "vp8", "mpeg2video": "mpeg2 mpeg2video m2v", "vc1": "vc1 vc-1 wmv3",
    },
    "audio": {
        "aac": "aac aac-lc mp4a", "ac3": "ac3 ac-3 a_ac3", "eac3": "eac3 e-ac-3 a_eac3", "truehd": "truehd mlp a_truehd", "dts": "dts a_dts", "dts_hd_ma": "dts_hd dts-hd dts_hd_ma",
        "flac": "flac a_flac", "opus": "opus a_opus", "vorbis": "vorbis a_vorbis", "mp3": "mp3", "mp2": "mp2", "pcm": "pcm pcm_s16le pcm_s24le",
    },
    "subtitle": {
        "subrip": "srt subrip s_text/utf8", "ass": "ass ssa s_text/ass", "hdmv_pgs_subtitle": "pgs hdmv_pgs_subtitle s_hdmv/pgs", "dvd_subtitle": "vobsub dvd_subtitle s_vobsub", "dvb_subtitle": "dvb_subtitle", "webvtt": "webvtt",
    },
}
# ISO 639-2/B codes with the codes that stand for them.
LANGUAGES = {
    "eng": "en eng", "fre": "fr fra fre", "ger": "de deu ger", "spa": "es spa", "ita": "it ita", "por": "pt por", "rus": "ru rus", "jpn": "ja jpn", "chi": "zh zho chi", "kor": "ko kor", "ara": "ar ara", "hin": "hi hin",
    "dut": "nl nld dut", "swe": "sv swe", "nor": "no nor", "dan": "da dan", "fin": "fi fin", "pol": "pl pol", "cze": "cs ces cze", "hun": "hu hun", "rum": "ro ron rum", "gre": "el ell gre", "tur": "tr tur", "heb": "he heb",
    "tha": "th tha", "vie": "vi vie", "ukr": "uk ukr", "und": "und", "zxx": "zxx", "mul": "mul",
}
# Codecs that modelled containers can hold; mkv holds all, others are not judged.
HOLDS = {
    "mp4": "h264 avc1 hevc h265 hev1 hvc1 av1 mpeg4 mpeg2video vp9 aac mp3 ac3 eac3 opus alac flac mov_text tx3g".split(),
    "webm": "vp8 vp9 av1 opus vorbis webvtt".split(),
    "avi": "mpeg4 mpeg2video mpeg1video mjpeg h264 avc1 mp3 ac3 aac pcm_s16le pcm_s24le pcm_u8".split(),
}
# Containers by file extension.
EXTENSIONS = {"mkv": "mkv mka mks", "mp4": "mp4 m4v m4a", "avi": "avi", "webm": "webm", "flv": "flv", "wmv": "wmv wma", "mov": "mov", "ts": "ts m2ts mts"}
# Error signatures in order, with the text that shows each.
SIGNATURES = (
    ("storage-fk-transcode-outcome", "failed to insert transcode outcome: FOREIGN KEY"), ("cuda-context-oom", "CUDA_ERROR_OUT_OF_MEMORY"), ("cuda-context-unknown", "CUDA_ERROR_UNKNOWN"),
    ("nvenc-initialize-oom", "InitializeEncoder failed: out of memory"), ("cuda-decoder-packet-oom", "Error submitting packet to decoder: Cannot allocate memory"),
    ("filter-format-conversion", "Impossible to convert between the formats"), ("no-hw-decoder-device", "No device available for decoder"), ("no-output-written", "Nothing was written into output file"),
    ("ffmpeg-conversion-failed", "Conversion failed"), ("ffmpeg-nonzero", "ffmpeg exited with exit status"),
)
# Text that shows the line of an error worth quoting.
QUOTED = ("CUDA_ERROR", "InitializeEncoder", "FOREIGN KEY", "No device available", "Impossible to convert", "Nothing was written", "Conversion failed", "ffmpeg exited")
RESERVE = 50 * 1024 * 1024


def _lookup(groups: dict[str, str], value: Column) -> Column:
    pairs = [F.lit(x) for canonical, names in groups.items() for name in names.split() for x in (name, canonical)]
    return F.try_element_at(F.create_map(*pairs), value)


def canonical_codec(value: Column) -> Column:
    """Canonical name of a codec alias, any case; unknown names stay as they are."""
    every = {k: v for group in CODECS.values() for k, v in group.items()}
    return F.coalesce(_lookup(every, F.lower(F.trim(value))), value)


def codec_kind(value: Column) -> Column:
    canonical = canonical_codec(value)
    out = None
    for kind, names in CODECS.items():
        hit = canonical.isin(list(names))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def canonical_language(value: Column) -> Column:
    """ISO 639-2/B code, or NULL where the value is no known code."""
    return _lookup(LANGUAGES, F.lower(F.trim(value)))


def container_of(ext: Column) -> Column:
    return F.coalesce(_lookup(EXTENSIONS, F.lower(ext)), F.lit("other"))


def holds(container: Column, codec: Column) -> Column:
    """Whether a container can hold a codec; NULL where it is not judged."""
    codec = F.lower(F.trim(codec))
    out = F.when(codec.isNull() | (codec == ""), F.lit(None)).when(container == "mkv", True)
    for name, codecs in HOLDS.items():
        out = out.when(container == name, codec.isin(codecs))
    return out


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def _in_units(n: Column, bits: int, digits: int) -> Column:
    """n / 2^bits in units of the last of so many digits, exactly, a tie to the even one; n counts as its nearest double."""
    n, ten = n.cast("double").cast("long"), 10**digits
    rest = n.bitwiseAND((1 << bits) - 1) * ten
    whole, over = F.shiftright(n, bits) * ten + F.shiftright(rest, bits), rest.bitwiseAND((1 << bits) - 1)
    half = 1 << (bits - 1)
    return whole + F.when((over > half) | ((over == half) & (whole % 2 == 1)), 1).otherwise(0)


def format_size(n: Column) -> Column:
    gib, mib, kib = _in_units(n, 30, 2), _in_units(n, 20, 1), _in_units(n, 10, 0)
    return (
        F.when(n >= 1 << 30, F.format_string("%d.%02d GiB", F.floor(gib / 100), gib % 100)).when(n >= 1 << 20, F.format_string("%d.%d MiB", F.floor(mib / 10), mib % 10))
        .when(n >= 1 << 10, F.format_string("%d KiB", kib)).otherwise(F.concat(n.cast("string"), F.lit(" B")))
    )


def format_duration(seconds: Column) -> Column:
    t = F.round(seconds).cast("long")
    h, m, s = F.floor(t / 3600), F.floor(t % 3600 / 60), t % 60
    return F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, s)).when(m > 0, F.format_string("%dm %02ds", m, s)).otherwise(F.format_string("%ds", s))


def normal_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, r"\s+", " "))


def fraction(text: Column) -> Column:
    """\"24000/1001\" as a double; NULL where the denominator is zero or the text is no number."""
    parts = F.split(text, "/")
    num, den = F.try_element_at(parts, F.lit(1)).try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double")
    return F.when(F.size(parts) == 1, num).when(den != 0, num / den)


def variable_rate(real: Column, average: Column) -> Column:
    """Whether two frame rates differ by more than a hundredth."""
    a, b = fraction(real), fraction(average)
    return F.coalesce((b > 0) & (F.abs(a - b) / b > 0.01), F.lit(False))


def hdr_format(transfer: Column, primaries: Column, side: Column) -> Column:
    """HDR format of a stream from its transfer, primaries and the types of its side data (array<string>)."""
    some = lambda *texts: F.exists(side, lambda t: F.lit(False) if not texts else _any([F.contains(t, F.lit(x)) for x in texts]))
    return (
        F.when(some("DOVI", "Dolby Vision"), "Dolby Vision").when(some("HDR10+", "Dynamic HDR"), "HDR10+").when(transfer == "smpte2084", "HDR10").when(transfer == "arib-std-b67", "HLG")
        .when(some("Mastering display", "Content light level"), "HDR10")
    )


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def audio_type(title: Column, default: Column, commentary: Column) -> Column:
    t = F.lower(F.coalesce(title, F.lit("")))
    return (
        F.when(commentary | F.contains(t, F.lit("comment")), "audio_commentary").when(F.contains(t, F.lit("music")) | F.contains(t, F.lit("soundtrack")), "audio_music")
        .when(F.contains(t, F.lit("effect")) | F.contains(t, F.lit("sfx")), "audio_sfx").when(default, "audio_main").otherwise("audio_alternate")
    )


def resolution_tier(width: Column, height: Column) -> Column:
    v = F.least(width, height)
    return F.when(width.isNull() | height.isNull(), None).when(v >= 2160, "4K+").when(v >= 1080, "1080p").when(v >= 720, "720p").when(v >= 480, "SD").otherwise("sub-SD")


def layout_name(channels: Column) -> Column:
    return F.when(channels == 1, "mono").when(channels == 2, "stereo").when(channels == 6, "5.1").when(channels == 8, "7.1").otherwise(F.concat(channels.cast("string"), F.lit("ch")))


def vmaf_model(width: Column, height: Column) -> Column:
    return F.when((F.least(width, height) >= 2160) | (F.greatest(width, height) >= 3840), "4k").when((width <= 1080) & (height > width), "phone").otherwise("default")


def required_space(size: Column, rewrites: Column, subtitles: Column) -> Column:
    """Bytes a plan needs: the size, twice where a track or container is rewritten, subtitles and a reserve; capped at the long's end."""
    total = size.cast("decimal(38,0)") * F.when(rewrites, 2).otherwise(1) + subtitles + RESERVE
    return F.least(total, F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")


def shrunk_percent(before: Column, after: Column) -> Column:
    return F.when((before <= 0) | (after >= before), 0.0).otherwise((before - after) / before * 100)


def error_signature(text: Column) -> Column:
    out = None
    for name, needle in SIGNATURES:
        hit = F.contains(text, F.lit(needle))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")


def scrubbed(text: Column) -> Column:
    """An error line with ids, paths and numbers replaced."""
    t = F.regexp_replace(text, r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<uuid>")
    t = F.regexp_replace(F.regexp_replace(t, r"/[^\s'\":]+", "<path>"), r"[0-9]+", "<n>")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.when(t == "", "unknown").otherwise(t)


def redacted(text: Column) -> Column:
    """Text with the values of secret-looking keys, e-mail addresses and media file names replaced."""
    t = F.regexp_replace(text, r"(?i)\b((?:api[_-]?key|token|secret|password)\s*[:=]\s*)\S+", "$1<redacted>")
    t = F.regexp_replace(t, r"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>")
    return F.regexp_replace(t, r"[^\s/]+\.(?:mkv|mp4|avi|mov|webm)\b", "<file>")


def episode(path: Column) -> Column:
    """struct<series, season, episode> of a TV file name: SxxExx, then NxN, then season and episode folders; NULL if none."""
    name = stem(path)
    a, b = r"^(.+?)[.\s_-]+[Ss](\d{1,2})[Ee](\d{1,3})", r"^(.+?)[.\s_-]+(\d{1,2})x(\d{1,3})"
    parts = F.split(path, "/")
    season, ep = F.regexp_extract(path, r"[Ss]eason\s*(\d{1,2})", 1), F.regexp_extract(name, r"(?:[Ee]pisode|[Ee]p\.?)\s*(\d{1,3})", 1)
    clean = lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, "[._]", " "), r"\s+", " "))
    of = lambda p: F.struct(clean(F.regexp_extract(name, p, 1)).alias("series"), F.regexp_extract(name, p, 2).try_cast("int").alias("season"), F.regexp_extract(name, p, 3).try_cast("int").alias("episode"))
    folder = F.coalesce(F.try_element_at(parts, F.lit(-3)), F.try_element_at(parts, F.lit(-2)), F.lit(""))
    return (
        F.when(F.rlike(name, F.lit(a)), of(a)).when(F.rlike(name, F.lit(b)), of(b))
        .when((season != "") & (ep != ""), F.struct(clean(folder).alias("series"), season.try_cast("int").alias("season"), ep.try_cast("int").alias("episode")))
    )


def subtitle_time(ms: Column) -> Column:
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms % 3_600_000 / 60_000), F.floor(ms % 60_000 / 1000), ms % 1000)


def sample_times(duration: Column, n: int, length: int) -> Column:
    """Start seconds of n samples spread evenly over a duration, each of whole length within it."""
    step = (duration - length) / n
    return F.when(duration <= length, F.array(F.lit(0.0))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor((i + 0.5) * step * 1000) / 1000))


def since(text: str, now: dt.datetime) -> dt.datetime:
    """A bound given as an age (30d, 4w, 12h), a date or a date and time."""
    if m := re.fullmatch(r"\s*(\d+)\s*(h|hr|hours|d|day|days|w|week|weeks)\s*", text):
        n = int(m[1])
        return now - {"h": dt.timedelta(hours=n), "d": dt.timedelta(days=n), "w": dt.timedelta(weeks=n)}[m[2][0]]
    for form in ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%d"):
        try:
            return dt.datetime.strptime(text, form)
        except ValueError:
            pass
    raise ValueError(f"no age, date or date and time: {text}")


# Codecs of still pictures, pixel formats with few colours.
STILL_CODECS = ("mjpeg", "png", "bmp", "gif", "webp")
FEW_COLOURS = ("pal8", "rgb4", "rgb8", "bgr4", "bgr8")


def metadata_value_ok(value: Column) -> Column:
    """No control characters but tab, line feed and carriage return."""
    return ~value.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")


def metadata_key_ok(key: Column) -> Column:
    return (key != "") & ~key.contains("=") & metadata_value_ok(key)


def cover_art(codec: Column, frames: Column, duration: Column) -> Column:
    """Whether a video stream is an embedded picture; frames and duration are probe texts."""
    count = F.when(frames.rlike("^[0-9]+$"), frames.try_cast("decimal(20,0)"))
    one = F.when(count.isNotNull(), count <= 1).otherwise(F.coalesce(duration.try_cast("double"), F.lit(0.0)) <= 0)
    return F.coalesce(codec.isin(*STILL_CODECS) & one, F.lit(False))


def animation(tags: list[Column], hdr: Column, color_space: Column, pixel_format: Column, frames: Column, duration: Column, heuristic: bool = True) -> Column:
    """The first tag that tells animation from live action; else, if asked for, what the picture suggests (null: unknown)."""
    text = [F.lower(t) for t in tags]
    told = [F.when(t.rlike("animation|anime"), True).when(t.rlike("live[ -]action"), False) for t in text]
    space = F.coalesce(color_space, F.lit(""))
    flat = pixel_format.isin(*FEW_COLOURS) & space.isin("", "bt709") & (duration > 0) & (frames >= 20 * duration)
    guess = F.when(hdr | space.contains("bt2020"), False).when(flat, True)
    return F.coalesce(*told, *([guess] if heuristic else []))


def mastering_display(side: Column) -> Column:
    """Mastering display text of a side-data map of strings; ratios keep their numerator."""
    at = lambda key: F.split_part(F.try_element_at(side, F.lit(key)), F.lit("/"), F.lit(1))
    pair = lambda label, x, y: F.concat(F.lit(label + "("), at(x), F.lit(","), at(y), F.lit(")"))
    points = [pair(label, name + "_x", name + "_y") for label, name in (("G", "green"), ("B", "blue"), ("R", "red"), ("WP", "white_point"))]
    return F.coalesce(F.concat(*points, pair("L", "max_luminance", "min_luminance")), F.try_element_at(side, F.lit("master_display")))
