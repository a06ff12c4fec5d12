"""Checks of transcode settings: one row for each thing that is wrong with a rule's settings.

Settings are a JSON object a rule; many libraries' policies are checked as one table. Rules that
depend on one key, on several, and on keys that are not known before are arrays of the same shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinemill.functions.media import codec_kind
from cinemill.operators.probe import UINT32

# Known keys, those for video only, and the values that keys may have.
VIDEO_ONLY = (
    "hdr_mode preserve_hdr tonemap hdr_color_metadata dolby_vision tune scale_algorithm max_resolution target_vmaf max_bitrate min_bitrate sample_strategy fallback crop crop_sample_duration crop_sample_count "
    "crop_threshold crop_minimum crop_preserve_bottom_pixels crop_aspect_lock"
).split()
KNOWN = [*VIDEO_ONLY, *"preserve crf preset bitrate channels hw hw_fallback normalize".split()]
VALUES = {
    "hw": "auto nvenc qsv vaapi videotoolbox none", "hdr_mode": "preserve tonemap", "tonemap": "bt2390 hable mobius reinhard clip", "hdr_color_metadata": "copy", "dolby_vision": "copy_rpu",
    "tune": "film animation grain stillimage fastdecode zerolatency psnr ssim", "scale_algorithm": "lanczos bicubic bilinear neighbor area spline sinc", "max_resolution": "480p 720p 1080p 1440p 2160p 4k 8k",
}
OVERRIDE = "target_vmaf_when "
LONGEST = 64
PROBLEM = "array<struct<level:string,key:string,problem:string>>"


def _kind(x: Column) -> Column:
    return F.coalesce(F.schema_of_variant(x), F.lit("VOID"))


def _text(x: Column) -> Column:
    """A text or a number as text, else NULL."""
    return F.when((_kind(x) == "STRING") | (_kind(x) == "BIGINT") | _kind(x).startswith("DECIMAL") | (_kind(x) == "DOUBLE"), F.try_variant_get(x, "$", "string"))


def _whole(x: Column) -> Column:
    n = F.when(_text(x).rlike("^[0-9]{1,10}$"), _text(x).try_cast("long"))
    return F.when(n <= UINT32, n)


def bitrate(text: Column) -> Column:
    """Bits a second of a text such as 8M or 500k, NULL if it is none or beyond 64 bits."""
    digits, unit = F.regexp_extract(text, "^([0-9]+)([kKmMgG]?)$", 1), F.lower(F.regexp_extract(text, "^([0-9]+)([kKmMgG]?)$", 2))
    n = digits.try_cast("decimal(20,0)") * F.when(unit == "k", 1_000).when(unit == "m", 1_000_000).when(unit == "g", 1_000_000_000).otherwise(1)
    return F.when(n < F.lit(str(2**64)).cast("decimal(38,0)"), n.cast("decimal(20,0)"))


def _row(level: str, key, problem) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(level).alias("level"), lit(key).alias("key"), lit(problem).alias("problem"))


def _vmaf(x: Column, key: Column, name: str) -> list[Column]:
    n = _whole(x)
    return [
        F.when(n.isNull(), _row("error", key, f"{name} must be an integer from 60 to 100")), F.when((n < 60) | (n > 100), _row("error", key, f"{name} must be from 60 to 100")),
        F.when(((n >= 60) & (n < 80)) | (n == 100), _row("warning", key, F.concat(F.lit(f"{name} value "), n.cast("string"), F.lit(" is outside the typical 80-99 range")))),
    ]


def settings_problems(rules: DataFrame) -> DataFrame:
    """(rule, level, key, problem) of rules (rule, target video|audio, codec, settings)."""
    df = rules.withColumn("v", F.try_parse_json("settings")).withColumn("m", F.try_variant_get("v", "$", "map<string,variant>"))
    at = lambda key: F.try_element_at("m", F.lit(key))
    has = lambda key: F.coalesce(F.map_contains_key("m", key), F.lit(False))
    found: list[Column] = []

    def say(condition: Column, key: str, problem) -> None:
        found.append(F.when(condition, _row("error", key, problem)))

    found.append(F.when(F.col("m").isNull(), _row("error", "", "settings are no JSON object")))
    kind = codec_kind(F.col("codec"))
    say(kind.isNotNull() & (kind != F.col("target")), "codec", F.concat(F.lit('codec "'), F.col("codec"), F.lit('" is '), F.when(kind == "audio", "an ").otherwise("a "), kind, F.lit(" codec but target is "), F.col("target")))
    say(has("hw_fallback") & ~has("hw"), "hw_fallback", "hw_fallback has no effect without hw")
    for key, values in VALUES.items():
        said = F.coalesce(_text(at(key)).isin(values.split()), F.lit(False))
        text = F.coalesce(_text(at(key)), F.to_json(at(key)), F.lit("null"))
        say(has(key) & ~said & ((F.col("target") == "video") | F.lit(key == "hw")), key, F.concat(F.lit(f'invalid {key} "'), text, F.lit(f'", expected one of: {", ".join(values.split())}')))
    video = F.col("target") == "video"
    say(video & has("preserve_hdr") & (_kind(at("preserve_hdr")) != "BOOLEAN"), "preserve_hdr", "preserve_hdr must be true or false")
    crop = F.coalesce(_text(at("crop")) == "auto", F.lit(False))
    say(video & has("crop") & ~crop, "crop", "crop must be auto")
    for key in (k for k in VIDEO_ONLY if k.startswith("crop_")):
        n = _whole(at(key))
        say(video & has(key) & ~crop, key, f"{key} has no effect without crop: auto")
        if key.startswith("crop_sample"):
            say(video & has(key) & n.isNull(), key, f"{key} must be a positive integer")
            say(video & (n == 0), key, f"{key} must be greater than 0")
        elif key != "crop_aspect_lock":
            say(video & has(key) & n.isNull(), key, f"{key} must be an integer")
        if key == "crop_threshold":
            say(video & (n > 255), key, f"{key} must be from 0 to 255")
    ratios = F.try_variant_get(at("crop_aspect_lock"), "$", "array<variant>")
    say(video & has("crop_aspect_lock") & ratios.isNull(), "crop_aspect_lock", "crop_aspect_lock must be a list of ratios like [16/9, 4/3]")
    low, high = bitrate(_text(at("min_bitrate"))), bitrate(_text(at("max_bitrate")))
    for key, n in (("min_bitrate", low), ("max_bitrate", high)):
        say(video & has(key) & n.isNull(), key, F.concat(F.lit(f'{key} has invalid bitrate "'), F.coalesce(_text(at(key)), F.to_json(at(key)), F.lit("null")), F.lit('"')))
    say(video & (low > high), "min_bitrate", "min_bitrate must be less than or equal to max_bitrate")
    strategy = at("sample_strategy")
    form = F.coalesce(*(F.when(F.try_variant_get(strategy, f"$.{k}", "variant").isNotNull(), k) for k in ("scenes", "uniform")))
    say(video & has("sample_strategy") & form.isNull() & ~F.coalesce(_text(strategy) == "full", F.lit(False)), "sample_strategy", "sample_strategy must be full, scenes(count, duration) or uniform(count, duration)")
    inner = lambda name: F.coalesce(*(F.try_variant_get(strategy, f"$.{k}.{name}", "variant") for k in ("scenes", "uniform")))
    say(video & form.isNotNull() & _whole(inner("count")).isNull(), "sample_strategy", F.concat(form, F.lit(" sample_strategy requires integer count")))
    say(video & form.isNotNull() & _text(inner("duration")).isNull(), "sample_strategy", F.concat(form, F.lit(" sample_strategy requires duration")))
    block, crf = _kind(at("fallback")).startswith("OBJECT"), F.try_variant_get(at("fallback"), "$.crf", "variant")
    say(video & has("fallback") & ~block, "fallback", "fallback must be a nested block")
    say(video & block & _whole(crf).isNull(), "fallback", "fallback requires crf")
    say(video & block & (_whole(crf) > 51), "fallback", "fallback.crf must be from 0 to 51")
    say(video & block & _text(F.try_variant_get(at("fallback"), "$.preset", "variant")).isNull(), "fallback", "fallback requires preset")
    found += [F.when(video & has("target_vmaf"), x) for x in _vmaf(at("target_vmaf"), F.lit("target_vmaf"), "target_vmaf")]

    def of_key(k: Column, x: Column) -> Column:
        over = F.startswith(k, F.lit(OVERRIDE))
        long = F.length(k) > LONGEST
        rows = [
            F.when(long, _row("error", k, F.concat(F.lit('transcode setting key too long: "'), k, F.lit('"')))), F.when(~long & ~over & ~k.isin(KNOWN), _row("error", k, F.concat(F.lit('unknown transcode setting "'), k, F.lit('"')))),
            F.when((F.col("target") != "video") & (over | k.isin(VIDEO_ONLY)), _row("error", k, F.concat(k, F.lit(" is only valid for video transcodes, not "), F.col("target")))),
            F.when(video & over & ~F.startswith(k, F.lit(OVERRIDE + "content.")), _row("error", k, "target_vmaf_when requires a content.<type> path")),
        ]
        return F.array_compact(F.array(*rows, *(F.when(video & over, r) for r in _vmaf(x, k, "target_vmaf_when"))))

    keyed = F.flatten(F.transform(F.map_entries("m"), lambda e: of_key(e["key"], e["value"])))
    bad = F.filter(ratios, lambda x: ~F.coalesce(_text(x).rlike("^0*[1-9][0-9]*/0*[1-9][0-9]*$"), F.lit(False)))
    locked = F.transform(bad, lambda x: _row("error", "crop_aspect_lock", F.concat(F.lit('invalid crop_aspect_lock ratio "'), F.coalesce(_text(x), F.to_json(x), F.lit("null")), F.lit('", expected WIDTH/HEIGHT'))))
    none = F.array().cast(PROBLEM)
    every = F.concat(F.array_compact(F.array(*found)), F.coalesce(keyed, none), F.when(video, F.coalesce(locked, none)).otherwise(none))
    return df.select("rule", F.explode(every).alias("p")).select("rule", "p.*")
