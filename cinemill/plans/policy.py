"""Policies as plain data, lowered to Columns over files with an array of tracks.

A track filter, a file condition and an operation are small dicts (or JSON); filter(), condition()
and actions() turn them into Columns, so Catalyst plans the whole policy as one projection. Logic is
two-valued: an atom over a missing value is false, and so its negation is true. Comparisons of
different types are false, != included.

Track filters: {"lang": [..]}, {"lang_not": x}, {"lang_field": path, "equal": bool}, {"codec": [..]}, {"codec_not": x},
{"channels": [op, n]}, {"commentary": 1}, {"forced": 1}, {"default": 1}, {"font": 1}, {"title_contains": s},
{"title_matches": re}, {"title_any": [..]}, {"all": [..]}, {"any": [..]}, {"not": f}.
Conditions: {"exists": kind, "where": f}, {"count": kind, "where": f, "is": [op, n]}, {"field": path, "is": [op, v]},
{"field": path, "in": [..]}, {"field": path, "exists": 1}, {"multi_language": 1}, {"dubbed": 1}, {"original": 1}, all/any/not.
Operations: container, keep, remove, order, defaults, clear, transcode, normalize, synthesize, clear_tags, set_tag, delete_tag,
when/then/else, rules, verify, skip, warn, fail.
"""

from __future__ import annotations

import bisect
import json
import operator
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinemill.functions.media import holds, stem
from cinemill.operators.catalogue import category, of

OPS = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
ACTION = "array<struct<op:string,track:int,value:string>>"
#: Layout of synthesised audio by preset (fixed values).
PRESETS = {"stereo": 2, "surround": 6, "7.1": 8}
#: Loudness by preset: target, true peak and the widest range (fixed values).
LOUDNESS = {
    "ebu_r128": (-23.0, -1.0, 18.0), "ebu_r128_broadcast": (-23.0, -1.0, 18.0), "streaming_movies": (-24.0, -2.0, None), "streaming_music": (-14.0, -1.0, None), "mobile": (-16.0, -1.5, None),
    "voice_focused": (-19.0, -1.0, 7.0),
}
#: Muxer names of containers (fixed values).
FORMATS = {"mkv": "matroska", "mp4": "mp4", "avi": "avi", "webm": "webm", "flv": "flv", "wmv": "asf", "mov": "mov", "ts": "mpegts"}
FILE_FIELDS = ("container", "size", "duration", "path", "filename")


def sure(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def combine(spec: dict, lower) -> Column | None:
    """all, any and not over any kind of atom."""
    if "all" in spec:
        return reduce(operator.and_, map(lower, spec["all"]), F.lit(True))
    if "any" in spec:
        return reduce(operator.or_, map(lower, spec["any"]), F.lit(False))
    if "not" in spec:
        return ~lower(spec["not"])
    return None


def number(op: str, x: Column, n: float) -> Column:
    """Comparison of numbers, equality within an epsilon."""
    if op in ("==", "!="):
        near = F.abs(x - n) < 2.3e-16
        return sure(near if op == "==" else ~near)
    return sure(OPS[op](x, n))


def track_filter(spec: dict | None):
    """A track filter as a function of the track struct."""
    if not spec:
        return lambda t: F.lit(True)

    def lower(t: Column, s: dict) -> Column:
        both = combine(s, lambda part: lower(t, part))
        if both is not None:
            return both
        title = F.lower(F.coalesce(t["title"], F.lit("")))
        (name, value), *_ = s.items()
        if name == "lang":
            return sure(t["language"].isin(value))
        if name == "lang_not":
            return sure(t["language"] != value)
        if name in ("lang_field", "codec_field"):
            same = t["language" if name == "lang_field" else "codec"] == field(value).cast("string")
            return sure(same if s.get("equal", True) else ~same)
        if name == "codec":
            return sure(t["codec"].isin(value))
        if name == "codec_not":
            return sure(t["codec"] != value)
        if name == "channels":
            return number(value[0], t["channels"], value[1])
        if name == "commentary":
            return sure(t["track_type"].isin("audio_commentary", "subtitle_commentary"))
        if name in ("forced", "default"):
            return sure(t[f"is_{name}"])
        if name == "font":
            codec = F.lower(t["codec"])
            kind = reduce(operator.or_, [F.contains(codec, F.lit(x)) for x in ("font", "ttf", "otf")])
            return sure((t["track_type"] == "attachment") & (kind | F.rlike(title, F.lit(r"\.(ttf|otf|woff)$"))))
        if name == "title_contains":
            return sure(F.contains(title, F.lit(value.lower())))
        if name == "title_matches":
            return sure(F.rlike(t["title"], F.lit(value)))
        if name == "title_any":
            return reduce(operator.or_, [sure(F.contains(title, F.lit(x.lower()))) for x in value], F.lit(False))
        raise ValueError(f"no such track filter: {name}")

    return lambda t: lower(t, spec)


def selected(kind: str, spec: dict | None = None) -> Column:
    """The tracks of a kind (video, audio, subtitle, attachment, any) that a filter takes."""
    f = track_filter(spec)
    return F.filter("tracks", lambda t: f(t) if kind == "any" else (category(t["track_type"]) == kind) & f(t))


def field(path: str) -> Column:
    """video.*, audio.* (the first such track), file.*, tag.*, plugin.<name>.<path>, system.<key> (of a map column) and
    phase.<name>.outcome|completed|modified (of a phase evaluated before)."""
    root, _, rest = path.partition(".")
    if root in ("video", "audio"):
        return F.try_element_at(of(F.col("tracks"), root), F.lit(1))[rest]
    if root == "file":  # other names are the file's tags
        return F.col(rest) if rest in FILE_FIELDS else F.try_element_at(F.col("tags"), F.lit(rest))
    if root == "tag":
        return F.try_element_at(F.col("tags"), F.lit(rest))
    if root == "plugin":
        name, _, inner = rest.partition(".")
        return F.expr(f"try_variant_get(plugin_metadata['{name}'], '$.{inner}', 'string')")
    if root == "system":
        return F.try_element_at(F.col("system"), F.lit(rest))
    if root == "phase":
        name, _, what = rest.partition(".")
        state = F.col(f"_st_{name}")
        made = {"outcome": state, "completed": state != "skipped", "modified": state == "pending"}
        return F.size(f"_warn_{name}") if what == "warning_count" else F.size(f"_bad_{name}") if what == "error_count" else made[what]
    raise ValueError(f"no such field: {path}")


def printed(x: Column, kind: str) -> Column:
    """A value as text: texts as they are, others as JSON prints them."""
    if kind == "string":
        return x
    if kind.startswith(("array", "map", "struct", "variant")):
        return F.to_json(x)
    if kind in ("double", "float"):  # whole numbers keep one decimal, none an exponent within 1e16
        whole = F.concat(x.cast("decimal(38,0)").cast("string"), F.lit(".0"))
        return F.when((x == F.floor(x)) & (F.abs(x) < 1e16), whole).otherwise(x.cast("string"))
    return x.cast("string")


def audio_languages() -> Column:
    return F.array_distinct(F.filter(F.transform(of(F.col("tracks"), "audio"), lambda t: t["language"]), lambda x: x != "und"))


def condition(spec: dict, df: DataFrame) -> Column:
    """A file condition; df gives the fields' types."""
    lower = lambda s: condition(s, df)
    both = combine(spec, lower)
    if both is not None:
        return both
    if "count" in spec:
        return number(spec["is"][0], F.size(selected(spec["count"], spec.get("where"))), spec["is"][1])
    if "field" in spec:
        x = field(spec["field"])
        kind = df.select(x.alias("x")).dtypes[0][1]
        if "in" in spec:
            return sure(x.isin(spec["in"]))
        if "is" in spec:
            op, value = spec["is"]
            if isinstance(value, bool):
                return sure(OPS[op](x, value)) if kind == "boolean" and op in ("==", "!=") else F.lit(False)
            if isinstance(value, str):
                return sure(OPS[op](x, value)) if kind == "string" else F.lit(False)
            return number(op, x, value) if kind not in ("string", "boolean") else F.lit(False)
        return x.isNotNull()
    if "exists" in spec:
        return F.size(selected(spec["exists"], spec.get("where"))) > 0
    many = F.size(audio_languages()) > 1
    if "multi_language" in spec:
        return many
    if "dubbed" in spec:
        return many & (F.size(selected("subtitle")) > 0)
    if "original" in spec:
        return ~many
    raise ValueError(f"no such condition: {spec}")


def act(op: str, track=None, value=None) -> Column:
    return F.struct(F.lit(op).alias("op"), (F.lit(None) if track is None else track).cast("int").alias("track"), (F.lit(None) if value is None else F.lit(value)).cast("string").alias("value"))


def none() -> Column:
    return F.array().cast(ACTION)


def _each(tracks: Column, op: str, value=None) -> Column:
    return F.transform(tracks, lambda t: act(op, t["stream_index"], value))


def operation(spec: dict, df: DataFrame) -> Column:
    """The actions of one operation, in order."""
    (name, arg), *_ = spec.items()
    where = spec.get("where")
    if name == "container":
        return F.when(F.col("container") != arg, F.array(act("convert_container", None, arg))).otherwise(none())
    if name == "keep":  # keeping nothing takes the removals back
        f = track_filter(where)
        gone = F.filter("tracks", lambda t: (F.lit(True) if arg == "any" else category(t["track_type"]) == arg) & ~f(t))
        return F.when(F.size(selected(arg, where)) > 0, _each(gone, "remove_track")).otherwise(none())
    if name == "remove":  # removing every video or audio track takes the removals back
        hit = selected(arg, where)
        all_gone = (F.size(hit) == F.size(selected(arg))) & F.lit(arg in ("video", "audio"))
        return F.when(all_gone, none()).otherwise(_each(hit, "remove_track"))
    if name == "order":
        return F.array(act("reorder_tracks", None, ",".join(arg)))
    if name == "defaults":
        kind, tracks = spec["of"], selected(spec["of"])
        if arg == "none":
            return _each(F.filter(tracks, lambda t: t["is_default"]), "clear_default")
        first = F.transform(tracks, lambda t: t["language"])
        wanted = {"all": lambda t, i: F.lit(True), "first": lambda t, i: i == 0, "first_per_language": lambda t, i: F.array_position(first, t["language"]) == i + 1}[arg]
        marked = F.transform(tracks, lambda t, i: F.when(wanted(t, i) & ~t["is_default"], act("set_default", t["stream_index"], kind)).when(~wanted(t, i) & t["is_default"], act("clear_default", t["stream_index"], kind)))
        return F.array_compact(marked)
    if name == "clear":
        flags = {"default": ("clear_default", lambda t: t["is_default"]), "forced": ("clear_forced", lambda t: t["is_forced"]), "title": ("set_title", lambda t: t["title"] != "")}
        per = F.transform(selected(spec["of"]), lambda t: F.array_compact(F.array(*(F.when(flags[k][1](t), act(flags[k][0], t["stream_index"])) for k in arg))))
        return F.flatten(per)
    if name == "transcode":
        keep = [arg, *spec.get("preserve", [])]
        made = _each(F.filter(selected(spec["of"], where), lambda t: ~t["codec"].isin(keep)), f"transcode_{spec['of']}", json.dumps({"codec": arg} | spec.get("settings", {}), sort_keys=True))
        if spec.get("hw", "auto") in ("auto", "none") or spec.get("hw_fallback", True):
            return made
        there = F.array_contains(F.split(F.try_element_at(F.col("system"), F.lit("hwaccels")), ","), spec["hw"]) if "system" in df.columns else F.lit(False)
        return F.when(sure(there), made).otherwise(F.array(act("drop_phase", None, f"hw backend '{spec['hw']}' unavailable and hw_fallback is false")))
    if name == "normalize" and isinstance(arg, dict):  # the other tracks go first, as keep has it
        target, peak, spread = LOUDNESS[arg["preset"]]
        want = {"preset": arg["preset"], "target_lufs": arg.get("target", target), "true_peak_db": peak, "lra_max": spread, "tolerance_lufs": arg.get("tolerance", 0.5)}
        off = F.filter(selected("audio", where), lambda t: t["lufs"].isNull() | (F.abs(t["lufs"] - want["target_lufs"]) > want["tolerance_lufs"]))
        made = F.transform(off, lambda t: F.struct(F.lit("transcode_audio").alias("op"), t["stream_index"].cast("int").alias("track"), F.concat(F.lit('{"codec": "'), t["codec"], F.lit('", "loudness": ' + json.dumps(want, sort_keys=True) + "}")).alias("value")))
        return F.concat(operation({"keep": "audio", "where": where}, df), made)
    if name == "normalize":
        target, tolerance = arg
        return _each(F.filter(selected("audio", where), lambda t: t["lufs"].isNull() | (F.abs(t["lufs"] - target) > tolerance)), "normalize_audio", str(target))
    if name == "synthesize":
        source = F.try_element_at(selected("audio", where), F.lit(1))
        gate = condition(spec["if"], df) if "if" in spec else F.lit(True)
        there = F.size(selected("audio", spec["skip_if"])) > 0 if "skip_if" in spec else F.lit(False)
        lang = F.lit(spec["language"]) if "language" in spec else source["language"]
        made = F.struct(F.lit("synthesize_audio").alias("op"), source["stream_index"].cast("int").alias("track"), F.concat_ws("/", F.lit(arg), F.lit(str(PRESETS[spec["preset"]])), lang).alias("value"))
        return F.when(gate & ~there & source.isNotNull(), F.array(made)).otherwise(none())
    if name == "clear_tags":
        return F.transform(F.array_sort(F.map_keys("tags")), lambda k: F.struct(F.lit("delete_tag").alias("op"), F.lit(None).cast("int").alias("track"), k.alias("value")))
    if name == "set_tag":
        text = printed(field(spec["field"]), df.select(field(spec["field"])).dtypes[0][1]) if "field" in spec else template(spec["value"])
        made = lambda x: F.struct(F.when(x.isNull(), "fail").otherwise("set_tag").alias("op"), F.lit(None).cast("int").alias("track"), F.concat(F.lit(arg + "="), F.coalesce(x, F.lit("?"))).alias("value"))
        return F.transform(F.array(text), made)
    if name == "delete_tag":
        return F.when(F.map_contains_key("tags", arg), F.array(act("delete_tag", None, arg))).otherwise(none())
    if name == "when":
        return F.when(condition(arg, df), sequence(spec.get("then", []), df)).otherwise(sequence(spec.get("else", []), df))
    if name == "rules":  # a rule that does not match runs its else part; mode first stops after a match
        parts, matched = [], F.lit(False)
        for rule in arg:
            hit = condition(rule["when"], df)
            part = F.when(hit, sequence(rule.get("then", []), df)).otherwise(sequence(rule.get("else", []), df))
            parts.append(F.when(matched, none()).otherwise(part) if spec.get("mode") == "first" else part)
            matched = matched | hit
        return F.flatten(F.array(*parts)) if parts else none()
    if name == "verify":
        return F.array(act("verify", None, arg))
    if name in ("skip", "warn", "fail"):
        return F.array(F.struct(F.lit(name).alias("op"), F.lit(None).cast("int").alias("track"), template(arg).alias("value")))
    if name in ("set_default", "set_forced", "set_language"):
        return _each(selected(spec["of"], where), name, None if arg is True else arg)
    raise ValueError(f"no such operation: {name}")


def template(text: str) -> Column:
    """{filename} (without extension) and {path} in a message."""
    return F.replace(F.replace(F.lit(text), F.lit("{filename}"), stem(F.col("path"))), F.lit("{path}"), F.col("path"))


def sequence(specs: list[dict], df: DataFrame) -> Column:
    return F.flatten(F.array(*(operation(s, df) for s in specs))) if specs else none()


STRATEGIES = {"abort": "aborting", "quarantine": "aborting", "continue": "continuing", "skip": "skipping phase"}


def halted(actions: Column, strategy: str) -> Column:
    """Actions up to the first failure, or all with strategy continue; the failure stays as one that warns, or skips the phase.

    quarantine stops the phase as abort does (setting the file aside is the caller's work).
    """
    told = lambda a: F.concat(F.lit(f"Error ({STRATEGIES[strategy]}): "), F.coalesce(a["value"], F.lit("")))
    changed = F.transform(actions, lambda a: F.when(a["op"] == "fail", a.withField("op", F.lit("skip" if strategy == "skip" else "warn")).withField("value", told(a))).otherwise(a))
    if strategy == "continue":
        return changed
    at = F.array_position(F.transform(actions, lambda a: a["op"]), "fail")
    return F.when(at > 0, F.slice(changed, F.lit(1), F.greatest(at, F.lit(1)).cast("int"))).otherwise(actions)


def lost_kinds(actions: Column) -> Column:
    """video and audio, as far as removals together would take every such track."""
    found = []
    for kind in ("video", "audio"):
        own = F.transform(of(F.col("tracks"), kind), lambda t: t["stream_index"].cast("int"))
        gone = F.transform(F.filter(actions, lambda a: a["op"] == "remove_track"), lambda a: a["track"])
        found.append(F.when((F.size(own) > 0) & (F.size(F.array_except(own, gone)) == 0), kind))
    return F.array_compact(F.array(*found))


def safeguarded(actions: Column) -> Column:
    """Without removals that together take every video or audio track."""
    for kind in ("video", "audio"):
        own = F.transform(of(F.col("tracks"), kind), lambda t: t["stream_index"].cast("int"))
        gone = F.transform(F.filter(actions, lambda a: a["op"] == "remove_track"), lambda a: a["track"])
        lost = (F.size(own) > 0) & (F.size(F.array_except(own, gone)) == 0)
        actions = F.when(lost, F.filter(actions, lambda a: ~((a["op"] == "remove_track") & F.array_contains(own, a["track"])))).otherwise(actions)
    return actions


def conversion(actions: Column) -> Column:
    """The container that actions convert to, NULL if none."""
    return F.try_element_at(F.filter(actions, lambda a: a["op"] == "convert_container"), F.lit(1))["value"]


def offenders(target: Column, actions: Column) -> Column:
    """Tracks that stay, by what transcodes make of them, and synthesised ones, that a container cannot hold: track i (codec), ..."""
    removed = F.transform(F.filter(actions, lambda a: a["op"] == "remove_track"), lambda a: a["track"])
    cannot = lambda codec: F.coalesce(~holds(target, codec), F.lit(False))

    def codec(t: Column) -> Column:
        made = F.filter(actions, lambda a: a["op"].isin("transcode_video", "transcode_audio") & (a["track"] == t["stream_index"]))
        return F.coalesce(F.get_json_object(F.try_element_at(made, F.lit(-1))["value"], "$.codec"), t["codec"])

    left = F.filter("tracks", lambda t: ~F.array_contains(removed, t["stream_index"].cast("int")))
    kept = F.filter(F.transform(left, lambda t: F.struct(t["stream_index"].alias("i"), codec(t).alias("codec"))), lambda t: cannot(t["codec"]))
    made = F.transform(F.filter(actions, lambda a: a["op"] == "synthesize_audio"), lambda a: F.split_part(a["value"], F.lit("/"), F.lit(1)))
    return F.concat(
        F.transform(kept, lambda t: F.concat(F.lit("track "), t["i"].cast("string"), F.lit(" ("), t["codec"], F.lit(")"))),
        F.transform(F.filter(made, cannot), lambda c: F.concat(F.lit("synthesized ("), c, F.lit(")"))),
    )


VIOLATION = "array<struct<kind:string,message:string>>"


def violations(lost: Column, target: Column, unheld: Column) -> Column:
    """array<struct<kind, message>> of what the safeguards took back: removals of a kind, a conversion."""
    name = F.element_at(F.split("path", "/"), -1)
    removals = F.transform(lost, lambda k: F.struct(F.concat(F.lit("no_"), k, F.lit("_track")).alias("kind"), F.concat(F.lit("Safeguard: would have removed all "), k, F.lit(" tracks in "), name, F.lit(", keeping them instead")).alias("message")))
    some = F.array_join(F.slice(unheld, 1, 4), ", ")
    more = F.when(F.size(unheld) > 4, F.concat(F.lit(" and "), (F.size(unheld) - 4).cast("string"), F.lit(" more"))).otherwise("")
    text = F.concat(F.lit("Safeguard: container conversion from "), F.col("container"), F.lit(" to "), target, F.lit(" would leave incompatible codecs in "), name, F.lit(": "), some, more, F.lit("; keeping original container"))
    return F.concat(removals, F.when(F.size(unheld) > 0, F.array(F.struct(F.lit("container_incompatible").alias("kind"), text.alias("message")))).otherwise(F.array().cast(VIOLATION)))


def unfit(target: Column, actions: Column) -> Column:
    """Codecs of surviving, untranscoded tracks that a container cannot hold."""
    touched = F.transform(F.filter(actions, lambda a: a["op"].isin("remove_track", "transcode_video", "transcode_audio")), lambda a: a["track"])
    left = F.filter("tracks", lambda t: ~F.array_contains(touched, t["stream_index"].cast("int")) & (category(t["track_type"]) != "attachment"))
    return F.array_sort(F.array_distinct(F.transform(F.filter(left, lambda t: ~F.coalesce(holds(target, t["codec"]), F.lit(True))), lambda t: t["codec"])))


def capability_hints(actions: Column, encoders: dict[str, list[str]]) -> Column:
    """Warnings about transcodes: no executor has the encoder, or one only. encoders: codec -> executors."""
    wanted = F.filter(actions, lambda a: a["op"].startswith("transcode_"))
    codec = lambda a: F.get_json_object(a["value"], "$.codec")
    known = F.create_map(*(x for k, v in encoders.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))))
    def text(a: Column) -> Column:
        who = F.coalesce(F.try_element_at(known, codec(a)), F.array().cast("array<string>"))
        return F.when(F.size(who) == 0, F.concat(F.lit("no encoder for "), codec(a))).when(F.size(who) == 1, F.concat(F.lit("only "), who[0], F.lit(" encodes "), codec(a)))
    return F.array_distinct(F.array_compact(F.transform(wanted, text)))


def capabilities(actions: Column, encoders: dict[str, list[str]], formats: list[str]) -> Column:
    """struct<warnings, executor>: encoders and formats that no executor has, and the executor if only one has all encoders.

    encoders: codec -> executors; without any encoder or format nothing is known and nothing said.
    """
    if not encoders and not formats:
        return F.struct(F.array().cast("array<string>").alias("warnings"), F.lit(None).cast("string").alias("executor"))
    has = F.create_map(*(x for k, v in ({"": []} | encoders).items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))))
    muxer = F.create_map(*(F.lit(x) for pair in FORMATS.items() for x in pair))
    codec = lambda a: F.when(a["op"].startswith("transcode_"), F.get_json_object(a["value"], "$.codec")).when(a["op"] == "synthesize_audio", F.split_part(a["value"], F.lit("/"), F.lit(1)))
    who = lambda c: F.coalesce(F.try_element_at(has, c), F.array().cast("array<string>"))

    def text(a: Column) -> Column:
        made = F.coalesce(F.try_element_at(muxer, a["value"]), a["value"])
        unheld = F.when((a["op"] == "convert_container") & ~made.isin(formats), F.concat(F.lit("No executor supports format '"), made, F.lit("'")))
        return F.coalesce(unheld, F.when(F.size(who(codec(a))) == 0, F.concat(F.lit("No executor supports encoder '"), codec(a), F.lit("'"))))

    codecs = F.array_compact(F.transform(actions, codec))
    every = F.array(*map(F.lit, sorted({x for v in encoders.values() for x in v}))).cast("array<string>")
    able = F.filter(every, lambda e: F.forall(codecs, lambda c: F.array_contains(who(c), e)))
    warnings = F.array_compact(F.transform(actions, text))
    return F.struct(warnings.alias("warnings"), F.when((F.size(codecs) > 0) & (F.size(able) == 1), F.element_at(able, 1)).alias("executor"))


def may(specs, *names: str) -> bool:
    """Whether an operation of one of these names is among specs, at any depth."""
    if isinstance(specs, dict):
        return any(n in specs for n in names) or may(list(specs.values()), *names)
    return isinstance(specs, (list, tuple)) and any(may(s, *names) for s in specs)


def evaluate(df: DataFrame, policy: dict) -> DataFrame:
    """(id, phase, status, reason, actions, warnings, violations): a policy's phases over every file, in dependency order.

    policy: {"phases": [{"name", "skip_when"?, "run_if"? [phase, modified|completed], "depends_on"? [..], "on_error"?, "operations": [..]}]}.
    A phase is Skipped by its condition, an unmet run_if, a skip action, a transcode whose hardware is missing (which
    also drops the actions before it) or an error under strategy skip; else Completed
    without actions, Pending with. Safeguards take back removals of all video or audio tracks, and a
    conversion to a container that cannot hold what would be in it; each is a violation and a warning.
    Each phase's actions are columns of their own, so no expression repeats another, and a safeguard is
    planned only for phases with operations that it could take back.
    """
    phases = ordered(policy["phases"])
    keep = df
    for p in phases:
        n = p["name"]
        reason = F.when(condition(p["skip_when"], keep), "skip_when") if "skip_when" in p else F.lit(None).cast("string")
        if "run_if" in p:
            other, state = p["run_if"]
            met = F.col(f"_st_{other}") == "pending" if state == "modified" else F.col(f"_st_{other}") != "skipped"
            reason = F.coalesce(reason, F.when(~met, "run_if"))
        keep = keep.withColumn(f"_why_{n}", reason)
        ops, empty = p["operations"], F.array().cast("array<string>")
        keep = keep.withColumn(f"_do_{n}", F.when(F.col(f"_why_{n}").isNull(), sequence(ops, keep)).otherwise(none()))
        keep = keep.withColumn(f"_raw_{n}", halted(F.col(f"_do_{n}"), p.get("on_error", "abort")) if may(ops, "fail", "set_tag") else F.col(f"_do_{n}"))
        if may(ops, "transcode"):
            dropped = F.filter(F.transform(f"_raw_{n}", lambda a, i: F.struct((a["op"] == "drop_phase").alias("hit"), (i + 1).alias("at"), a["value"].alias("value"))), lambda x: x["hit"])
            keep = keep.withColumn(f"_gone_{n}", F.try_element_at(dropped, F.lit(-1)))
            last = F.col(f"_gone_{n}.at")
            keep = keep.withColumn(f"_raw_{n}", F.when(last.isNull(), F.col(f"_raw_{n}")).otherwise(F.slice(f"_raw_{n}", F.coalesce(last, F.lit(0)) + 1, F.size(f"_raw_{n}"))))
            keep = keep.withColumn(f"_why_{n}", F.coalesce(f"_why_{n}", f"_gone_{n}.value"))
        keep = keep.withColumn(f"_why_{n}", F.coalesce(f"_why_{n}", F.try_element_at(F.filter(f"_raw_{n}", lambda a: a["op"] == "skip"), F.lit(1))["value"]))
        ran, raw = F.col(f"_why_{n}").isNull(), F.col(f"_raw_{n}")
        removes, converts = may(ops, "keep", "remove", "normalize"), may(ops, "container")
        keep = keep.withColumn(f"_safe_{n}", F.filter(F.when(ran, safeguarded(raw)).otherwise(raw) if removes else raw, lambda a: ~a["op"].isin("skip", "warn")))
        safe, to, off = F.col(f"_safe_{n}"), F.col(f"_to_{n}"), F.col(f"_off_{n}")
        keep = keep.withColumns({f"_to_{n}": conversion(safe) if converts else F.lit(None).cast("string"), f"_lost_{n}": F.when(ran, lost_kinds(raw)).otherwise(empty) if removes else empty})
        keep = keep.withColumn(f"_off_{n}", F.when(ran & to.isNotNull(), offenders(to, safe)).otherwise(empty) if converts else empty)
        keep = keep.withColumn(f"_act_{n}", F.when(F.size(off) == 0, safe).otherwise(F.filter(safe, lambda a: a["op"] != "convert_container")) if converts else safe)
        keep = keep.withColumn(f"_bad_{n}", violations(F.col(f"_lost_{n}"), to, off) if removes or converts else F.array().cast(VIOLATION))
        said = F.transform(F.filter(raw, lambda a: a["op"] == "warn"), lambda a: a["value"])
        keep = keep.withColumn(f"_warn_{n}", F.concat(said, F.transform(f"_bad_{n}", lambda v: v["message"])))
        keep = keep.withColumn(f"_st_{n}", F.when(~ran, "skipped").when(F.size(f"_act_{n}") == 0, "completed").otherwise("pending"))
    shown = {"status": "st", "reason": "why", "actions": "act", "warnings": "warn", "violations": "bad"}
    rows = F.array(*(F.struct(F.lit(p["name"]).alias("phase"), *(F.col(f"_{v}_{p['name']}").alias(k) for k, v in shown.items())) for p in phases))
    return keep.select("id", F.explode(rows).alias("r")).select("id", "r.*")


def ordered(phases: list[dict]) -> list[dict]:
    """Phases after those they depend on, or whose fields their conditions read; a cycle or an unknown name is an error.

    Of the phases ready at first the last by name comes first; phases that become ready later wait in
    reverse order of name before those already waiting, and the end of the line is served.
    """
    by_name = {p["name"]: p for p in phases}
    if len(by_name) < len(phases):
        raise ValueError("two phases of one name")
    needs = {}
    for p in phases:
        read = re.findall(r'"phase\.([^."]+)\.', json.dumps([p.get("skip_when"), p.get("operations")]))
        on = [*p.get("depends_on", []), *([p["run_if"][0]] if "run_if" in p else []), *(n for n in read if n in by_name and n != p["name"])]
        needs[p["name"]] = list(dict.fromkeys(on))
    if unknown := sorted(n for n, on in needs.items() if set(on) - set(by_name)):
        raise ValueError("phases depend on no phase: " + ", ".join(unknown))
    line, out = sorted(n for n, on in needs.items() if not on), []
    while line:
        name = line.pop()
        out.append(by_name[name])
        for p in phases:
            if name in needs[p["name"]]:
                needs[p["name"]] = [n for n in needs[p["name"]] if n != name]
                if not needs[p["name"]]:
                    line.insert(bisect.bisect_left(line, True, key=lambda x, n=p["name"]: x <= n), p["name"])
    if len(out) < len(phases):
        raise ValueError("phases depend on each other: " + ", ".join(sorted(n for n, on in needs.items() if on)))
    return out


def extended(base: dict, policy: dict) -> dict:
    """A policy over the one it extends: its phases replace those of the same name (or add operations to them,
    where a phase says extend), others are added; metadata is merged key by key, the configuration replaced."""
    own = {p["name"]: p for p in policy.get("phases", [])}
    phases = []
    for p in base.get("phases", []):
        mine = own.pop(p["name"], p)
        if mine.get("extend"):
            mine = p | {k: v for k, v in mine.items() if k != "extend"} | {"operations": p.get("operations", []) + mine.get("operations", [])}
        phases.append(mine)
    out = base | policy | {"phases": phases + list(own.values())}
    if "metadata" in base or "metadata" in policy:
        out["metadata"] = base.get("metadata", {}) | policy.get("metadata", {})
    return out


def resolved(name: str, policies: dict[str, dict], above: tuple[str, ...] = ()) -> dict:
    """A policy with all it extends, looked up by name; extending itself, or what is not there, is an error."""
    if name in above:
        raise ValueError("policies extend each other: " + " -> ".join((*above, name)))
    if name not in policies:
        raise ValueError(f"no such policy: {name}")
    policy = policies[name]
    if "extends" not in policy:
        return policy
    return extended(resolved(policy["extends"], policies, (*above, name)), {k: v for k, v in policy.items() if k != "extends"})


def policy_for(path: Column, roots: dict[str, str | None], default: str | None) -> Column:
    """Name of the policy of the longest root above a path; NULL is skipped."""
    out = F.lit(default)
    for root, name in sorted(roots.items(), key=lambda r: len(r[0])):
        out = F.when((path == root) | path.startswith(root.rstrip("/") + "/"), F.lit(name)).otherwise(out)
    return out


def differences(a, b, path: str = "") -> list[tuple[str, str]]:
    """(path, added | removed | changed) between two plain-data documents; named list entries compare by name."""
    if isinstance(a, dict) and isinstance(b, dict):
        out = []
        for k in sorted(set(a) | set(b)):
            at = f"{path}.{k}" if path else k
            out += [(at, "added")] if k not in a else [(at, "removed")] if k not in b else differences(a[k], b[k], at)
        return out
    if isinstance(a, list) and isinstance(b, list) and all(isinstance(x, dict) and "name" in x for x in a + b):
        return differences({x["name"]: x for x in a}, {x["name"]: x for x in b}, path)
    return [] if a == b else [(path, "changed")]
