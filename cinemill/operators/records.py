"""Whole records: child tables nested into their parents, and the differences of two sets of nested records."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = ("video", "audio", "subtitle", "attachment")
SCALARS = ("container", "duration", "bitrate", "content_hash", "size", "mtime")


def nested(parents: DataFrame, key: str, **children: tuple) -> DataFrame:
    """One row a parent with an array of structs for each child table, by the child's order column; no children give an empty array.

    children: name -> (table with the key, its order column), or (table, order column, condition, columns)
    for a part of a table; parts of one table are taken in one pass over it. All tables meet in one
    shuffle by key, as rows of one union, however many they are. Children without a parent are left out.
    """
    rows = parents.select(key, F.struct(*parents.columns).alias("_parent"))
    tables, columns = {}, {}
    for name, (df, order, *part) in children.items():
        where, columns[name] = part or (F.lit(True), [c for c in df.columns if c != key])
        tables.setdefault(id(df), (df, []))[1].append(F.when(where, F.struct(F.col(order).alias("_order"), *columns[name])).alias(name))
    for df, parts in tables.values():
        rows = rows.unionByName(df.select(key, *parts), allowMissingColumns=True)
    gathered = rows.groupBy(key).agg(F.max("_parent").alias("_parent"), *(F.array_sort(F.collect_list(n)).alias(n) for n in children))

    def plain(name: str, fields: list[str]) -> Column:
        return F.transform(name, lambda x: F.struct(*(x[c].alias(c) for c in fields))).alias(name)

    lists = [plain(n, fields) for n, fields in columns.items()]
    return gathered.where("_parent IS NOT NULL").select("_parent.*", *lists)


def parse_ignored(spec: str) -> tuple[set[str], dict[str, set[str]]]:
    """(fields, fields of tracks by bucket) from lines such as mtime or audio[].track_type; # begins a comment."""
    fields, inner = set(), {}
    for line in spec.splitlines():
        line = line.split("#", 1)[0].strip()
        if m := re.fullmatch(rf"({'|'.join(BUCKETS)})\[\]\.(\w+)", line):
            inner.setdefault(m[1], set()).add(m[2])
        elif line:
            fields.add(line)
    return fields, inner


def by_index(tracks: Column) -> Column:
    """map<index, track>; of tracks with one index the last."""
    tracks = F.coalesce(tracks, F.array())
    last = F.filter(tracks, lambda t, i: ~F.exists(F.slice(tracks, i + 2, F.size(tracks)), lambda u: u["index"] == t["index"]))
    return F.map_from_entries(F.transform(last, lambda t: F.struct(t["index"].alias("key"), t.alias("value"))))


def track_changes(left: Column, right: Column, fields: list[str]) -> Column:
    """Text of what differs between two arrays of tracks matched by index, in order of index and field; NULL if nothing.

    +#i(codec) is an added track, -#i(codec) a missing one, #i.field:a→b a changed field. Fields that
    one side does not have are no difference, nor is the order of the tracks.
    """

    def at(i: Column, a: Column, b: Column) -> Column:
        name = F.concat(F.lit("#"), i.cast("string"))
        codec = lambda t: F.concat(F.lit("("), F.coalesce(t["codec"], F.lit("?")), F.lit(")"))
        changed = [F.when(a[f] != b[f], F.concat(name, F.lit(f".{f}:"), a[f].cast("string"), F.lit("→"), b[f].cast("string"))) for f in sorted(fields)]
        same = F.array_compact(F.array(*changed)) if changed else F.array().cast("array<string>")
        return F.when(a.isNull(), F.array(F.concat(F.lit("+"), name, codec(b)))).when(b.isNull(), F.array(F.concat(F.lit("-"), name, codec(a)))).otherwise(same)

    parts = F.flatten(F.transform(F.array_sort(F.map_entries(F.map_zip_with(by_index(left), by_index(right), at))), lambda e: e["value"]))
    return F.nullif(F.array_join(parts, "; "), F.lit(""))


def record_changes(left: DataFrame, right: DataFrame, ignored: str = "", key: str = "path", tolerance: float = 0.005) -> DataFrame:
    """(key, side, field, details): records of one side only, and one row a scalar or bucket that differs.

    Durations within the tolerance are equal; values that one side lacks are no difference.
    """
    fields, inner = parse_ignored(ignored)
    scalars = [c for c in SCALARS if c in left.columns and c in right.columns and c not in fields]
    buckets = [b for b in BUCKETS if b in left.columns and b in right.columns and b not in fields]
    a = left.select(key, F.struct(*scalars, *buckets).alias("l"))
    b = right.select(key, F.struct(*scalars, *buckets).alias("r"))
    j = a.join(b, key, "full")
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    rows = [F.when(~both, F.struct(F.when(F.col("l").isNull(), "right-only").otherwise("left-only").alias("side"), F.lit("-").alias("field"), F.lit("-").alias("details")))]
    for c in scalars:
        x, y = F.col(f"l.{c}"), F.col(f"r.{c}")
        details = F.concat(x.cast("string"), F.lit(" → "), y.cast("string"))
        differ = x != y
        if c == "duration":
            differ = F.abs(x - y) > F.greatest(F.abs(x), F.abs(y)) * tolerance
            details = F.concat(details, F.format_string(" (%+.2f%%)", (y - x) / F.greatest(x, F.lit(1e-9)) * 100))
        rows.append(F.when(both & differ, F.struct(F.lit("both").alias("side"), F.lit(c).alias("field"), details.alias("details"))))
    for c in buckets:
        of = lambda df: {f.name for f in df.schema[c].dataType.elementType.fields}  # noqa: E731, B023
        shared = (of(left) & of(right)) - {"index"} - inner.get(c, set())
        j = j.withColumn(f"_{c}", F.when(both, track_changes(F.col(f"l.{c}"), F.col(f"r.{c}"), sorted(shared))))
        details = F.col(f"_{c}")
        rows.append(F.when(both & details.isNotNull(), F.struct(F.lit("both").alias("side"), F.lit(c).alias("field"), details.alias("details"))))
    # outer: the filter that an inner one brings along would make every comparison twice
    return j.select(key, F.explode_outer(F.array_compact(F.array(*rows))).alias("d")).where("d IS NOT NULL").select(key, "d.*")


def bucketed(tracks: DataFrame, key: str = "file_id") -> dict[str, tuple]:
    """Tracks as children for nested(): a part of their table a bucket, with the columns that its kind has."""
    common = ("codec", "language", "title", "is_default", "is_forced", "track_type")
    own = {
        "video": ("width", "height", "frame_rate", "is_vfr", "is_hdr", "hdr_format", "pixel_format"), "audio": ("channels", "channel_layout", "sample_rate", "bit_depth"), "subtitle": (), "attachment": (),
    }
    table = tracks.withColumnRenamed("stream_index", "index")
    return {name: (table, "index", F.startswith("track_type", F.lit(name)), ["index", *(c for c in (*common, *more) if c in tracks.columns)]) for name, more in own.items()}
