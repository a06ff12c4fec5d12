"""Catalogue reads: filters, pages, lookups, distributions and per-file summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinemill.functions.media import layout_name, resolution_tier

MAX_LIMIT, MAX_OFFSET, MAX_FILTER = 10_000, 1_000_000, 256


def matching(df: DataFrame, **equal) -> DataFrame:
    """Rows equal in every given column; None leaves a column open."""
    for column, value in equal.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


def page(df: DataFrame, order: list[Column], limit: int = MAX_LIMIT, offset: int = 0) -> DataFrame:
    """One page of a totally ordered table; limit and offset are clamped."""
    return df.orderBy(*order).offset(max(0, min(offset, MAX_OFFSET))).limit(max(0, min(limit, MAX_LIMIT)))


def after(df: DataFrame, key: str, last, limit: int) -> DataFrame:
    """The page that follows a key value."""
    return df.where(F.col(key) > F.lit(last)).orderBy(key).limit(limit)


def under(path: Column, root: str) -> Column:
    """Whether a path is the root or lies beneath it, by whole components."""
    root = root.rstrip("/")
    return (path == root) | path.startswith(root + "/")


def list_files(files: DataFrame, tracks: DataFrame, status=None, container=None, prefix=None, codec=None, language=None) -> DataFrame:
    """Files by status, container and raw path prefix; codec and language must hold on one and the same track."""
    df = matching(files, status=status, container=container)
    if prefix is not None:
        df = df.where(F.col("path").startswith(prefix[:MAX_FILTER]))
    if codec is not None or language is not None:
        df = df.join(matching(tracks, codec=codec, language=language).select(F.col("file_id").alias("id")), "id", "left_semi")
    return df


def event_type_matches(kind: Column, pattern: str) -> Column:
    """Event kinds by exact name, everything (*) or a dotted group (a.*)."""
    if pattern == "*":
        return F.lit(True)
    return kind.startswith(pattern[:-1]) if pattern.endswith(".*") else kind == pattern


def resolution(width: Column) -> Column:
    return F.when(width >= 7680, "8K").when(width >= 3840, "4K").when(width >= 1920, "1080p").when(width >= 1280, "720p").otherwise("SD")


def frame_rate_label(rate: Column) -> Column:
    """The first common rate within a tenth; order matters (23.976 before 24)."""
    out = None
    for value, label in ((23.976, "23.976"), (24.0, "24"), (25.0, "25"), (29.97, "29.97"), (30.0, "30"), (50.0, "50"), (59.94, "59.94"), (60.0, "60")):
        near = F.abs(rate - value) < 0.1
        out = F.when(near, label) if out is None else out.when(near, label)
    return out.otherwise(F.round(rate).cast("int").cast("string"))


def distribution(df: DataFrame, key: Column, unknown: str | None = None) -> DataFrame:
    """(key, n), largest first. NULL is labelled after grouping, so it stays apart from a literal of that name."""
    out = df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("key", F.coalesce("key", F.lit(unknown))) if unknown is not None else out


def distributions(df: DataFrame, **dims: Column) -> DataFrame:
    """(dim, key, n) of many columns in one pass: one exploded pair per dimension, one aggregation."""
    pairs = F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), c.cast("string").alias("key")) for d, c in dims.items())))
    return df.select(pairs.alias("p")).groupBy("p.dim", "p.key").agg(F.count(F.lit(1)).alias("n"))


def file_totals(files: DataFrame) -> DataFrame:
    n, size = F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))
    return files.agg(
        n.alias("total_files"), size.alias("total_size"), F.coalesce((size / F.nullif(n, F.lit(0))).cast("long"), F.lit(0)).alias("avg_size"),
        F.coalesce(F.max("size"), F.lit(0)).alias("max_size"), F.coalesce(F.min("size"), F.lit(0)).alias("min_size"),
    )


def row_counts(**tables: DataFrame) -> DataFrame:
    """(name, n) of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def category(kind: Column) -> Column:
    return F.when(kind == "video", "video").when(kind.startswith("audio"), "audio").when(kind.startswith("subtitle"), "subtitle").when(kind == "attachment", "attachment").otherwise("other")


def of(tracks: Column, kind: str) -> Column:
    return F.filter(tracks, lambda t: category(t["track_type"]) == kind)


def snapshot(files: DataFrame) -> DataFrame:
    """Per file: track counts, sorted distinct codecs, first resolution, compact summary (\"1v 2a 3s\")."""
    n = {k: F.size(of(F.col("tracks"), k)) for k in ("video", "audio", "subtitle")}
    codecs = lambda k: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(of(F.col("tracks"), k), lambda t: t["codec"]))))
    part = lambda k, s: F.when(n[k] > 0, F.concat(n[k].cast("string"), F.lit(s)))
    return files.select(
        "id", n["video"].alias("n_video"), n["audio"].alias("n_audio"), n["subtitle"].alias("n_subtitle"), codecs("video").alias("video_codecs"), codecs("audio").alias("audio_codecs"),
        F.try_element_at(of(F.col("tracks"), "video"), F.lit(1))["width"].alias("width"), F.when(F.col("duration") > 0, F.col("duration")).alias("duration"),
        F.concat_ws(" ", part("video", "v"), part("audio", "a"), part("subtitle", "s")).alias("summary"),
    )


def corpus_features(files: DataFrame) -> DataFrame:
    """(id, size, feature): what a file with nested tracks would add to a test corpus; files without tracks add nothing."""
    tracks = F.col("tracks")
    kind = lambda t: category(t["track_type"])
    some = lambda name, x: F.when(x.isNotNull(), F.concat(F.lit(f"{name}:"), x))
    codec = lambda t: F.lower(F.coalesce(t["codec"], F.lit("unknown")))
    size = lambda t: resolution_tier(t["width"], (t["width"] * 9 / 16).cast("int") if "height" not in _fields(files) else t["height"])

    def own(t: Column) -> Column:
        video = F.array(
            some("video_codec", codec(t)), some("resolution", size(t)), some("hdr", F.when(t["is_hdr"], F.lower(F.coalesce(t["hdr_format"], F.lit("generic")))).otherwise("none")),
            some("framerate", F.when(t["is_vfr"], "vfr").otherwise("cfr")),
        )
        audio = F.array(some("audio_codec", codec(t)), some("audio_channels", F.when(t["channels"].isNotNull(), layout_name(t["channels"]))))
        of_kind = F.when(kind(t) == "video", video).when(kind(t) == "audio", audio).when(kind(t) == "subtitle", F.array(some("subtitle_codec", codec(t)))).otherwise(F.array().cast("array<string>"))
        return F.concat(of_kind, F.array(F.when(F.contains(F.lower(F.coalesce(t["title"], F.lit(""))), F.lit("commentary")), "commentary:yes"), F.when(kind(t) == "attachment", "attachment:yes"), F.when((kind(t) == "subtitle") & t["is_forced"], "forced_subtitle:yes")))

    many = [F.when(F.size(of(tracks, k)) > 1, f"multi_{k}:yes") for k in ("audio", "subtitle")]
    found = F.array_distinct(F.array_compact(F.concat(F.array(some("container", F.lower("container")), *many), F.flatten(F.transform(tracks, own)))))
    return files.where(F.size("tracks") > 0).select("id", "size", F.explode(found).alias("feature"))


def _fields(files: DataFrame) -> set[str]:
    return {f.name for f in files.schema["tracks"].dataType.elementType.fields}


def latest_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by order."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def latest_with_ties(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """All rows that hold their key's greatest value."""
    return df.withColumn("_r", F.rank().over(W.partitionBy(*keys).orderBy(F.col(at).desc()))).where("_r = 1").drop("_r")


def nest(parents: DataFrame, children: DataFrame, key: str, parent_key: str, order: str, name: str) -> DataFrame:
    """Parents with their children as an ordered array; one join, no lookups by row."""
    cols = [order, *(c for c in children.columns if c not in (key, order))]
    rows = children.groupBy(F.col(key).alias(parent_key)).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    return parents.join(rows, parent_key, "left")


def greedy_cover(features: DataFrame, most: int, budget: int) -> DataFrame:
    """(rank, item, size, gain): items that cover most new features, smaller first on ties, within count and size.

    features: (item, size, feature), an item having one size. Of items with the same features only the
    smallest can ever be picked, so the rows are read once, into one item a set of features; a round is
    one pass over these. The driver sees the winners and their features only.
    """
    spark, picked, left, covered = features.sparkSession, [], budget, []
    items = features.where(F.col("size") <= budget).groupBy("item", "size").agg(F.array_sort(F.collect_set("feature")).alias("features")).where(F.size("features") > 0)
    sets = items.groupBy("features").agg(F.min(F.struct("size", "item")).alias("least")).select("features", "least.size", "least.item").persist()
    try:
        while len(picked) < most:
            known = F.array(*map(F.lit, covered)).cast(sets.schema["features"].dataType)
            gain = F.size(F.array_except("features", known)).cast("long")
            best = sets.where(F.col("size") <= left).withColumn("gain", gain).where("gain > 0").orderBy(F.desc("gain"), "size", "item").first()
            if best is None:
                break
            picked.append((len(picked) + 1, best["item"], best["size"], best["gain"]))
            left -= best["size"]
            covered += [f for f in best["features"] if f not in covered]
    finally:
        sets.unpersist()
    return spark.createDataFrame(picked, "rank int, item long, size long, gain long")
