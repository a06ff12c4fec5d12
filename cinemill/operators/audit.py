"""Run-to-run audits: pivots, snapshot and record differences, failure clusters and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinemill.functions.media import QUOTED, error_signature


def pivot_with_total(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts by row and column value, 0 where none, with a total."""
    counts = df.groupBy(row).pivot(column, values).count().na.fill(0)
    return counts.withColumn("total", sum((F.col(f"`{v}`") for v in values), F.lit(0)))


def outer(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer join with columns a_* and b_* and in_a, in_b."""
    left = a.select(key, *(F.col(c).alias(f"a_{c}") for c in columns), F.lit(True).alias("in_a"))
    right = b.select(key, *(F.col(c).alias(f"b_{c}") for c in columns), F.lit(True).alias("in_b"))
    return left.join(right, key, "full").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_a", "in_b")})


def snapshot_diff(a: DataFrame, b: DataFrame, key: str = "path") -> DataFrame:
    """(key, change): disappeared, new, size_changed, mtime_changed or unchanged, between two listings (key, size, mtime)."""
    j = outer(a, b, key, ["size", "mtime"])
    return j.select(
        key,
        F.when(~F.col("in_b"), "disappeared").when(~F.col("in_a"), "new").when(~F.col("a_size").eqNullSafe(F.col("b_size")), "size_changed").when(~F.col("a_mtime").eqNullSafe(F.col("b_mtime")), "mtime_changed").otherwise("unchanged").alias("change"),
    )


def near(a: Column, b: Column, tolerance: float) -> Column:
    """Equal numbers within a share of the larger; NULL equals NULL."""
    return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * tolerance, F.lit(False))


def record_diff(a: DataFrame, b: DataFrame, key: str, exact: list[str], numeric: list[str], tolerance: float = 0.005) -> DataFrame:
    """(key, side, field): rows of one side only, and fields that differ."""
    j = outer(a, b, key, exact + numeric)
    both = F.col("in_a") & F.col("in_b")
    fields = [F.when(both & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.struct(F.lit("both").alias("side"), F.lit(c).alias("field"))) for c in exact]
    fields += [F.when(both & ~near(F.col(f"a_{c}"), F.col(f"b_{c}"), tolerance), F.struct(F.lit("both").alias("side"), F.lit(c).alias("field"))) for c in numeric]
    only = F.when(~both, F.struct(F.when(F.col("in_a"), "pre").otherwise("post").alias("side"), F.lit("*").alias("field")))
    return j.select(key, F.explode(F.array_compact(F.array(only, *fields))).alias("d")).select(key, "d.side", "d.field")


def plan_diff(preview: DataFrame, executed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., difference): executed-only, preview-only, and up to two differences of plans that both have (skip-reason, params)."""
    j = preview.withColumn("in_a", F.lit(True)).withColumnsRenamed({"skip_reason": "a_reason", "params": "a_params"}).join(
        executed.withColumn("in_b", F.lit(True)).withColumnsRenamed({"skip_reason": "b_reason", "params": "b_params"}), keys, "full")
    differ = F.array(
        F.when(F.col("in_a").isNull(), "executed-only"), F.when(F.col("in_b").isNull(), "preview-only"), F.when(F.col("in_a") & F.col("in_b") & ~F.col("a_reason").eqNullSafe(F.col("b_reason")), "skip-reason"),
        F.when(F.col("in_a") & F.col("in_b") & ~F.col("a_params").eqNullSafe(F.col("b_params")), "action-params"),
    )
    return j.select(*keys, F.explode(F.array_compact(differ)).alias("difference"))


def first_per_group(df: DataFrame, keys: list[str], order: list[str], cap: int) -> DataFrame:
    """At most cap rows of each group, by order."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= cap).drop("_rn")


def occurrence(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with their running number within the group, as occurrence."""
    return df.withColumn("occurrence", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def clusters(failures: DataFrame, keys: list[str], sample: str) -> DataFrame:
    """(keys.., n, files, sample): failure groups with the smallest sample."""
    return failures.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file_id").alias("files"), F.min(sample).alias("sample"))


def verdict(**checks: tuple[DataFrame, str]) -> DataFrame:
    """(name, level, n): counts of each check's offending rows; hard ones fail the run, soft ones warn, none pass."""
    out = None
    for name, (bad, level) in checks.items():
        n = bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), F.when(F.col("n") == 0, "pass").otherwise(level).alias("level"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def failure_clusters(failed: DataFrame, files: DataFrame, probed: DataFrame) -> DataFrame:
    """(phase, signature, exit_code, container, video_codec, n, top_resolution, sample_path, sample_plan_id, sample_error).

    failed: (plan_id, file_id, phase, result); result is a JSON object with error and detail (stderr_tail,
    command, exit_code), or any text. files: (file_id, path); probed: (path, container, video_codec,
    width, height). A cluster's sample is its plan of the smallest id; of resolutions that are equally
    common the one met first stands. Absent values are empty texts. Counts by resolution come first,
    so no cluster's rows meet in one task.
    """
    v = F.try_parse_json("result")
    known = F.schema_of_variant(v).startswith("OBJECT")
    part = lambda path: F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))
    shown = F.when(known, F.concat_ws("\n", part("$.error"), part("$.detail.stderr_tail"), part("$.detail.command"))).otherwise(F.coalesce("result", F.lit("")))
    df = failed.select("plan_id", "file_id", "phase", shown.alias("text"), F.when(known, part("$.detail.exit_code")).otherwise("").alias("exit_code"))
    lines = F.filter(F.transform(F.split("text", "\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    quoted = F.filter(lines, lambda x: x.rlike("|".join(QUOTED)))
    error = F.substring(F.array_join(F.slice(F.when(F.size(quoted) > 0, quoted).otherwise(lines), 1, 3), " | "), 1, 500)
    df = df.select("plan_id", "file_id", "phase", error_signature(F.col("text")).alias("signature"), "exit_code", error.alias("error"))
    df = df.join(files.select("file_id", "path"), "file_id", "left").join(probed, "path", "left")
    shape = F.when((F.col("width") > 0) & (F.col("height") > 0), F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string"))).otherwise("")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    keys = ["phase", "signature", "exit_code", "container", "video_codec"]
    df = df.select(*(empty(c) for c in keys), shape.alias("resolution"), "plan_id", empty("path"), "error")
    one = F.min(F.struct("plan_id", "path", "error")).alias("first")
    by_shape = df.groupBy(*keys, "resolution").agg(F.count(F.lit(1)).alias("n"), one)
    top = F.max(F.when(F.col("resolution") != "", F.struct(F.col("n").alias("n"), (-F.col("first.plan_id")).alias("o"), "resolution")))
    out = by_shape.groupBy(*keys).agg(F.sum("n").alias("n"), F.coalesce(top["resolution"], F.lit("")).alias("top_resolution"), F.min("first").alias("first"))
    return out.select(*keys, "n", "top_resolution", F.col("first.path").alias("sample_path"), F.col("first.plan_id").alias("sample_plan_id"), F.col("first.error").alias("sample_error"))
