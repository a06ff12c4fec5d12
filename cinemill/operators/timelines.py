"""Changes over series of samples, each series being the rows of one source in order of time.

Defined cases: the first sample of a source has nothing to differ from; a value that is null on both
sides has not changed; ties on time are told apart by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _in_order() -> W:
    return W.partitionBy("source").orderBy("at", "id")


def streaks(samples: DataFrame, value: Column) -> DataFrame:
    """The samples with _streak: how many in a row, this one included, have had the same value."""
    w = _in_order()
    turned = samples.withColumn("_v", value).withColumn("_new", (F.row_number().over(w) == 1) | ~F.col("_v").eqNullSafe(F.lag("_v").over(w)))
    islands = turned.withColumn("_island", F.sum(F.col("_new").cast("int")).over(w))
    return islands.withColumn("_streak", F.row_number().over(W.partitionBy("source", "_island").orderBy("at", "id"))).drop("_v", "_new", "_island")


def runtime_changes(samples: DataFrame, disk_threshold: int, stall: int) -> DataFrame:
    """(source, at, id, kind, detail): device counts that changed, disks that crossed a threshold upwards since the
    sample before, and job lists that had the same number of rows for stall samples.

    samples: (source, at, id, gpus, disks map<mount, used>, job_rows). A disk that the sample before did not list counts as empty there.
    """
    w = _in_order()
    s = streaks(samples, F.col("job_rows")).withColumn("_gpus", F.lag("gpus").over(w)).withColumn("_disks", F.lag("disks").over(w)).withColumn("_later", F.row_number().over(w) > 1)
    event = lambda kind, detail: F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))
    gpus = F.when(F.col("_later") & ~F.col("gpus").eqNullSafe(F.col("_gpus")), event("gpus", F.concat_ws(" -> ", F.col("_gpus").cast("string"), F.col("gpus").cast("string"))))
    crossed = F.filter(F.map_entries("disks"), lambda e: (e["value"] >= disk_threshold) & (F.coalesce(F.try_element_at(F.col("_disks"), e["key"]), F.lit(0)) < disk_threshold))
    disks = F.transform(crossed, lambda e: event("disk", F.concat(e["key"], F.lit(" "), e["value"].cast("string"))))
    stalled = F.when((F.col("job_rows") > 0) & (F.col("_streak") == stall) & F.col("_later"), event("stall", F.col("job_rows").cast("string")))
    none = F.array().cast("array<struct<kind:string,detail:string>>")
    found = F.concat(F.array_compact(F.array(gpus, stalled)), F.when(F.col("_later"), disks).otherwise(none))
    return s.select("source", "at", "id", F.explode(found).alias("e")).select("source", "at", "id", "e.kind", "e.detail")


def environment_changes(samples: DataFrame, names: dict[str, str]) -> DataFrame:
    """(source, number, changes): the numbered samples in which a named value differs from the sample before.

    names: column -> the name it is shown by, in the order shown.
    """
    w = _in_order()
    s = samples.withColumn("number", F.row_number().over(w))
    shown = [
        F.when(~F.col(c).eqNullSafe(F.lag(c).over(w)), F.concat(F.lit(f"{name} "), F.coalesce(F.lag(c).over(w).cast("string"), F.lit("none")), F.lit(" -> "), F.coalesce(F.col(c).cast("string"), F.lit("none"))))
        for c, name in names.items()
    ]
    return s.withColumn("changes", F.concat_ws("; ", *shown)).where("number > 1 and changes <> ''").select("source", "number", "changes")


def watchdog(polls: DataFrame, limit: int) -> DataFrame:
    """(source, poll, at): the first poll of each source after limit polls in a row left its job list's signature unchanged."""
    s = streaks(polls, F.col("signature")).withColumn("poll", F.row_number().over(_in_order()))
    return s.where(F.col("_streak") > limit).groupBy("source").agg(F.min(F.struct("poll", "at")).alias("x")).select("source", "x.poll", "x.at")
