"""A scan as chained micro-batches: what is discovered is ingested, what ingesting admits is probed.

The stages are coupled by tables that change in one commit with the number of the batch that changed
them, so a batch that Spark runs again after a failure does what is missing and nothing twice. The
source's limit of files per trigger bounds what is admitted at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinemill.operators.changes import base_name
from cinemill.sources.commits import Added, Snapshot, Tables

FILES = "path string, filename string, size long, modified_at timestamp, problem string"
WAITING = "path string, size long, modified_at timestamp, batch long"
DONE = "stage string, batch long"


def _has(s: Snapshot, stage: str, number: int) -> bool:
    return "done" in s and s["done"].where((F.col("stage") == stage) & (F.col("batch") == number)).take(1) != []


def _table(s: Snapshot, name: str, schema: str) -> DataFrame:
    return s[name] if name in s else s.spark.createDataFrame([], schema)


def _mark(s: Snapshot, stage: str, number: int) -> Added:
    return Added(s.spark.createDataFrame([(stage, number)], DONE))


def ingested(s: Snapshot, found: DataFrame, number: int) -> dict[str, DataFrame | Added]:
    """The changes of one batch of discovered rows (path, size, modified_at).

    Of several rows of a path the latest counts. A file that the catalogue has with the same size and
    time, or a later one, is left alone; others are entered and wait to be probed.
    """
    if _has(s, "ingest", number):
        return {}
    files = _table(s, "files", FILES)
    latest = found.groupBy("path").agg(F.max(F.struct("modified_at", "size")).alias("f")).select("path", "f.size", "f.modified_at")
    seen = files.select("path", F.col("size").alias("_size"), F.col("modified_at").alias("_at"))
    fresh = latest.join(seen, "path", "left").where((F.col("_at").isNull() | (F.col("modified_at") > F.col("_at"))) | ((F.col("modified_at") == F.col("_at")) & (F.col("size") != F.col("_size"))))
    fresh = fresh.select("path", "size", "modified_at")
    entered = fresh.select("path", base_name(F.col("path")).alias("filename"), "size", "modified_at", F.lit(None).cast("string").alias("problem"))
    return {
        "files": files.join(fresh.select("path"), "path", "left_anti").unionByName(entered),
        "waiting": Added(fresh.withColumn("batch", F.lit(number).cast("long"))),
        "done": _mark(s, "ingest", number),
    }


def probed(s: Snapshot, probe: Callable[[DataFrame], tuple[DataFrame, DataFrame]], number: int) -> dict[str, DataFrame | Added]:
    """The changes of probing all that waits: tracks replaced, the files' problem set, nothing waiting any more.

    probe: rows (path, size, modified_at) -> files (path, problem) and tracks (path and more).
    """
    waiting = s["waiting"]
    if _has(s, "probe", number) or not waiting.take(1):
        return {}
    # of a path that was admitted twice before it could be probed, the latest
    rows = waiting.groupBy("path").agg(F.max(F.struct("modified_at", "size")).alias("f")).select("path", "f.size", "f.modified_at")
    found, tracks = probe(rows)
    files = s["files"].join(found.select("path", F.col("problem").alias("_problem"), F.lit(True).alias("_probed")), "path", "left")
    files = files.select(*(F.when(F.col("_probed"), F.col("_problem")).otherwise(F.col(c)).alias(c) if c == "problem" else c for c in s["files"].columns))
    if "tracks" in s:
        tracks = s["tracks"].join(rows.select("path"), "path", "left_anti").unionByName(tracks)
    return {"files": files, "tracks": tracks, "waiting": waiting.limit(0), "done": _mark(s, "probe", number)}


def scanning(store: Tables, probe: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for a stream of discovered rows: each batch is ingested, then probed, in two commits."""

    def write(batch: DataFrame, number: int) -> None:
        store.commit(lambda s: ingested(s, batch, number))
        store.commit(lambda s: probed(s, probe, number))

    return write
