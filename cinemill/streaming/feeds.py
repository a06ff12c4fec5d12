"""Event and scan feeds as Structured Streaming; each has a batch twin over the same transformation."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinemill.operators.catalogue import event_type_matches

#: Event kinds that are sent on to browsers (fixed values), paths cut to their base name.
SENT = ("file.discovered", "file.introspected", "plan.created", "plan.failed", "job.started", "job.progress", "job.completed", "scan.complete")


def follow(spark: SparkSession, at: str, schema, pattern: str = "*", since_rowid: int = 0, per_trigger: int = 100) -> DataFrame:
    """The event log as a stream: rows of a kind after a row number, in files of the log table."""
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(at)
    return log.where(event_type_matches(F.col("event_type"), pattern) & (F.col("rowid") > since_rowid))


def sent_events(events: DataFrame) -> DataFrame:
    """(event_type, data) for browsers: the kinds in SENT, the path reduced to its last part."""
    base = F.element_at(F.split(F.get_json_object("payload", "$.path"), "/"), -1)
    return events.where(F.col("event_type").isin(*SENT)).select("event_type", F.to_json(F.struct(F.col("rowid").alias("id"), base.alias("file"))).alias("data"))


def discovered(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("mkv", "mp4", "avi", "mov", "webm", "ts"), stream: bool = False, per_trigger: int = 1000) -> DataFrame:
    """(path, size, modified_at, extension) of the media files beneath a folder; as a stream each file once. Content is not read."""
    reader = (spark.readStream if stream else spark.read).format("binaryFile").option("recursiveFileLookup", "true")
    if stream:
        reader = reader.option("maxFilesPerTrigger", per_trigger).schema("path string, modificationTime timestamp, length long, content binary")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    found = reader.load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), ext.alias("extension"))
    return found.where(F.col("extension").isin(*extensions) & ~F.rlike(F.col("path"), F.lit(r"/\.[^/]*$|\.tmp\.[^/.]+$")))


def once_per_path(df: DataFrame, at: str, lateness: str = "1 hour") -> DataFrame:
    """The first row of each path; in a stream, within the watermark."""
    return df.withWatermark(at, lateness).dropDuplicatesWithinWatermark(["path"]) if df.isStreaming else df.dropDuplicates(["path"])


def routed(routes: dict[str, tuple[Column, str]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends the rows of each route to its table; the batch's number makes a retry overwrite itself.

    routes: name -> (predicate, folder).
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for predicate, folder in routes.values():
            batch.where(predicate).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        batch.unpersist()

    return write


def gate_by_root(rows: DataFrame) -> DataFrame:
    """Rows held back until their root's marker arrives: (root, path, done) -> (root, path).

    done rows mark a root as complete; rows of the root that come later pass at once. The paths that
    wait are one state value per root, so this is for roots of some thousand files; gate_through_tables
    is for roots of any size.
    """

    def release(key, parts, state):
        held, open_ = ([], False) if not state.exists else (list(state.get[0]), bool(state.get[1]))
        for pdf in parts:
            held += pdf.loc[~pdf["done"], "path"].tolist()
            open_ = open_ or bool(pdf["done"].any())
        out, held = (held, []) if open_ else ([], held)
        state.update((held, open_))
        yield pd.DataFrame({"root": [key[0]] * len(out), "path": sorted(out)})

    return rows.groupBy("root").applyInPandasWithState(release, "root string, path string", "held array<string>, open boolean", "append", "NoTimeout")


def gate_through_tables(folder: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function with gate_by_root's meaning whose waiting rows are a table: (root, path, done) -> folder/out.

    A row leaves in the later of its own batch and the one that marks its root. A batch reads its own
    rows and what the batch before it left, the rows that still wait and the roots that are open, and
    leaves the same for the next, so its cost does not grow with what has passed. A batch that is
    tried again writes the same rows, and a root of any size is dealt out as any join is.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession

        def left(name: str, schema: str) -> DataFrame:
            if number == 0:
                return spark.createDataFrame([], schema)
            return spark.read.schema(schema).parquet(f"{folder}/{name}/batch={number - 1}")

        batch.persist()
        rows = left("waiting", "root string, path string").unionByName(batch.where("not done").select("root", "path"))
        opened = left("open", "root string").unionByName(batch.where("done").select("root")).distinct()
        rows.join(opened, "root", "left_semi").write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        rows.join(opened, "root", "left_anti").write.mode("overwrite").parquet(f"{folder}/waiting/batch={number}")
        opened.write.mode("overwrite").parquet(f"{folder}/open/batch={number}")
        batch.unpersist()

    return write


def snapshot_on(kinds: tuple[str, ...], summary: Callable[[SparkSession], DataFrame], folder: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over the event log: a batch that holds an event of the kinds appends a snapshot (trigger, captured_at and the
    summary's columns) to the folder; a batch tried again overwrites its own."""

    def write(batch: DataFrame, number: int) -> None:
        last = batch.where(F.col("event_type").isin(*kinds)).agg(F.max(F.struct("rowid", "event_type", "created_at")).alias("e")).where("e is not null")
        if last.take(1):
            row = last.select(F.col("e.event_type").alias("trigger"), F.col("e.created_at").alias("captured_at"))
            summary(batch.sparkSession).crossJoin(F.broadcast(row)).write.mode("overwrite").parquet(f"{folder}/batch={number}")  # one row

    return write


def latency_windows(stats: DataFrame, width: str = "10 minutes", lateness: str = "10 minutes") -> DataFrame:
    """(window_start, plugin_id, n, total_ms, worst_ms): call statistics by time window, late rows within the watermark included."""
    df = stats.withWatermark("started_at", lateness) if stats.isStreaming else stats
    out = df.groupBy(F.window("started_at", width).alias("w"), "plugin_id").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("worst_ms"))
    return out.select(F.col("w.start").alias("window_start"), "plugin_id", "n", "total_ms", "worst_ms")
