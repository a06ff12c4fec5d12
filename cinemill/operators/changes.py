"""Changes of the catalogue's tables as functions from tables to tables, for use in one commit (sources/commits.py).

Rows that name one key several times in a batch act in the order of their seq, as single statements would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of files that an upsert leaves alone where the path is known.
KEPT = ("id", "created_at", "expected_hash", "superseded_by", "last_seen_session_id")
TERMINAL = ("completed", "failed", "cancelled")


def merged(files: DataFrame, tracks: DataFrame, new_files: DataFrame, new_tracks: DataFrame, kept: tuple[str, ...] = KEPT) -> dict[str, DataFrame]:
    """files and tracks after an upsert by path.

    A known path keeps its id (and the other kept columns), so rows of other tables still find it; its
    remaining columns and all its tracks are replaced. new_files: columns of files and seq; new_tracks:
    columns of tracks and seq, file_id being the new row's own id. Of several new rows of one path the
    last one's columns and tracks stand under the first one's id. Files without a path match none.
    """
    values, kept = [c for c in files.columns if c != "path"], [c for c in kept if c in files.columns]
    batch = new_files.where("path IS NOT NULL").groupBy("path").agg(F.min_by(F.struct(*kept), "seq").alias("first"), F.max_by(F.struct(*values, "seq"), "seq").alias("last"))
    old = files.select("path", F.struct(*values).alias("old"))
    both = old.join(batch, "path", "full")
    column = lambda c: F.when(F.col("old").isNull(), F.col(f"first.{c}")).otherwise(F.col(f"old.{c}")) if c in kept else F.when(F.col("last").isNull(), F.col(f"old.{c}")).otherwise(F.col(f"last.{c}"))
    out = both.select(*("path" if c == "path" else column(c).alias(c) for c in files.columns))
    named = both.where("last IS NOT NULL").select(F.col("last.id").alias("_new"), F.col("last.seq").alias("seq"), F.coalesce("old.id", "first.id").alias("_id"))
    fresh = new_tracks.join(named, (new_tracks["file_id"] == named["_new"]) & (new_tracks["seq"] == named["seq"])).select(*(F.col("_id").alias(c) if c == "file_id" else new_tracks[c] for c in tracks.columns))
    stay = tracks.join(named.select(F.col("_id").alias("file_id")), "file_id", "left_anti")
    return {"files": out, "tracks": stay.select(*tracks.columns).unionByName(fresh)}


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def executed(files: DataFrame, transitions: DataFrame, bad_files: DataFrame, bundles: DataFrame) -> dict[str, DataFrame]:
    """The three tables after plans were executed, one bundle a plan.

    bundles: the columns of transitions, new_path and new_expected_hash (either may be null) and seq. A
    bundle renames its file, sets the hash that the file is expected to have, logs the transition, and
    clears the path of the transition from the bad files. A file's last bundle that sets a column wins.
    """
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}")
    sets = bundles.groupBy(F.col("file_id").alias("id")).agg(last("new_path"), last("new_expected_hash"))
    m = files.join(sets, "id", "left")
    to = F.col("_new_path")
    set_to = {"path": F.coalesce(to, F.col("path")), "filename": F.when(to.isNotNull(), base_name(to)).otherwise(F.col("filename")), "expected_hash": F.coalesce("_new_expected_hash", "expected_hash")}
    out = m.select(*(set_to[c].alias(c) if c in set_to else c for c in files.columns))
    cleared = bad_files.join(bundles.select("path").distinct(), "path", "left_anti").select(*bad_files.columns)
    return {"files": out, "transitions": transitions.unionByName(bundles.select(*transitions.columns)), "bad_files": cleared}


def claimed(jobs: DataFrame, worker: str, now, job_id: int | None = None) -> DataFrame:
    """jobs with the next pending one (lowest priority number, then oldest), or the given one if it is pending, running for the worker."""
    pending = jobs.where("status = 'pending'")
    target = pending.where(F.col("id") == job_id) if job_id is not None else pending.orderBy("priority", "created_at", "id")
    target = target.limit(1).select(F.col("id").alias("_claimed"))
    mine = F.col("_claimed").isNotNull()
    m = jobs.join(F.broadcast(target), F.col("id") == F.col("_claimed"), "left")  # one row
    set_to = {"status": F.lit("running"), "worker_id": F.lit(worker), "started_at": F.lit(now).cast(dict(jobs.dtypes).get("started_at", "timestamp"))}
    return m.select(*(F.when(mine, set_to[c]).otherwise(F.col(c)).alias(c) if c in set_to else c for c in jobs.columns))


def cancelled(jobs: DataFrame, ids: DataFrame, now) -> DataFrame:
    """jobs with those of ids (id) that have not ended cancelled; ended ones stay as they are."""
    named = jobs.join(ids.select("id", F.lit(True).alias("_named")).distinct(), "id", "left")
    hit = F.col("_named").isNotNull() & ~F.col("status").isin(*TERMINAL)
    at = F.lit(now).cast(dict(jobs.dtypes)["completed_at"])
    return named.select(*(F.when(hit, F.lit("cancelled")).otherwise(F.col(c)).alias(c) if c == "status" else F.when(hit, at).otherwise(F.col(c)).alias(c) if c == "completed_at" else c for c in jobs.columns))


def retried(jobs: DataFrame, ids: DataFrame, now, new_id: Column) -> DataFrame:
    """jobs and, for each failed one of ids (id), a new pending one of its type, priority and payload; new_id makes its id."""
    again = jobs.where("status = 'failed'").join(ids.select("id").distinct(), "id", "left_semi")
    kinds = dict(jobs.dtypes)
    set_to = {"id": new_id.cast(kinds["id"]), "status": F.lit("pending"), "created_at": F.lit(now).cast(kinds["created_at"])}
    copied = {"job_type", "priority", "payload"}
    return jobs.unionByName(again.select(*(set_to[c].alias(c) if c in set_to else F.col(c) if c in copied else F.lit(None).cast(kinds[c]).alias(c) for c in jobs.columns)))


def cleared(jobs: DataFrame, status: str | None = None) -> DataFrame:
    """jobs without those that ended, or without those of one ended status."""
    if status is not None and status not in TERMINAL:
        raise ValueError(f"only ended jobs can be cleared, not {status}")
    return jobs.where(~F.col("status").isin(*([status] if status else TERMINAL)) | F.col("status").isNull())
