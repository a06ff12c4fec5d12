"""Scan reconciliation as set logic: what a scan found against what the catalogue holds.

A scan's rows (path, size, hash, seq) meet the catalogue by path, then by hash. Matching of moved
files is one to one: both sides are numbered within a hash by path and joined on hash and number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinemill.operators.catalogue import latest_per, under

DECISIONS = ("duplicate", "unchanged", "externally_changed", "moved", "new")


def under_any(path: Column, roots: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (under(path, r) for r in roots), F.lit(False))


def numbered(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order)))


def classify(found: DataFrame, files: DataFrame, sessions: DataFrame, roots: list[str]) -> DataFrame:
    """(path, seq, size, hash, decision, file_id): one row per found row.

    files: (id, path, status, content_hash, expected_hash, last_seen_session_id); sessions: (session_id,
    status). A catalogue row whose last session did not complete is a stub and counts as absent; a
    row without a session is none. An absent path whose hash a missing row under the roots expects
    has moved, each such row once, in path order.
    """
    first = F.row_number().over(W.partitionBy("path").orderBy("seq")) == 1
    found = found.select("path", "seq", "size", "hash", first.alias("_first"))
    # of the catalogue only what the scan's paths and hashes can meet goes on
    files = files.select("id", "path", "status", "expected_hash", "last_seen_session_id").where("path is not null")
    here = files.where("status = 'active'").join(found.select("path"), "path", "left_semi")
    gone = files.where("status = 'missing' and expected_hash is not null").where(under_any(F.col("path"), roots)).join(found.select(F.col("hash").alias("expected_hash")), "expected_hash", "left_semi")
    here, gone = (_finished(df, sessions) for df in (here, gone))
    met = found.where("_first").join(here.select("path", F.col("id").alias("_id"), "expected_hash"), "path", "left")
    same = F.col("expected_hash").isNull() | (F.col("expected_hash") == F.col("hash"))
    absent = numbered(met.where("_id is null").select("path", "seq", "size", "hash"), "hash", "path")
    gone = numbered(gone.select(F.col("expected_hash").alias("hash"), F.col("path").alias("_from"), F.col("id").alias("file_id")), "hash", "_from").drop("_from")
    moved = absent.join(gone, ["hash", "_n"], "left").select("path", "seq", "size", "hash", F.when(F.col("file_id").isNotNull(), "moved").otherwise("new").alias("decision"), "file_id")
    by_path = met.where("_id is not null").select("path", "seq", "size", "hash", F.when(same, "unchanged").otherwise("externally_changed").alias("decision"), F.col("_id").alias("file_id"))
    again = found.where("not _first").select("path", "seq", "size", "hash", F.lit("duplicate").alias("decision"), F.lit(None).cast("long").alias("file_id"))
    return by_path.unionByName(moved).unionByName(again)


def _finished(files: DataFrame, sessions: DataFrame) -> DataFrame:
    """Files but stubs: those whose last session did not complete."""
    known = files.join(sessions.withColumnsRenamed({"session_id": "last_seen_session_id", "status": "_session"}), "last_seen_session_id", "left")
    return known.where(F.col("last_seen_session_id").isNull() | F.coalesce(F.col("_session") == "completed", F.lit(False)))


def finish(decisions: DataFrame, files: DataFrame, mutated: DataFrame, roots: list[str]) -> DataFrame:
    """(id, outcome, path): active catalogue rows under the roots that the scan did not see.

    promoted: a new row has the hash it expects and takes its place (each new row once); kept: the
    session itself changed its path; missing: the rest.
    """
    seen = decisions.where("file_id is not null").select(F.col("file_id").alias("id")).distinct()
    unseen = files.where("status = 'active' and path is not null").where(under_any(F.col("path"), roots)).join(seen, "id", "left_anti")
    fresh = numbered(decisions.where("decision = 'new'").select(F.col("hash").alias("expected_hash"), F.col("path").alias("to")), "expected_hash", "to")
    matched = numbered(unseen.where("expected_hash is not null").select("id", "expected_hash", "path"), "expected_hash", "path").join(fresh, ["expected_hash", "_n"]).select("id", "to")
    skipped = mutated.select("path").distinct().withColumn("_own", F.lit(True))
    out = unseen.select("id", "path").join(matched, "id", "left").join(skipped, "path", "left")
    return out.select("id", F.when(F.col("to").isNotNull(), "promoted").when(F.col("_own"), "kept").otherwise("missing").alias("outcome"), F.coalesce("to", "path").alias("path"))


def counts(decisions: DataFrame, finished: DataFrame) -> DataFrame:
    """(decision, n) with promoted moves counted as moved, not as new."""
    n = decisions.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))
    p = finished.where("outcome = 'promoted'").agg(F.count(F.lit(1)).alias("p"))
    every = decisions.sparkSession.createDataFrame([(d,) for d in DECISIONS] + [("missing",)], "decision string")
    gone = finished.where("outcome = 'missing'").agg(F.count(F.lit(1)).alias("n")).select(F.lit("missing").alias("decision"), "n")
    out = every.join(n.unionByName(gone), "decision", "left").crossJoin(F.broadcast(p))
    shift = F.when(F.col("decision") == "new", -F.col("p")).when(F.col("decision") == "moved", F.col("p")).otherwise(0)
    return out.select("decision", (F.coalesce("n", F.lit(0)) + shift).alias("n"))


def transitions(decisions: DataFrame) -> DataFrame:
    """(path, file_id, kind): log rows of the decisions; an external change closes one row and opens another."""
    kinds = F.when(F.col("decision") == "externally_changed", F.array(F.lit("superseded"), F.lit("discovered"))).when(F.col("decision") == "moved", F.array(F.lit("moved"))).when(F.col("decision") == "new", F.array(F.lit("discovered")))
    return decisions.select("path", "file_id", F.explode(kinds).alias("kind"))


def changed(files: DataFrame, decisions: DataFrame) -> DataFrame:
    """(id, path, size, expected_hash, status): the catalogue rows that a scan changes or adds, as they are after it.

    Unchanged rows are refreshed, changed ones closed and replaced, moved ones renamed, new ones added
    under ids made from their paths. Only rows that the decisions name are read on.
    """
    d = decisions.where("decision in ('unchanged', 'externally_changed', 'moved')").select(F.col("file_id").alias("id"), F.col("path").alias("_path"), F.col("size").alias("_size"), F.col("hash").alias("_hash"), "decision")
    m = files.select("id", "size", "expected_hash").join(d, "id")
    lost = F.col("decision") == "externally_changed"
    kept = m.select(
        "id", F.when(~lost, F.col("_path")).alias("path"), F.when(lost, F.col("size")).otherwise(F.col("_size")).alias("size"),
        F.when(lost, F.col("expected_hash")).otherwise(F.coalesce("expected_hash", "_hash")).alias("expected_hash"), F.when(lost, "missing").otherwise("active").alias("status"),
    )
    fresh = decisions.where("decision in ('new', 'externally_changed')").select(F.xxhash64("path").alias("id"), "path", "size", F.col("hash").alias("expected_hash"), F.lit("active").alias("status"))
    return kept.unionByName(fresh)


def applied(files: DataFrame, decisions: DataFrame) -> DataFrame:
    """The whole catalogue after a scan: changed() rows in place of those with their ids."""
    new = changed(files, decisions)
    return files.select(*new.columns).join(new.select("id"), "id", "left_anti").unionByName(new)


def begin(sessions: DataFrame, now, stale_seconds: int = 60) -> DataFrame:
    """Sessions after one begins: live ones without a heartbeat for stale_seconds are cancelled; another live one is an error."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("last_heartbeat_at").cast("timestamp"))
    live = F.col("status") == "in_progress"
    out = sessions.withColumn("status", F.when(live & (age > stale_seconds), "cancelled").otherwise(F.col("status")))
    if out.where(live).where(age <= stale_seconds).take(1):
        raise RuntimeError("a scan session is in progress")
    return out


def mutation_rows(log: DataFrame) -> DataFrame:
    """(session_id, path): a rename touches both its paths."""
    both = F.array_compact(F.array("path", "from_path"))
    return log.select("session_id", F.explode(both).alias("path")).distinct()


__all__ = ["applied", "begin", "changed", "classify", "counts", "finish", "latest_per", "mutation_rows", "transitions", "under_any"]
