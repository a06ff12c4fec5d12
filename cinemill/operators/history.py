"""Transitions, retention, integrity, latency, quality and cost reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

VMAF_ROWS, LOUDNESS_TARGET, LOUDNESS_TOLERANCE = 20, -23.0, 0.5


def week(at: Column) -> Column:
    """Year and week of the year, weeks starting on Monday; days before the first Monday are week 00."""
    n = F.floor((F.dayofyear(at) - 1 + 7 - F.weekday(at)) / 7).cast("int")
    return F.concat(F.date_format(at, "yyyy"), F.lit("-W"), F.lpad(n.cast("string"), 2, "0"))


def period(at: Column, unit: str) -> Column:
    return {"day": F.date_format(at, "yyyy-MM-dd"), "month": F.date_format(at, "yyyy-MM"), "week": week(at)}[unit]


def round2(x: Column) -> Column:
    return F.round(x * 100) / 100


def round4(x: Column) -> Column:
    return F.round(x * 10000) / 10000


def savings(transitions: DataFrame, unit: str | None = None) -> DataFrame:
    """Count, bytes saved, time and files of successful transitions by executor, phase and optional period."""
    keys = ["executor", "phase_name"] + (["period"] if unit else [])
    df = transitions.where("source = 'engine' or executor is not null").where("outcome = 'success'")
    df = df.withColumn("period", period(F.col("created_at"), unit)) if unit else df
    saved = F.coalesce(F.sum(F.when(F.col("from_size").isNotNull(), F.col("from_size") - F.col("to_size"))), F.lit(0))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), saved.alias("bytes_saved"), F.sum("duration_ms").alias("duration_ms"), F.countDistinct("file_id").alias("files"))


def savings_totals(groups: DataFrame) -> DataFrame:
    """(total_bytes_saved, total_transitions) over the rows of savings()."""
    return groups.agg(F.coalesce(F.sum("bytes_saved"), F.lit(0)).alias("total_bytes_saved"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_transitions"))


def lineage(files: DataFrame, start: DataFrame, depth: int = 50) -> DataFrame:
    """(root, id, hop): the chain of predecessors of each start id, a file having one at most.

    Steps double in length from join to join. Depth guards against long chains; one that comes back
    to its root ends before it.
    """

    def settled(df: DataFrame) -> DataFrame:
        return df.checkpoint() if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else df

    step = files.where("superseded_by is not null").select(F.col("superseded_by").alias("from"), F.col("id").alias("to"))
    reach, length = start.select(F.col("id").alias("root"), "id", F.lit(0).alias("hop")), 1
    while length < depth:
        more = reach.join(step, F.col("id") == F.col("from")).select("root", F.col("to").alias("id"), (F.col("hop") + length).alias("hop"))
        reach = settled(reach.unionByName(more.where(F.col("hop") < depth)))
        length *= 2
        if length < depth:
            step = settled(step.join(step.select(F.col("from").alias("to"), F.col("to").alias("next")), "to").select("from", F.col("next").alias("to")))
            if not step.take(1):
                break
    back = reach.where("id = root and hop > 0").groupBy("root").agg(F.min("hop").alias("back"))
    return reach.join(back, "root", "left").where("back is null or hop < back").select("root", "id", "hop")


def lineage_transitions(chains: DataFrame, transitions: DataFrame) -> DataFrame:
    """(root, hop, file_id, transition_id, created_at): the transitions of every file on each root's chain."""
    of = transitions.select("file_id", F.col("id").alias("transition_id"), "created_at")
    return chains.withColumnRenamed("id", "file_id").join(of, "file_id").select("root", "hop", "file_id", "transition_id", "created_at")


def doomed(df: DataFrame, at: Column, order: list[Column], older_than=None, keep_last: int | None = None) -> DataFrame:
    """Rows that a retention rule deletes: older than the cutoff, or beyond the newest keep_last.

    The newest rows are found by an ordered limit, not by numbering the whole table in one partition.
    Rows compare by the order columns, which must tell them apart. No rule deletes nothing.
    """
    if older_than is None and keep_last is None:
        return df.limit(0)
    gone = F.lit(False)
    if older_than is not None:
        gone = gone | (at < F.lit(older_than))
    if keep_last is None:
        return df.where(gone)
    newest = df.orderBy(*order).limit(keep_last)
    old = df.where(gone)
    return old.unionByName(df.where(~gone).join(newest.select("id"), "id", "left_anti"))


def integrity(files: DataFrame, verifications: DataFrame, stale_before) -> DataFrame:
    """One row: files, never verified, stale, with errors, with warnings, and with a changed hash."""
    newest = verifications.groupBy(F.col("file_id").alias("id")).agg(F.max("verified_at").alias("at"), F.max_by("outcome", F.struct("verified_at", "id")).alias("outcome"))
    active = files.where("status = 'active'").join(newest, "id", "left")
    head = active.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("at").isNull()).alias("never_verified"), F.count_if(F.col("at") < F.lit(stale_before)).alias("stale"),
        F.count_if(F.col("outcome") == "error").alias("with_errors"), F.count_if(F.col("outcome") == "warning").alias("with_warnings"),
    )
    return head.crossJoin(F.broadcast(hash_changes(verifications).agg(F.count(F.lit(1)).alias("hash_mismatches"))))


def hash_changes(verifications: DataFrame) -> DataFrame:
    """Files whose newest hash differs from the one before; the id breaks ties on time."""
    w = W.partitionBy("file_id").orderBy("verified_at", "id")
    back = W.partitionBy("file_id").orderBy(F.desc("verified_at"), F.desc("id"))
    hashed = verifications.where("content_hash is not null").withColumn("prev", F.lag("content_hash").over(w)).withColumn("rn", F.row_number().over(back))
    return hashed.where("rn = 1 and prev is not null and prev <> content_hash").select("file_id", "prev", "content_hash")


def due(files: DataFrame, verifications: DataFrame, before) -> DataFrame:
    """Active files never verified or not since the cutoff."""
    newest = verifications.groupBy(F.col("file_id").alias("id")).agg(F.max("verified_at").alias("at"))
    return files.where("status = 'active'").join(newest, "id", "left").where(F.col("at").isNull() | (F.col("at") < F.lit(before)))


def latency_rollup(stats: DataFrame, top: int) -> DataFrame:
    """Per plugin: calls by outcome and nearest-rank percentiles, slowest 95th first."""
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by duration_ms)")
    out = stats.groupBy("plugin_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "ok").alias("ok"), F.count_if(F.col("outcome") == "error").alias("errors"), F.count_if(F.col("outcome") == "panic").alias("panics"),
        p(0.5).cast("long").alias("p50"), p(0.95).cast("long").alias("p95"), p(0.99).cast("long").alias("p99"), F.sum("duration_ms").alias("total_ms"),
    )
    return out.orderBy(F.desc("p95"), "plugin_id").limit(top)


def vmaf_summary(outcomes: DataFrame) -> DataFrame:
    """One row of quality averages; the missed count is taken among the VMAF_ROWS largest deficits, as reports do."""
    known = outcomes.where("target_vmaf is not null and achieved_vmaf is not null").withColumn("deficit", F.col("target_vmaf") - F.col("achieved_vmaf"))
    worst = known.orderBy(F.desc("deficit"), "id").limit(VMAF_ROWS).agg(F.count_if(F.col("deficit") > 0).alias("missed"))
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long"))
    head = outcomes.agg(
        F.count(F.lit(1)).alias("n"), round2(cents("achieved_vmaf") / F.count("achieved_vmaf") / 100).alias("avg_vmaf"), round2(F.sum("iterations") / F.count(F.lit(1))).alias("avg_iterations"),
        round4(F.count_if("fallback_used") / F.count(F.lit(1))).alias("fallback_rate"),
    )
    return head.crossJoin(F.broadcast(worst))


def loudness(tracks: DataFrame) -> DataFrame:
    """One row: measured tracks, average loudness and peak (tenths), those outside the target's tolerance."""
    known = tracks.where("lufs is not null")
    tenths = lambda c: F.sum(F.round(F.col(c) * 10).cast("long"))
    return known.agg(
        F.count(F.lit(1)).alias("n"), round2(tenths("lufs") / F.count(F.lit(1)) / 10).alias("avg_lufs"), round2(tenths("true_peak") / F.count("true_peak") / 10).alias("avg_peak"),
        F.count_if(F.abs(F.col("lufs") - LOUDNESS_TARGET) > LOUDNESS_TOLERANCE).alias("outside"),
    )


def upper_median(column: str) -> Column:
    """The element at n div 2 of the sorted values: the discrete median from above, on values counted before they are shuffled."""
    return F.expr(f"percentile_disc(0.5) within group (order by {column} desc)")


def estimate(actions: DataFrame, samples: DataFrame, workers: int) -> dict[str, DataFrame]:
    """Cost of planned actions from samples with the same phase, codec, preset and backend.

    actions: (file_id, size, pixels, phase_name, codec, preset, backend). Medians are upper medians;
    an action without samples keeps its size and is uncertain. A file's output is its largest
    action's, its time the sum; the run's wall time divides by workers, rounded up.
    """
    keys = ["phase_name", "codec", "preset", "backend"]
    profile = samples.groupBy(*keys).agg(
        upper_median("pixels_per_second").alias("speed"), upper_median("output_size_ratio").alias("ratio"),
        upper_median("fixed_overhead_ms").cast("long").alias("overhead"), F.count(F.lit(1)).alias("n_samples"),
    )
    acts = actions.join(profile, keys, "left")
    acts = acts.select(
        *actions.columns, F.coalesce(F.round(F.col("size") * F.col("ratio")).cast("long"), "size").alias("bytes_out"),
        F.coalesce((F.round(F.col("pixels") / F.col("speed") * 1000).cast("long") + F.col("overhead")), F.lit(0)).alias("time_ms"), F.coalesce("n_samples", F.lit(0)).alias("n_samples"),
    )
    files = acts.groupBy("file_id").agg(F.max("size").alias("bytes_in"), F.max("bytes_out").alias("bytes_out"), F.sum("time_ms").alias("time_ms"), F.bool_or(F.col("n_samples") < 3).alias("uncertain"))
    saved = F.sum(F.col("bytes_in") - F.col("bytes_out"))
    run = files.agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out"), saved.alias("bytes_saved"), F.sum("time_ms").alias("compute_ms"),
        F.ceil(F.sum("time_ms") / workers).alias("wall_ms"), F.count_if("uncertain").alias("uncertain_files"), F.count_if(F.col("bytes_out") > F.col("bytes_in")).alias("net_loss_files"),
    )
    return {"actions": acts, "files": files, "run": run}


def ratio_error(estimated: Column, actual: Column) -> Column:
    return F.when(actual <= 0, 0.0).otherwise(F.abs(estimated - actual) / actual)


def calibration_report(samples: DataFrame) -> DataFrame:
    """Per group: how far estimates from the other samples' medians lie from what was measured.

    samples: (phase_name, codec, preset, backend, id, input_bytes, output_bytes, pixels, elapsed_ms,
    output_size_ratio, pixels_per_second). A group of one sample validates nothing and has no row.
    """
    keys = ["phase_name", "codec", "preset", "backend"]
    size = leave_one_out(samples).select("id", F.col("median_of_others").alias("ratio"))
    speed = leave_one_out(samples, "pixels_per_second").select("id", F.col("median_of_others").alias("speed"))
    one = samples.join(size, "id").join(speed, "id").withColumn("bytes", F.round(F.col("input_bytes") * F.col("ratio")).cast("long")).withColumn("ms", F.round(F.col("pixels") / F.col("speed") * 1000).cast("long"))
    total = lambda c: F.sum(c)
    saved, really = total("input_bytes") - total("bytes"), total("input_bytes") - total("output_bytes")
    return one.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("fixtures"), round4(ratio_error(saved, really)).alias("savings_error"), round4(ratio_error(total("bytes"), total("output_bytes"))).alias("bytes_error"),
        round4(ratio_error(total("ms"), total("elapsed_ms"))).alias("time_error"), round4(F.max(ratio_error(F.col("bytes"), F.col("output_bytes")))).alias("max_bytes_error"),
        round4(F.max(ratio_error(F.col("ms"), F.col("elapsed_ms")))).alias("max_time_error"),
    )


def leave_one_out(samples: DataFrame, value: str = "output_size_ratio") -> DataFrame:
    """Per sample: its value against the upper median of its group's other samples.

    The median without a sample follows from its rank: the sorted others have it at (n-1) div 2, one
    further for samples that sort at or before that place. No pairs are made.
    """
    keys = ["phase_name", "codec", "preset", "backend"]
    w = W.partitionBy(*keys)
    ranked = samples.select(*keys, "id", value).withColumn("rn", F.row_number().over(w.orderBy(value, "id")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    at = F.floor((F.col("n") - 1) / 2)
    mids = ranked.where((F.col("rn") == at) | (F.col("rn") == at + 1)).groupBy(*keys).agg(F.min_by(value, "rn").alias("lo"), F.max_by(value, "rn").alias("hi"))
    mids = mids.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    return ranked.where("n > 1").join(mids, same).select("id", value, F.when(F.col("rn") <= at, F.col("hi")).otherwise(F.col("lo")).alias("median_of_others"))


def language_vote(samples: DataFrame) -> DataFrame:
    """(file_id, track, language, confidence) from samples (file_id, track, language, silence), silence being the
    hundredths of probability that nobody speaks.

    Samples above 90 are silent. A track of silent ones only is zxx with their mean probability; else
    the language with the largest sum of speech probabilities wins, its confidence that sum by all
    speaking samples. Two shares above 0.7 cannot occur together, so several languages never win at once.
    """
    keys = ["file_id", "track"]
    spoken = samples.where("silence <= 90").groupBy(*keys, "language").agg(F.sum(100 - F.col("silence")).alias("s"), F.count(F.lit(1)).alias("k"))
    top = spoken.groupBy(*keys).agg(F.min(F.struct((-F.col("s")).alias("m"), "language")).alias("top"), F.sum("k").alias("k"))
    every = samples.groupBy(*keys).agg(F.sum("silence").alias("silence"), F.count(F.lit(1)).alias("n"))
    share = F.when(F.col("top").isNull(), F.col("silence") / F.col("n")).otherwise(-F.col("top.m") / F.col("k"))
    return every.join(top, keys, "left").select(*keys, F.coalesce("top.language", F.lit("zxx")).alias("language"), round4(share / 100).alias("confidence"))


def conservative_crop(samples: DataFrame, least: int = 4) -> DataFrame:
    """Per file the smallest crop of all samples on each side, none under the least, snapped down to even numbers."""
    sides = ("left", "top", "right", "bottom")
    even = lambda c: (F.floor(c / 2) * 2).cast("long")
    low = samples.groupBy("file_id").agg(*(F.min(s).alias(s) for s in sides))
    return low.select("file_id", *(F.when(F.col(s) >= least, even(F.col(s))).otherwise(0).alias(s) for s in sides))
