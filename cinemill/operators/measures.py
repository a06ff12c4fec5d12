"""Crops, batch estimates, capabilities, lookups, fingerprints and redaction over rows of measurements."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values of the batch estimate: finished jobs before it is shown, smoothing and its bounds.
WARM_UP_JOBS, WARM_UP_SECONDS, PROGRESS_CAP, SMOOTHING, STEP_UP, STEP_DOWN = 2, 10, 0.98, 0.35, 1.30, 0.75
#: Hardware back ends by preference, and the names that mean them.
BACKENDS = ("nvenc", "qsv", "vaapi", "videotoolbox")
BACKEND_NAMES = {"cuda": "nvenc", "nvdec": "nvenc", "nvenc": "nvenc", "qsv": "qsv", "vaapi": "vaapi", "videotoolbox": "videotoolbox"}
VIDEO_FILE = r"[^\s/\\\"',;()\[\]{}<>]+\.(?:mkv|mp4|avi|mov|webm|m4v|ts)\b"
SECRET = r"(?i)\b(?:[a-z0-9_-]*(?:api[_-]?key|token|secret|password))[=:](\S+)"

SECRET_KEY = r"(?i)(?:api[_-]?key|token|secret|password)"
#: A text of a JSON document.
TOKEN = r'"(?:[^"\\]|\\.)*+"'


def _up_even(x: Column) -> Column:
    return x + x % 2


def merged_crop(samples: DataFrame, minimum: int, preserve_bottom: int, locks: list[tuple[int, int]]) -> DataFrame:
    """(file_id, left, top, right, bottom): one crop for all samples of a file, never more than any of them asks for.

    samples: (file_id, width, height, left, top, right, bottom). Sides under the minimum are not
    cropped, the bottom keeps preserve_bottom lines; among the aspect ratios of locks the output grows
    to the one that needs the fewest pixels more and fits the crop; an odd output loses a column or row.
    """
    low = samples.groupBy("file_id").agg(F.first("width").alias("w"), F.first("height").alias("h"), *(F.min(s).cast("long").alias(s) for s in ("left", "top", "right", "bottom")))
    for s in ("left", "top", "right", "bottom"):
        low = low.withColumn(s, F.when(F.col(s) < minimum, F.lit(0)).otherwise(F.col(s)))
    low = low.withColumn("bottom", F.greatest(F.col("bottom") - preserve_bottom, F.lit(0)))
    low = low.withColumn("ow", F.col("w") - F.col("left") - F.col("right")).withColumn("oh", F.col("h") - F.col("top") - F.col("bottom"))

    def given(start: Column, end: Column, more: Column) -> tuple[Column, Column]:
        """Both crops after the output grows by more: half from each, the rest from where there is some."""
        first = F.least(F.floor(more / 2), start)
        last = F.least(more - first, end)
        return start - first - (more - first - last), end - last

    ways = []
    for k, (rw, rh) in enumerate(locks):
        tall, wide = F.col("ow") * rh > F.col("oh") * rw, F.col("ow") * rh < F.col("oh") * rw
        height, width = _up_even(F.ceil(F.col("ow") * rh / rw)), _up_even(F.ceil(F.col("oh") * rw / rh))
        down, across = height - F.col("oh"), width - F.col("ow")
        (top, bottom), (left, right) = given(F.col("top"), F.col("bottom"), down), given(F.col("left"), F.col("right"), across)
        way = lambda pixels, left, top, right, bottom, k=k: F.struct(pixels.cast("long").alias("pixels"), F.lit(k).alias("k"), *(c.cast("long").alias(n) for c, n in ((left, "left"), (top, "top"), (right, "right"), (bottom, "bottom"))))
        ways.append(
            F.when(tall & (height <= F.col("h")) & (down <= F.col("top") + F.col("bottom")), way(down * F.col("ow"), F.col("left"), top, F.col("right"), bottom))
            .when(wide & (width <= F.col("w")) & (across <= F.col("left") + F.col("right")), way(across * F.col("oh"), left, F.col("top"), right, F.col("bottom")))
            .when(~tall & ~wide, way(F.lit(0), F.col("left"), F.col("top"), F.col("right"), F.col("bottom")))
        )
    if ways:
        low = low.withColumn("best", F.array_min(F.array_compact(F.array(*ways))))
        low = low.select("file_id", "w", "h", *(F.coalesce(F.col(f"best.{s}"), F.col(s)).alias(s) for s in ("left", "top", "right", "bottom")))
    odd = lambda size, a, b: (F.col(size) - F.col(a) - F.col(b)) % 2
    return low.select("file_id", "left", "top", (F.col("right") + odd("w", "left", "right")).cast("long").alias("right"), (F.col("bottom") + odd("h", "top", "bottom")).cast("long").alias("bottom"))


def batch_left(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is seen and what is left: (batch, completed, seconds_per_weight) and (batch, state, left, weight_left) of every open job.

    jobs: (batch, state queued|running|completed, weight, seconds, progress). The rate is all seconds
    seen by all weight seen, running jobs by the progress that they report (0.98 at most); NULL until a
    job is completed. A running job that reports none has come as far as its seconds tell at that rate.
    """
    state, weight, seconds = F.col("state"), F.col("weight"), F.col("seconds")
    told = F.when(state == "running", F.least(F.greatest(F.col("progress"), F.lit(0.0)), F.lit(PROGRESS_CAP)))  # NULL where none is reported
    told = F.when(F.col("progress").isNotNull(), told)
    moving = F.coalesce((state == "running") & (told > 0), F.lit(False))
    done = F.sum(F.when(state == "completed", weight).when(moving, weight * told))
    spent = F.sum(F.when((state == "completed") | moving, seconds))
    ended = F.coalesce(F.sum(F.when(state == "completed", weight)), F.lit(0.0))
    rate = jobs.groupBy("batch").agg(F.count_if(state == "completed").alias("completed"), F.when((ended > 0) & (spent > 0) & (done > 0), spent / done).alias("seconds_per_weight"))
    open_ = jobs.where("state in ('queued', 'running')").join(rate, "batch")
    expected = weight * F.col("seconds_per_weight")
    guess = F.when(expected > 0, F.least(F.greatest(seconds / expected, F.lit(0.0)), F.lit(PROGRESS_CAP)))
    progress = F.when(state == "running", F.coalesce(told, guess))
    total = F.greatest(expected, seconds)
    inferred = F.when(progress > 0, F.greatest(seconds / progress, total)).otherwise(total)
    left = F.when(state == "queued", expected).otherwise(F.greatest(inferred - seconds, F.lit(0.0)))
    return rate, open_.select("batch", "state", left.alias("left"), F.when(state == "running", weight * (1 - F.coalesce(progress, F.lit(0.0)))).otherwise(weight).alias("weight_left"))


def batch_estimate(jobs: DataFrame, workers: int) -> DataFrame:
    """Bounds of what batch_makespan gives: (batch, remaining, seconds_per_weight, eta_low, eta_high, confidence).

    eta_low is the larger of an even share and the longest job, eta_high an even share and the longest
    job on top of what the others leave. They take no pass over the jobs in order. NULL until
    WARM_UP_JOBS are completed.
    """
    rate, left = batch_left(jobs)
    sums = left.groupBy("batch").agg(F.sum("weight_left").alias("remaining"), F.sum("left").alias("all"), F.max("left").alias("longest"))
    out = rate.join(sums, "batch", "left").withColumn("remaining", F.coalesce("remaining", F.lit(0.0)))
    ready = (F.col("completed") >= WARM_UP_JOBS) & F.col("seconds_per_weight").isNotNull() & (F.col("remaining") > 0)
    share = F.col("all") / workers
    return out.select(
        "batch", "remaining", "seconds_per_weight", F.when(ready, F.greatest(share, F.col("longest"))).alias("eta_low"), F.when(ready, share + F.col("longest") * (1 - 1 / workers)).alias("eta_high"),
        F.when(F.col("remaining") <= 0, "high").when(~ready, "low").when(F.col("completed") >= WARM_UP_JOBS * 3, "high").otherwise("medium").alias("confidence"),
    )


def _deal(loads: list[float], duration: float, n: int) -> list[float]:
    """The workers' loads, as a heap, after n jobs of one duration each went to the least loaded worker.

    Once the loads lie within a duration of each other, as many jobs as there are workers give each of
    them one; whole rounds are added at once.
    """
    heapq.heapify(loads)
    while n:
        if n >= 2 * len(loads) and max(loads) - loads[0] <= duration:
            loads = [x + n // len(loads) * duration for x in loads]
            n %= len(loads)
        else:
            heapq.heapreplace(loads, loads[0] + duration)
            n -= 1
    return loads


def batch_makespan(jobs: DataFrame, workers: int, elapsed: DataFrame) -> DataFrame:
    """(batch, remaining, seconds_per_weight, eta, confidence): when the last job of each batch ends, if the waiting ones go, the longest
    first, to the worker that is free first.

    jobs as for batch_left; elapsed: (batch, elapsed) in seconds. eta is NULL while nothing is left, and
    until WARM_UP_JOBS are completed or WARM_UP_SECONDS have gone by, and while there is no rate.
    Waiting jobs of one duration are counted first; a batch's durations stream through its task in
    order, which keeps the workers' loads only.
    """
    rate, left = batch_left(jobs)
    queued = (F.col("state") == "queued").cast("int").alias("queued")
    runs = left.where("left IS NOT NULL AND (left > 0 OR state = 'running')").groupBy("batch", queued, "left").agg(F.count(F.lit(1)).alias("n"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch, loads, found = None, [], []

        def end(key, loads):
            return [(key, max(loads))] if loads else []

        for pdf in parts:
            for key, rows in pdf.groupby("batch", sort=False):
                if key != batch:
                    found += end(batch, loads)
                    batch, loads = key, []
                for waits, duration, n in rows[["queued", "left", "n"]].itertuples(index=False):
                    if not waits:
                        loads += [duration] * n
                    else:
                        loads += [0.0] * (workers - len(loads))
                        loads = _deal(loads, duration, n)
            yield pd.DataFrame(found, columns=["batch", "eta"])
            found = []
        yield pd.DataFrame(end(batch, loads), columns=["batch", "eta"])

    kind = jobs.schema["batch"].dataType.simpleString()
    ordered = runs.repartition("batch").sortWithinPartitions("batch", "queued", F.desc("left"))
    ends = ordered.mapInPandas(run, f"batch {kind}, eta double")
    sums = left.groupBy("batch").agg(F.sum("weight_left").alias("remaining"))
    out = rate.join(sums, "batch", "left").join(ends, "batch", "left").join(elapsed, "batch", "left").withColumn("remaining", F.coalesce("remaining", F.lit(0.0)))
    cold = (F.col("completed") < WARM_UP_JOBS) & (F.coalesce("elapsed", F.lit(0.0)) < WARM_UP_SECONDS)
    ready = (F.col("remaining") > 0) & ~cold & F.col("seconds_per_weight").isNotNull()
    return out.select(
        "batch", "remaining", "seconds_per_weight", F.when(ready & (F.col("eta") > 0), F.col("eta")).alias("eta"),
        F.when(F.col("remaining") <= 0, "high").when(~ready, "low").when(F.col("completed") >= WARM_UP_JOBS * 3, "high").otherwise("medium").alias("confidence"),
    )


def smoothed_eta(previous: Column, raw: Column) -> Column:
    """The next shown estimate: part of the way to the new one, within bounds of the previous."""
    step = F.least(F.greatest(previous + SMOOTHING * (raw - previous), previous * STEP_DOWN), previous * STEP_UP)
    return F.when(raw <= 0, None).when(previous.isNull(), raw).otherwise(step)


def backend(name: Column) -> Column:
    """The back end that a name means; unknown for others."""
    names = F.create_map(*(F.lit(x) for pair in BACKEND_NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, F.lower(name)), F.lit("unknown"))


def capabilities(executors: DataFrame, resource: str) -> DataFrame:
    """One row: (backends, best, parallel): the distinct back ends of all executors, the preferred one and the least positive limit of a resource.

    executors: (hw_accels array<string>, limits array<struct<resource, most>>).
    """
    limit = F.array_min(F.transform(F.filter("limits", lambda x: (x["resource"] == resource) & (x["most"] > 0)), lambda x: x["most"]))
    one = executors.select(F.transform("hw_accels", backend).alias("b"), limit.alias("limit"))
    row = one.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_distinct("b"))))).alias("backends"), F.min("limit").alias("parallel"))
    best = F.coalesce(*(F.when(F.array_contains("backends", b), b) for b in BACKENDS), F.lit("none"))
    return row.select("backends", best.alias("best"), "parallel")


def first_by_prefix(rows: DataFrame, path: str, catalogue: DataFrame, at_end: bool = False) -> DataFrame:
    """rows with name: the first catalogue row, by its order, with whose root the path begins (or ends); NULL if none.

    catalogue: (root, name, position). Only lengths that roots have are tried, each by equality, so no
    row meets the whole catalogue; the lengths are one broadcast row of distinct numbers.
    """
    lengths = catalogue.agg(F.array_sort(F.collect_set(F.length("root"))).alias("_lengths"))
    tried = rows.select(F.col(path).alias("_path")).distinct().crossJoin(F.broadcast(lengths))
    part = (lambda n: F.substring("_path", F.length("_path") - n + 1, n)) if at_end else (lambda n: F.substring("_path", F.lit(1), n))
    tried = tried.select("_path", F.explode(F.transform(F.filter("_lengths", lambda n: n <= F.length("_path")), part)).alias("root"))
    first = tried.join(catalogue, "root").groupBy("_path").agg(F.min_by("name", "position").alias("name"))
    return rows.join(first, F.col(path) == F.col("_path"), "left").drop("_path")


def content_fingerprint(content: Column, threshold: int = 2 << 20, chunk: int = 1 << 20) -> Column:
    """16 hex digits of SHA-256 over a small file's bytes, or over the size, head, middle and tail of a larger one."""
    size = F.octet_length(content)
    part = lambda at: F.substring(content, at + 1, F.lit(chunk))
    some = F.concat(size.cast("string").cast("binary"), part(F.lit(0)), part(F.floor(size / 2).cast("int")), part(size - chunk))
    return F.substring(F.sha2(F.when(size <= threshold, content).otherwise(some), 256), 1, 16)


def violations(metadata: Column) -> Column:
    """array<struct<kind, message>> of a file's metadata JSON; NULL where it has none; a value of another shape is an error."""
    text = F.get_json_object(metadata, "$.safeguard_violations")
    found = F.from_json(text, "array<struct<kind:string,message:string>>")
    bad = ~text.startswith("[") | found.isNull() | F.exists(found, lambda v: v.isNull() | v["kind"].isNull())
    return F.when(text.isNull(), None).when(bad, F.raise_error(F.concat(F.lit("malformed safeguard_violations: "), text))).otherwise(found)


def _met(kind: str, text: Column, pattern: str, group: int) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("was")))


def _placeholders(met: DataFrame) -> DataFrame:
    """(report, puts array<struct<size, was, put>>): what stands for each secret and video file name met, numbered within a report, the longest first.

    met: (report, line, pos, m struct<kind, was>). A report is what one person sends, so its numbering is a window of its own.
    """
    first = met.groupBy("report", "m.was").agg(F.min(F.struct(F.col("m.kind").alias("kind"), "line", "pos")).alias("x")).select("report", "was", "x.*")
    number = F.row_number().over(W.partitionBy("report", "kind").orderBy("line", "pos")) - 1
    ext = F.concat(F.lit("."), F.regexp_extract("was", r"\.([^.]+)$", 1))
    put = F.concat(F.col("kind"), F.lpad(number.cast("string"), 3, "0"), F.when(F.col("kind") == "video", ext).otherwise(""))
    return first.where("was <> ''").select("report", F.struct((-F.length("was")).alias("size"), "was", put.alias("put")).alias("e")).groupBy("report").agg(F.array_sort(F.collect_list("e")).alias("puts"))


def _put(text: Column) -> Column:
    return F.aggregate(F.coalesce("puts", F.array().cast("array<struct<size:int,was:string,put:string>>")), text, lambda acc, e: F.replace(acc, e["was"], e["put"]))


def redacted_reports(rows: DataFrame) -> DataFrame:
    """(report, line, text): video file names become video000.mkv and so on, secrets secret000, numbered within a report in the order first met; longer originals are replaced first.

    rows: (report, line, text).
    """
    met = rows.select("report", "line", F.posexplode(F.concat(_met("secret", F.col("text"), SECRET, 1), _met("video", F.col("text"), VIDEO_FILE, 0))).alias("pos", "m"))
    return rows.join(_placeholders(met), "report", "left").select("report", "line", _put(F.col("text")).alias("text"))


def redacted_documents(rows: DataFrame) -> DataFrame:
    """(report, line, document): JSON documents whose texts, at any depth, are redacted as redacted_reports() does; keys stay.

    rows: (report, line, document). The text under a key that means a secret is a secret as a whole.
    Numbers, booleans and nulls stay; keys come out in order, as JSON is parsed; a malformed document
    becomes NULL. The document's text tokens are cut out and put back, so depth does not matter.
    """
    df = rows.select("report", "line", F.to_json(F.try_parse_json("document")).alias("j"))
    df = df.withColumn("tokens", F.regexp_extract_all("j", F.lit(TOKEN), F.lit(0))).withColumn("gaps", F.split("j", TOKEN, -1))
    at = lambda c, i: F.try_element_at(c, i)
    key = lambda i: F.coalesce(F.startswith(at("gaps", i + 1), F.lit(":")), F.lit(False))
    order = F.when(F.size("tokens") > 0, F.sequence(F.lit(1), F.size("tokens"))).otherwise(F.array().cast("array<int>"))
    inner = lambda i: F.substring(at("tokens", i), F.lit(2), F.length(at("tokens", i)) - 2)
    secret = lambda i: F.coalesce((i > 1) & (at("gaps", i) == ":") & at("tokens", F.greatest(i - 1, F.lit(1))).rlike(SECRET_KEY), F.lit(False))

    def found(i: Column) -> Column:
        text = inner(i)
        whole = F.array(F.struct(F.lit("secret").alias("kind"), text.alias("was")))
        return F.when(key(i), F.array().cast("array<struct<kind:string,was:string>>")).when(secret(i), whole).otherwise(F.concat(_met("secret", text, SECRET, 1), _met("video", text, VIDEO_FILE, 0)))

    met = df.select("report", "line", F.posexplode(F.flatten(F.transform(order, found))).alias("pos", "m"))
    df = df.join(_placeholders(met), "report", "left")
    back = F.transform(order, lambda i: F.concat(at("gaps", i), F.when(key(i), at("tokens", i)).otherwise(_put(at("tokens", i)))))
    return df.select("report", "line", F.concat(F.array_join(back, ""), F.element_at("gaps", -1)).alias("document"))


def sample_plan(duration: Column, starts: Column, count: int, length: int) -> Column:
    """array<struct<start, length>>: count samples from the first of starts, none beyond the end and the last clipped to it; the whole if it is no longer than they are together."""
    wide = lambda s, n: F.struct(s.cast("double").alias("start"), n.cast("double").alias("length"))
    some = F.transform(F.filter(F.slice(starts, 1, count), lambda t: t < duration), lambda t: wide(F.greatest(t, F.lit(0.0)), F.least(F.lit(float(length)), duration - t)))
    return F.when(duration <= count * length, F.array(wide(F.lit(0.0), duration))).otherwise(some)


def uniform_starts(duration: Column, count: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: duration * (i + 0.5) / count)


def scene_starts(scenes: Column) -> Column:
    """Times of scene changes, array<struct<at, score>>, the strongest first."""
    return F.transform(F.array_sort(F.transform(scenes, lambda s: F.struct((-s["score"]).alias("o"), s["at"].alias("at")))), lambda s: s["at"])
