"""The bounded sink: the stream gives what the table gives, and both what a plain loop gives."""

import datetime as dt
import random

import pytest

from cinemill.streaming.batching import Bounds, batched, batched_stream

START = dt.datetime(2024, 1, 1)
SCHEMA = "lane string, ts timestamp, id long, value long"


def plain(rows, size, seconds, capacity):
    out, lanes = [], {}
    for lane, ts, i, v in sorted(rows):
        lanes.setdefault(lane, []).append((ts, i, v))
    for lane, held in lanes.items():
        while held:
            opened = held[0][0]
            inside = [r for r in held if r[0] < opened + dt.timedelta(seconds=seconds)]
            held = held[len(inside) :]
            kept = inside[:capacity]
            for b in range(0, len(kept), size):
                part = kept[b : b + size]
                out.append((lane, opened, b // size, len(part), part[0][1], part[-1][1], sum(r[2] for r in part), 0))
            if len(inside) > capacity:
                out.append((lane, opened, None, 0, None, None, 0, len(inside) - capacity))
    return sorted(out, key=str)


def made(seed, n=600):
    r = random.Random(seed)
    rows = [(r.choice("abc"), START + dt.timedelta(milliseconds=r.choice([r.randint(0, 200_000), 50_000, r.randint(50_000, 60_000)])), i, r.randint(0, 9)) for i in range(n)]
    return rows + [r for r in rows if r[2] % 50 == 0]  # repeated records count


def got(df):
    return sorted((tuple(None if x is None else x for x in row) for row in df.collect()), key=str)


@pytest.mark.parametrize("bounds", [(7, 5, 20), (1, 1, 1), (1000, 30, 10_000)])
def test_table_equals_a_plain_loop(spark, bounds):
    size, seconds, capacity = bounds
    rows = made(1)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(batched(df, Bounds(size, seconds * 1_000_000, capacity))) == plain(rows, size, seconds, capacity)
    assert got(batched(df.limit(0), Bounds())) == []


def test_stream_equals_table_over_restarts(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    bounds, rows = Bounds(7, 5_000_000, 20), made(2)
    rows.sort(key=lambda r: (r[1], r[2]))
    r = random.Random(3)
    parts, at = [], 0
    while at < len(rows):
        n = r.randint(60, 150)
        part = rows[at : at + n]
        r.shuffle(part)
        parts.append(part)
        at += n
    parts[1], parts[0][-3:] = parts[1] + parts[0][-3:], parts[0][:0]  # some come late, but before the watermark passes them
    # the last one moves the watermark past all others
    parts.append([("end", START + dt.timedelta(hours=1), 10**6, 0)])

    def run(k):
        spark.createDataFrame(parts[k], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = batched_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), bounds, "3 minutes")
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        assert q.awaitTermination(180)

    for k in range(len(parts)):  # each run starts from the checkpoint of the one before
        run(k)
    wanted = batched(spark.createDataFrame(rows, SCHEMA), bounds)
    assert got(spark.read.parquet(f"{tmp_path}/out").select(*wanted.columns)) == got(wanted) == plain(rows, 7, 5, 20)


def test_only_what_has_gone_out(spark):
    rows = [("a", START + dt.timedelta(seconds=s), s, 1) for s in (0, 1, 2, 10, 11)]
    df, bounds = spark.createDataFrame(rows, SCHEMA), Bounds(2, 5_000_000, 100)
    assert [(x.n, x.first_id) for x in batched(df, bounds, "2024-01-01 00:00:04").collect()] == [(2, 0)]
    assert [(x.n, x.first_id) for x in batched(df, bounds, "2024-01-01 00:00:12").collect()] == [(2, 0), (1, 2), (2, 10)]


def plain_makespan(running, queued, workers):
    loads = list(running) + [0.0] * max(0, workers - len(running))
    for x in sorted(queued, reverse=True):
        loads[loads.index(min(loads))] += x
    return max(loads)


def test_runs_of_equal_jobs_equal_single_ones():
    from cinemill.operators.measures import _deal

    r = random.Random(4)
    for _ in range(300):
        loads = [r.choice([0.0, 1.5, 7.0, 40.0]) for _ in range(r.randint(1, 6))]
        jobs = sorted(((r.choice([0.5, 1.0, 3.25, 9.0]), r.randint(1, 60)) for _ in range(r.randint(0, 5))), reverse=True)
        got = list(loads)
        for duration, n in jobs:
            got = _deal(got, duration, n)
        wanted = plain_makespan(loads, [x for x, n in jobs for _ in range(n)], len(loads))
        assert max(got) == pytest.approx(wanted)
    assert max(_deal([0.0] * 8, 2.0, 80_000_003)) == 2.0 * 10_000_001


def test_makespan_of_batches(spark):
    from cinemill.operators.measures import batch_estimate, batch_makespan

    r, rows = random.Random(5), []
    for batch in range(6):
        rows += [(batch, "completed", 10.0, 20.0, None)] * (0 if batch == 4 else 3)
        rows += [(batch, "running", float(r.randint(1, 20)), float(r.randint(0, 30)), r.choice([None, 0.0, 0.3, 2.0])) for _ in range(batch)]
        rows += [(batch, "queued", float(r.randint(1, 9)), 0.0, None) for _ in range(0 if batch == 0 else 40)]
    df = spark.createDataFrame(rows, "batch int, state string, weight double, seconds double, progress double")
    elapsed = spark.createDataFrame([(b, 5.0) for b in range(6)], "batch int, elapsed double")
    got = {x.batch: x for x in batch_makespan(df, 3, elapsed).collect()}
    bounds = {x.batch: x for x in batch_estimate(df, 3).collect()}
    for b in (1, 2, 3, 5):
        mine = [x for x in rows if x[0] == b]
        told = [(w, s, min(p, 0.98)) for _, k, w, s, p in mine if k == "running" and p]
        rate = (60 + sum(s for _, s, _ in told)) / (30 + sum(w * p for w, _, p in told))
        running = []
        for _, k, w, s, p in mine:
            if k == "running":
                p = min(max(p, 0), 0.98) if p is not None else min(s / (w * rate), 0.98)
                total = max(w * rate, s)
                running.append(max((max(s / p, total) if p > 0 else total) - s, 0))
        wanted = plain_makespan(running, [w * rate for _, k, w, _, _ in mine if k == "queued"], 3)
        assert got[b].eta == pytest.approx(wanted) and got[b].confidence == "medium"
        assert bounds[b].remaining == pytest.approx(got[b].remaining)
        if len(running) <= 3:
            assert bounds[b].eta_low <= got[b].eta + 1e-9 and got[b].eta <= bounds[b].eta_high + 1e-9
    assert (got[0].eta, got[0].confidence) == (None, "high") and (got[4].eta, got[4].confidence) == (None, "low")
    late = {x.batch: x.confidence for x in batch_makespan(df.where("weight <> 10 OR batch <> 3"), 3, elapsed.selectExpr("batch", "50D AS elapsed")).collect()}
    assert late[3] == "low" and late[5] == "medium"  # without a rate there is no estimate
