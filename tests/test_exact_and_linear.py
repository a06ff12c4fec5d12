"""Ties of sizes, and steps whose work must not grow faster than their input."""

import json
import time

from pyspark.sql import functions as F

from cinemill.functions import media as M
from cinemill.operators import lines as N


def test_size_ties_go_to_the_even_digit(spark):
    mib, gib = 1 << 20, 1 << 30
    rows = [(2560,), (1536,), (mib + mib // 4,), (mib + mib // 4 * 3,), (gib + gib // 8,), (gib + gib // 8 * 5,), (mib - 1,), (gib - 1,), (1023,), ((1 << 63) - 1,), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "n long").select(M.format_size(F.col("n"))).collect()]
    assert got == ["2 KiB", "2 KiB", "1.2 MiB", "1.8 MiB", "1.12 GiB", "1.62 GiB", "1024 KiB", "1024.0 MiB", "1023 B", "8589934592.00 GiB", None]


def test_progress_of_a_long_output_goes_in_one_pass(spark):
    own = [f"line {i}" if i % 3 else "" for i in range(4000)]
    text = "\r\n".join(x for i, line in enumerate(own) for x in (line, f"frame= {i} fps=25"))
    result = json.dumps({"z": 1, "detail": {"stderr_tail": text, "exit_code": 0}})
    df = spark.createDataFrame([(result,), (None,), ("no json",), (json.dumps({"detail": {"stderr_tail": "frame=1 fps=2\n\n"}}),)], "r string")
    began = time.time()
    got = [r[0] for r in df.select(N.progress_removed(F.col("r"))).collect()]
    assert time.time() - began < 20
    assert json.loads(got[0])["detail"]["stderr_tail"] == "\n".join(own).strip("\n") and got[1:3] == [None, "no json"]
    assert json.loads(got[3])["detail"]["stderr_tail"] == ""


def test_greedy_cover_reads_its_features_once(spark):
    from cinemill.operators.catalogue import greedy_cover

    read = spark.sparkContext.accumulator(0)

    def touched(row):
        read.add(1)
        return row

    rows = [(i, 10 + i % 7, f"{i % 50}{c}") for i in range(200) for c in "abc"[: 1 + i % 3]]
    features = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4).map(touched), "item long, size long, feature string")
    assert greedy_cover(features, 6, 1000).count() == 6
    assert read.value == len(rows)


def planned(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_probe_document_is_parsed_once(spark):
    from cinemill.operators import probe as P

    documents = spark.createDataFrame([("/a.mkv", "{}")], "path string, document string")
    assert planned(P.probed_tracks(documents)).count("parseJson") == 1


def test_safeguards_are_planned_for_what_they_could_take_back(spark, sf_dir):
    from cinemill.plans import policy as P
    from cinemill.sources import library as L

    df = L.with_tracks(spark, sf_dir)
    spark.conf.set("spark.sql.maxMetadataStringLength", 100_000)
    plan = lambda *ops: planned(P.evaluate(df, {"phases": [{"name": "a", "operations": list(ops)}]}))
    assert "remove_track" not in plan({"verify": "quick"}) and "convert_container" not in plan({"warn": "x"})
    inner = {"when": {"field": "file.size", "is": [">", 0]}, "then": [{"remove": "audio"}, {"container": "mp4"}]}
    assert "remove_track" in plan(inner) and "convert_container" in plan(inner)


def test_buckets_take_one_pass_over_the_tracks(spark):
    from cinemill.operators import records as R

    tracks = spark.createDataFrame([(1, 0, "video", "h264"), (1, 1, "audio_main", "aac"), (1, 2, "audio_main", "ac3"), (2, 0, "subtitle_main", "ass")], "file_id long, stream_index int, track_type string, codec string")
    parents = spark.createDataFrame([(1, "a"), (3, "c")], "file_id long, path string")
    df = R.nested(parents, "file_id", **R.bucketed(tracks))
    assert planned(df).count("LogicalRDD") == 2
    got = {r.path: ([t.codec for t in r.video], [t["index"] for t in r.audio], r.subtitle) for r in df.collect()}
    assert got == {"a": (["h264"], [1, 2], []), "c": ([], [], [])}
