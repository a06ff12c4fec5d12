"""Queries over tool output by lines, failures with their probes, and nested records with their differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinemill.functions import media as M
from cinemill.operators import audit as A
from cinemill.operators import lines as N
from cinemill.operators import records as R
from cinemill.plans.audit_queries import SIG
from cinemill.plans.registry import query
from cinemill.sources import library as L


def _output(spark, d):
    """Each document as a tool's output: every other line is progress, some hardware's noise or a warning."""
    i = F.col("i")
    lines = L.read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x"))
    line = F.when(i % 4 == 1, F.concat(F.lit(" frame= "), i.cast("string"), F.lit(" fps=25 size="))).when(i % 7 == 3, "warning: old option").when(i % 9 == 4, "[cuda] No device available for decoder").when(i % 11 == 5, " ").otherwise(F.col("x"))
    out = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", line.alias("x")))).alias("o"))
    end = F.when(F.col("doc_id") % 3 == 0, "\r").when(F.col("doc_id") % 3 == 1, "\r\n").otherwise("\n")
    return out.select("doc_id", F.array_join(F.transform("o", lambda e: e["x"]), "\n").alias("text"), F.regexp_replace(F.array_join(F.transform("o", lambda e: e["x"]), "\n"), F.lit("\n"), end).alias("mixed"))


_LINES = """l AS (
      SELECT doc_id, i, CASE WHEN i % 4 = 1 THEN ' frame= ' || i || ' fps=25 size=' WHEN i % 7 = 3 THEN 'warning: old option' WHEN i % 9 = 4 THEN '[cuda] No device available for decoder' WHEN i % 11 = 5 THEN ' ' ELSE x END AS x
      FROM (SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)))"""


@query(
    "b14_progress_removed",
    f"""
    WITH {_LINES}, k AS (
      SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS kept, max(i) AS top FROM l WHERE i % 4 <> 1
        AND (i >= (SELECT min(i) FROM l AS a WHERE a.doc_id = l.doc_id AND i % 4 <> 1 AND x <> '')) AND (i <= (SELECT max(i) FROM l AS a WHERE a.doc_id = l.doc_id AND i % 4 <> 1 AND x <> '')) GROUP BY 1),
    w AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS whole, max(i) AS top FROM l GROUP BY 1)
    SELECT w.doc_id, w.doc_id % 5 AS kind, CASE WHEN w.doc_id % 5 = 4 THEN NULL WHEN w.top < 1 THEN w.whole ELSE coalesce(k.kept, '') END AS tail,
      w.doc_id % 5 < 4 AND w.top >= 1 AS sorted FROM w LEFT JOIN k ON k.doc_id = w.doc_id
    """,
)
def progress_removed(spark, d):
    df = _output(spark, d)
    k = F.col("doc_id") % 5
    # in every fifth the tail is no text, which leaves the result alone
    result = F.when(k == 4, F.concat(F.lit('{"z":1,"detail":{"stderr_tail":[1],"exit_code":'), k.cast("string"), F.lit("}}"))).otherwise(
        F.to_json(F.struct(k.alias("z"), F.struct(F.when(F.col("text").contains("frame="), F.col("mixed")).otherwise(F.col("text")).alias("stderr_tail"), k.alias("exit_code")).alias("detail"))))
    out = df.select("doc_id", k.alias("kind"), result.alias("was"), N.progress_removed(result).alias("now"))
    return out.select("doc_id", "kind", F.when(k != 4, F.get_json_object("now", "$.detail.stderr_tail")).alias("tail"), F.startswith("now", F.lit('{"detail":{"exit_code"')).alias("sorted"))


@query("b15_warnings_with_lines", f"WITH {_LINES} SELECT doc_id AS log, i + 1 AS line, x AS text FROM l WHERE starts_with(x, 'warning:')")
def warnings(spark, d):
    return N.warnings(_output(spark, d), "doc_id", "mixed")


@query(
    "x29_line_classes",
    f"""
    WITH {_LINES}, w AS (SELECT doc_id, count(*) FILTER (trim(x, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) <> '') AS full_lines, count(*) FILTER (trim(x) <> '' AND contains(x, 'No device available for decoder')) AS noise, count(*) - CASE WHEN max_by(x, i) = '' THEN 1 ELSE 0 END AS n FROM l GROUP BY 1)
    SELECT doc_id, full_lines - CASE WHEN doc_id % 2 = 0 THEN noise ELSE 0 END AS errors, CASE WHEN doc_id % 4 = 0 THEN 'error' WHEN full_lines = 0 THEN 'ok' ELSE 'warning' END AS quick,
      CASE WHEN doc_id % 4 = 0 OR full_lines = 0 THEN 0 ELSE n END AS warnings FROM w
    """,
)
def line_classes(spark, d):
    k, quick = F.col("doc_id"), N.quick_check(F.col("doc_id") % 4 != 0, F.col("text"))
    return _output(spark, d).select("doc_id", N.error_lines(F.col("text"), k % 2 == 0).alias("errors"), quick["outcome"].alias("quick"), quick["warnings"].cast("long").alias("warnings"))


_FAILED = f"""p AS (
      SELECT id AS plan_id, file_id, phase_name AS phase, {{errors}} AS error_message,
        CASE WHEN id % 3 <> 0 THEN CAST(id % 4 AS VARCHAR) ELSE '' END AS exit_code FROM plans WHERE status = 'failed'),
    v AS (SELECT file_id, arg_min(codec, stream_index) AS video_codec, arg_min(width, stream_index) AS width FROM tracks WHERE track_type = 'video' GROUP BY 1),
    c AS (
      SELECT p.*, {SIG} AS signature, coalesce(f.container, '') AS container, coalesce(v.video_codec, '') AS video_codec, coalesce(f.path, '') AS path,
        CASE WHEN v.width IS NULL THEN '' ELSE v.width || 'x' || (v.width // 2) END AS resolution
      FROM p LEFT JOIN files f ON f.id = p.file_id LEFT JOIN v ON v.file_id = f.id)"""


@query(
    "b07_failure_clusters_by_probe",
    f"""
    WITH {_FAILED.format(errors=L._case(L.ERRORS, "id"))},
    r AS (SELECT phase, signature, exit_code, container, video_codec, resolution, count(*) AS n, min(plan_id) AS first FROM c WHERE resolution <> '' GROUP BY ALL),
    t AS (SELECT phase, signature, exit_code, container, video_codec, arg_max(resolution, n * 1000000000 - first) AS top_resolution FROM r GROUP BY ALL)
    SELECT c.phase, c.signature, c.exit_code, c.container, c.video_codec, count(*) AS n, coalesce(any_value(t.top_resolution), '') AS top_resolution,
      arg_min(path, plan_id) AS sample_path, min(plan_id) AS sample_plan_id, arg_min(CASE WHEN c.signature IN ('unknown', 'cuda-decoder-packet-oom') AND plan_id % 3 <> 0 THEN error_message || ' | x' ELSE error_message END, plan_id) AS sample_error
    FROM c LEFT JOIN t ON t.phase = c.phase AND t.signature = c.signature AND t.exit_code = c.exit_code AND t.container = c.container AND t.video_codec = c.video_codec GROUP BY c.phase, c.signature, c.exit_code, c.container, c.video_codec
    """,
)
def failure_clusters(spark, d):
    k, error = F.col("id"), L.pick(L.ERRORS, F.col("id"))
    # every third result is no JSON
    result = F.when(k % 3 != 0, F.to_json(F.struct(error.alias("error"), F.struct(F.lit("\n x\n").alias("stderr_tail"), (k % 4).alias("exit_code")).alias("detail")))).otherwise(error)
    failed = L.plans(spark, d).where("status = 'failed'").select(k.alias("plan_id"), "file_id", F.col("phase_name").alias("phase"), result.alias("result"))
    files = L.files(spark, d).select(F.col("id").alias("file_id"), "path", "container")
    video = L.tracks(spark, d).where("track_type = 'video'").groupBy("file_id").agg(F.min_by(F.struct("codec", "width"), "stream_index").alias("v"))
    probed = files.join(video, "file_id", "left").select("path", "container", F.col("v.codec").alias("video_codec"), F.col("v.width").alias("width"), (F.col("v.width") / 2).cast("int").alias("height"))
    return A.failure_clusters(failed, files, probed)


@query(
    "x18_error_signatures",
    f"SELECT id, {SIG} AS signature FROM (SELECT id, {L._case(L.ERRORS, 'id')} || CASE WHEN id % 5 = 0 THEN ' Conversion failed' ELSE '' END AS error_message FROM transitions)",
)
def signatures(spark, d):
    k = F.col("id")
    return L.transitions(spark, d).select("id", M.error_signature(F.concat(L.pick(L.ERRORS, k), F.when(k % 5 == 0, " Conversion failed").otherwise(""))).alias("signature"))


@query(
    "s17_nested_records",
    """
    WITH v AS (SELECT file_id, list({'id': id, 'mode': mode, 'outcome': outcome} ORDER BY id) AS verifications FROM verifications GROUP BY 1),
    h AS (SELECT file_id, list({'id': id, 'outcome': outcome} ORDER BY id) AS transitions FROM transitions GROUP BY 1),
    t AS (
      SELECT file_id, list({'index': stream_index, 'codec': codec, 'width': width} ORDER BY stream_index) FILTER (starts_with(track_type, 'video')) AS video, list({'index': stream_index, 'codec': codec, 'channels': channels} ORDER BY stream_index) FILTER (starts_with(track_type, 'audio')) AS audio,
        list({'index': stream_index, 'title': title} ORDER BY stream_index) FILTER (starts_with(track_type, 'subtitle')) AS subtitle, list({'index': stream_index, 'codec': codec} ORDER BY stream_index) FILTER (starts_with(track_type, 'attachment')) AS attachment FROM tracks GROUP BY 1)
    SELECT f.id, path, size, list_transform(coalesce(video, []), lambda x: x.index || ':' || x.codec || ':' || coalesce(CAST(x.width AS VARCHAR), '-')) AS video,
      list_transform(coalesce(audio, []), lambda x: x.index || ':' || x.codec || ':' || coalesce(CAST(x.channels AS VARCHAR), '-')) AS audio, list_transform(coalesce(subtitle, []), lambda x: x.index || ':' || x.title) AS subtitle,
      list_transform(coalesce(attachment, []), lambda x: x.index || ':' || x.codec) AS attachment, list_transform(coalesce(verifications, []), lambda x: x.id || ':' || x.mode || ':' || x.outcome) AS verifications,
      list_transform(coalesce(transitions, []), lambda x: x.id || ':' || x.outcome) AS transitions
    FROM files f LEFT JOIN t ON t.file_id = f.id LEFT JOIN v ON v.file_id = f.id LEFT JOIN h ON h.file_id = f.id
    """,
)
def nested_records(spark, d):
    by_id = lambda df: df.withColumnRenamed("file_id", "fid")
    parents = L.files(spark, d).select(F.col("id").alias("fid"), F.col("id"), "path", "size")
    logs = {"verifications": (by_id(L.verifications(spark, d).select("file_id", "id", "mode", "outcome")), "id"), "transitions": (by_id(L.transitions(spark, d).select("file_id", "id", "outcome")), "id")}
    df = R.nested(parents, "fid", **R.bucketed(by_id(L.tracks(spark, d)), "fid"), **logs)
    shown = lambda c, *fields: F.transform(c, lambda x: F.concat_ws(":", *(F.coalesce(x[f].cast("string"), F.lit("-")) for f in fields))).alias(c)
    return df.select("id", "path", "size", shown("video", "index", "codec", "width"), shown("audio", "index", "codec", "channels"), shown("subtitle", "index", "title"), shown("attachment", "index", "codec"), shown("verifications", "id", "mode", "outcome"), shown("transitions", "id", "outcome"))


IGNORED = """
# times differ between listings
mtime
audio[].title
attachment
"""


def _after(spark, d):
    """Records before and after: files gone and come, scalars and tracks changed, added, removed and in another order."""
    k, i = F.col("id"), F.col("stream_index")
    cols = ("file_id", "stream_index", "track_type", "codec", "title", "is_default")
    tracks = L.tracks(spark, d).select(*cols)
    files = L.files(spark, d).select("id", "path", "container", "duration", "size", F.col("id").alias("mtime"), "content_hash")
    before = R.nested(files.where("id % 10 <> 1").select(F.col("id").alias("file_id"), "*"), "file_id", **R.bucketed(tracks))
    f = F.col("file_id")
    changed = tracks.where(~((f % 5 == 0) & (i == 2))).withColumns({
        "codec": F.when((f % 3 == 0) & (i == 1), F.concat("codec", F.lit("2"))).otherwise(F.col("codec")), "title": F.concat(F.when(f % 4 == 0, "new ").otherwise(""), F.col("title")), "is_default": F.when(f % 6 == 0, ~F.col("is_default")).otherwise(F.col("is_default"))})
    added = files.where("id % 7 = 0").select(k.alias("file_id"), F.lit(99).alias("stream_index"), F.lit("subtitle_main").alias("track_type"), F.lit("ass").alias("codec"), F.lit("added").alias("title"), F.lit(False).alias("is_default"))
    now = files.where("id % 10 <> 2").withColumns({"container": F.when(k % 11 == 0, "zzz").otherwise(F.col("container")), "duration": F.col("duration") * F.when(k % 13 == 0, 1.5).otherwise(1.004), "mtime": k + 1, "content_hash": F.when(k % 2 == 0, F.col("content_hash"))})
    after = R.nested(now.select(F.col("id").alias("file_id"), "*"), "file_id", **R.bucketed(changed.unionByName(added)))
    return before, after.withColumns({b: F.reverse(b) for b in R.BUCKETS})


@query(
    "b03_nested_record_changes",
    """
    WITH f AS (SELECT id, path, container, id % 10 <> 1 AS l, id % 10 <> 2 AS r FROM files),
    k AS (
      SELECT file_id, stream_index, track_type, codec, title, is_default, split_part(track_type, '_', 1) AS bucket,
        CASE WHEN file_id % 5 = 0 AND stream_index = 2 THEN ['-#2(' || codec || ')']
          ELSE list_filter([CASE WHEN file_id % 3 = 0 AND stream_index = 1 THEN '#1.codec:' || codec || '→' || codec || '2' END, CASE WHEN file_id % 6 = 0 THEN '#' || stream_index || '.is_default:' || is_default || '→' || (NOT is_default) END,
            CASE WHEN file_id % 4 = 0 AND NOT starts_with(track_type, 'audio') THEN '#' || stream_index || '.title:' || title || '→new ' || title END], lambda x: x IS NOT NULL) END AS parts FROM tracks
      UNION ALL SELECT id, 99, '', '', '', false, 'subtitle', ['+#99(ass)'] FROM files WHERE id % 7 = 0),
    b AS (SELECT file_id, bucket, array_to_string(flatten(list(parts ORDER BY stream_index)), '; ') AS details FROM k WHERE bucket <> 'attachment' GROUP BY ALL)
    SELECT path, CASE WHEN l THEN 'left-only' ELSE 'right-only' END AS side, '-' AS field, '-' AS details FROM f WHERE NOT (l AND r)
    UNION ALL SELECT path, 'both', 'container', container || ' → zzz' FROM f WHERE l AND r AND id % 11 = 0
    UNION ALL SELECT path, 'both', 'duration', 'changed' FROM f WHERE l AND r AND id % 13 = 0 AND id IN (SELECT id FROM files WHERE duration > 0)
    UNION ALL SELECT path, 'both', bucket, details FROM b JOIN f ON f.id = b.file_id WHERE l AND r AND details <> ''
    """,
)
def nested_record_changes(spark, d):
    found = R.record_changes(*_after(spark, d), ignored=IGNORED)
    return found.withColumn("details", F.when(F.col("field") == "duration", F.when(F.col("details").rlike(r"^\S+ → \S+ \(\+50\.00%\)$"), "changed")).otherwise(F.col("details")))
