"""Exact repeated-substring removal over all texts, with suffix arrays of bounded shards.

Each byte covered by a WIDTH-byte string that also starts anywhere else goes. Windows are dealt out
by content: a window belongs to the run of window starts that share its least GRAM-byte hash, so
all occurrences of a window have runs with the same hash (``h``). A run's bytes ("region") are first
merged with equal ones by digest, which takes copies out; a hash with one region seen once repeats
nowhere. Only hashes with several different regions need sorting: their regions are gathered into
shards of bounded size, where induced sorting and permuted common prefixes find every window start
that has an equal elsewhere. A hash with more than HOT different regions is compared window by window
through 128-bit digests, so no group grows with the data.

Defined cases: null text is empty and loses nothing; equal rows count as separate occurrences; a null
doc_id is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinemill.llm.common import doc_text, parts_for, stage, table
from cinemill.llm.suffix import permuted_lcp, suffix_array

WIDTH, HOT, SHARD_BYTES = 400, 4096, 1_500_000
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 17)
        up, down = np.full(size, BASE), np.full(size, np.uint64(pow(int(BASE), -1, 1 << 64)))
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0][:n], _POWERS[1][:n]


def runs(raw: bytes, width: int, gram: int) -> Iterator[tuple[int, int, int, int]]:
    """(hash, region digest, first window start, windows) of each run of a text; windows lie in one run each."""
    for chunk in range(0, max(0, len(raw) - width + 1), 1 << 22):
        b = np.frombuffer(raw[chunk : chunk + (1 << 22) + width - 1], dtype=np.uint8)
        up, down = _powers(len(b) + 1)
        total = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        h = (total[gram:] - total[:-gram]) * down[: len(b) - gram + 1] * MIX
        h ^= h >> np.uint64(32)
        key = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)  # ties: leftmost
        span, size, low = width - gram + 1, 1, key
        while size * 2 <= span:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < span:
            low = np.minimum(low[: len(h) - span + 1], low[span - size :])
        anchor = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.concatenate([[0], np.nonzero(np.diff(anchor))[0] + 1])
        n = np.diff(np.append(first, len(anchor)))
        hashes = h[anchor[first]].view(np.int64)
        for x, s, k in zip(hashes.tolist(), (first + chunk).tolist(), n.tolist()):
            yield x, xxhash.xxh3_64_intdigest(raw[s : s + k + width - 1]) - (1 << 63), s, k


def repeated_starts(regions: list[bytes], counts: list[int], width: int) -> list[list[tuple[int, int]]]:
    """Ranges of window starts in each region that have an equal window at another start of any region.

    counts: how often each region occurs. Regions are told apart by the byte 0xFF, which no UTF-8 text has.
    """
    t = np.frombuffer(b"\xff".join(regions) + b"\xff", dtype=np.uint8)
    size = np.array([len(r) for r in regions])
    begin = np.cumsum(size + 1) - (size + 1)
    weight = np.zeros(len(t), dtype=np.int64)
    for s, n, c in zip(begin.tolist(), size.tolist(), counts):
        weight[s : s + n - width + 1] = min(c, 2)
    sa = suffix_array(t)
    joined = permuted_lcp(t, sa)[sa] >= width
    cluster = np.cumsum(~joined) - 1
    many = np.bincount(cluster, weights=weight[sa]) >= 2
    hit = np.zeros(len(t) + 1, dtype=bool)
    hit[sa] = many[cluster]
    hit[:-1] &= weight > 0
    out = []
    for s, n in zip(begin.tolist(), size.tolist()):
        h = np.concatenate([[False], hit[s : s + n], [False]])
        edge = np.nonzero(h[1:] != h[:-1])[0]
        out.append([(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2])])
    return out


def _runs_of(docs: DataFrame, width: int, gram: int) -> DataFrame:
    def rows(found: list) -> pa.RecordBatch:
        cols = zip(*found) if found else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=["doc_id", "th", "h", "region", "lo", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            for d, t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for r in runs(text.as_py().encode(), width, gram):
                    found.append((d, t, *r))
                    if len(found) >= 100_000:  # a periodic text has a run for each byte
                        yield rows(found)
                        found = []
        yield rows(found)

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, h long, region long, lo long, n long")


def _same(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def repeated_ranges(docs: DataFrame, width: int = WIDTH, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, th, ranges array<struct<s0, s1>>): window starts, ends included, that occur elsewhere too.

    docs: (doc_id, th, text), th the text's xxhash64.
    """
    gram = max(1, width * 8 // 25)
    found = stage(_runs_of(docs, width, gram), "runs")
    regions = found.groupBy("h", "region").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n"), F.min(F.struct("doc_id", "th", "lo")).alias("at"))
    regions = stage(regions, "regions")
    hashes = regions.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.sum("c").alias("all")).where("all > 1")
    regions = regions.join(hashes.select("h", "kinds"), "h")
    full = regions.where("c > 1").select("h", "region", F.lit(0).cast("long").alias("s0"), (F.col("n") - 1).alias("s1"))
    mixed = regions.where("kinds > 1")
    size, most = mixed.agg(F.coalesce(F.sum(F.when(F.col("kinds") <= hot, F.col("n") + width)), F.lit(0)), F.coalesce(F.max("kinds"), F.lit(0))).first()

    wanted = mixed.select("at.doc_id", "at.th", F.struct("h", "region", "at.lo", "n", "c", "kinds").alias("r")).groupBy("doc_id", "th").agg(F.collect_list("r").alias("rs"))
    shards = parts_for(size, shard_bytes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, rs in zip(batch.column(0), batch.column(1)):
                raw = text.as_py().encode()
                for r in rs.as_py():
                    part = raw[r["lo"] : r["lo"] + r["n"] + width - 1]
                    if r["kinds"] <= hot:
                        out.append((r["h"], r["region"], r["c"], -1, part))
                    else:
                        out += [(r["h"], r["region"], r["c"], i, hashlib.blake2b(part[i : i + width], digest_size=16).digest()) for i in range(r["n"])]
                    if len(out) >= 20_000:
                        yield _batch(out)
                        out = []
            yield _batch(out)

    def _batch(rows):
        kinds = [pa.int64()] * 4 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["h", "region", "c", "off", "part"])

    pieces = docs.join(wanted, _same(docs, wanted)).select("text", "rs").mapInArrow(cut, "h long, region long, c long, off long, part binary")
    pieces = stage(pieces, "pieces")

    def sort_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["h", "region"]).sort_values(["h", "region"])
        found = repeated_starts(pdf["part"].tolist(), pdf["c"].tolist(), width)
        rows = [(h, r, a, b) for h, r, spans in zip(pdf["h"].tolist(), pdf["region"].tolist(), found) for a, b in spans]
        return pd.DataFrame(rows, columns=["h", "region", "s0", "s1"]).astype("int64")

    marks = full.unionByName(
        pieces.where("off < 0").withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards))).groupBy("shard").applyInPandas(sort_shard, "h long, region long, s0 long, s1 long")
    )
    if most > hot:
        windows = pieces.where("off >= 0").select("h", "region", "off", "c", "part").dropDuplicates(["h", "region", "off"])
        often = windows.groupBy("part").agg(F.sum("c").alias("k")).where("k > 1").select("part")
        marks = marks.unionByName(windows.join(often, "part").select("h", "region", F.col("off").alias("s0"), F.col("off").alias("s1")))
    marks = stage(marks.distinct(), "marks")
    spans = found.join(marks, ["h", "region"]).select("doc_id", "th", F.struct((F.col("lo") + F.col("s0")).alias("s0"), (F.col("lo") + F.col("s1")).alias("s1")).alias("r"))
    return spans.groupBy("doc_id", "th").agg(F.collect_set("r").alias("ranges"))


def _keep(raw: bytes, ranges: list[tuple[int, int]], width: int) -> tuple[bytes, int, int]:
    """The bytes left, how many were removed and in how many maximal runs."""
    kept, at, removed, spans = [], 0, 0, 0
    end = None
    for a, b in sorted(ranges):
        b += width
        if end is None or a > end:
            if end is not None:
                removed += end - begin
            kept.append(raw[at if end is None else end : a])
            begin, end, spans = a, b, spans + 1
        else:
            end = max(end, b)
    if end is None:
        return raw, 0, 0
    kept.append(raw[end:])
    return b"".join(kept), removed + end - begin, spans


def remove_repeats(df: DataFrame, width: int = WIDTH, hot: int = HOT, shard_bytes: int = SHARD_BYTES, keep_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary, text) of every row; text is what is
    kept, in which part of a letter reads as U+FFFD."""
    docs = doc_text(df).select("doc_id", F.xxhash64("text").alias("th"), "text")
    ranges = repeated_ranges(docs, width, hot, shard_bytes)
    joined = docs.join(ranges, _same(docs, ranges), "left").select(docs["doc_id"], "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(6)]
            for text, rs in zip(batch.column(1), batch.column(2)):
                raw = text.as_py().encode()
                kept, removed, spans = _keep(raw, [(r["s0"], r["s1"]) for r in rs.as_py() or ()], width)
                for column, value in zip(out, (len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None, kept.decode(errors="replace"))):
                    column.append(value)
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(out, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "text"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, text string")


def op3_substrings(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_bytes=False).drop("kept")
