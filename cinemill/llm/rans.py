"""Token-id files coded with a static range asymmetric numeral system (rANS).

One frequency table, counted over all documents, is shared by every file. A file holds the ids of a
range of documents in ascending id order, cut into blocks of BLOCK tokens. A block is independent:
LANES interleaved coder states, one stream of 32-bit words, a CRC-32. The block index at the head of
a file is its list of checkpoints (first token, first word, checksum), so a reader can start at any
block and decode blocks in parallel; here all blocks of a file are decoded side by side.

Layout, little-endian: magic, five u64 (documents, tokens, blocks, id width, words), document ids
i64, their null flags u8, token counts u32, block index (first token u64, first word u64, crc u32),
lane states u64, words u32.

Defined cases: null text is empty; a null id sorts first and is kept as null; repeated ids keep
their own rows; an empty table gives no files and an empty result.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinemill.llm.common import discard, doc_text, shared_dir, stage, table
from cinemill.llm.tokens import encoder, tokenizer_path

MAGIC = b"CMRANS01"
BLOCK, LANES, SCALE = 65_536, 64, 20
LOW = np.uint64(1 << 31)
SEEN = pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())]))
INDEX = np.dtype([("token", "<u8"), ("word", "<u8"), ("crc", "<u4")])


class CorruptFile(ValueError):
    """A file or block whose checksum or structure does not hold."""


def scaled(counts: np.ndarray, bits: int = SCALE) -> np.ndarray:
    """Frequencies that sum to 2**bits, at least 1 for each symbol that occurs."""
    counts = np.asarray(counts, dtype=np.float64)
    seen = counts > 0
    if seen.sum() > 1 << bits:
        raise ValueError("more symbols than slots")
    out = np.zeros(len(counts), dtype=np.int64)
    if not seen.any():
        return out
    room = (1 << bits) - int(seen.sum())
    share = counts / counts.sum() * room
    out[seen] = 1 + np.floor(share[seen]).astype(np.int64)
    left = (1 << bits) - int(out.sum())
    order = np.lexsort((np.arange(len(counts)), -(share - np.floor(share))))
    out[order[seen[order]][:left]] += 1
    return out


class Table:
    """Shared coder tables made from the frequencies."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def encode_blocks(ids: np.ndarray, t: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index, lane states (blocks x LANES) and words of a run of ids; the last block may be short."""
    index, states, words, at = [], [], [], 0
    whole = len(ids) // BLOCK
    spans = [(b * BLOCK, min(b + 64, whole) * BLOCK) for b in range(0, whole, 64)]
    if len(ids) % BLOCK:
        spans.append((whole * BLOCK, len(ids)))
    for lo, hi in spans:
        n = min(BLOCK, hi - lo)
        part = ids[lo:hi].reshape(-1, n)
        if n % LANES:
            part = np.concatenate([part, np.full((1, -n % LANES), part[0, 0], part.dtype)], axis=1)
        blocks, steps = part.shape[0], part.shape[1] // LANES
        sym = np.ascontiguousarray(part.reshape(blocks, steps, LANES).transpose(1, 0, 2)).reshape(steps, -1)
        x = np.full(blocks * LANES, LOW, dtype=np.uint64)
        out, put = np.zeros(sym.shape, dtype=np.uint32), np.zeros(sym.shape, dtype=bool)
        for i in range(steps - 1, -1, -1):
            f, c = t.freq[sym[i]], t.start[sym[i]]
            full = x >= f << np.uint64(63 - SCALE)
            put[i] = full
            out[i] = x.astype(np.uint32)
            x = np.where(full, x >> np.uint64(32), x)
            q = x // f
            x = (q << np.uint64(SCALE)) + (x - q * f) + c
        for b in range(blocks):
            lanes = slice(b * LANES, (b + 1) * LANES)
            w = out[:, lanes][put[:, lanes]]
            crc = zlib.crc32(w.astype("<u4").tobytes(), zlib.crc32(x[lanes].astype("<u8").tobytes()))
            index.append((lo + b * BLOCK, at, crc))
            words.append(w)
            at += len(w)
        states.append(x.reshape(blocks, LANES))
    return (
        np.array(index, dtype=INDEX),
        np.concatenate(states) if states else np.zeros((0, LANES), np.uint64),
        np.concatenate(words) if words else np.zeros(0, np.uint32),
    )


def decode_blocks(index: np.ndarray, states: np.ndarray, words: np.ndarray, n_tokens: int, t: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of blocks first..last-1, each checked against its checksum."""
    last = len(index) if last is None else last
    ends = np.append(index["word"][1:], len(words)).astype(np.int64)
    for b in range(first, last):
        w = words[int(index["word"][b]) : ends[b]]
        if zlib.crc32(w.astype("<u4").tobytes(), zlib.crc32(states[b].astype("<u8").tobytes())) != index["crc"][b]:
            raise CorruptFile(f"block {b}: wrong checksum")
    lengths = np.diff(np.append(index["token"], n_tokens).astype(np.int64))
    out, mask, half = [], np.uint64((1 << SCALE) - 1), np.uint64(32)
    at = first
    while at < last:
        to = at
        while to < last and to - at < 64 and lengths[to] == lengths[at]:
            to += 1
        steps = -(-int(lengths[at]) // LANES)
        x = states[at:to].reshape(-1).copy()
        next_word = index["word"][at:to].astype(np.int64)
        got = np.zeros((steps, (to - at) * LANES), dtype=np.uint32)
        for i in range(steps):
            slot = x & mask
            s = t.symbol[slot]
            got[i] = s
            x = t.freq[s] * (x >> np.uint64(SCALE)) + slot - t.start[s]
            low = (x < LOW).reshape(-1, LANES)
            if low.any():
                rank = np.cumsum(low, axis=1)
                where = (next_word[:, None] + rank - 1)[low]
                next_word += rank[:, -1]
                low = low.reshape(-1)
                x[low] = (x[low] << half) | words[where].astype(np.uint64)
        ids = got.reshape(steps, to - at, LANES).transpose(1, 0, 2).reshape(to - at, -1)
        out.append(ids[:, : lengths[at]].reshape(-1))
        at = to
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def to_bytes(doc_ids: list, counts: np.ndarray, ids: np.ndarray, t: Table, width: int) -> bytes:
    index, states, words = encode_blocks(ids, t)
    head = struct.pack("<5Q", len(doc_ids), len(ids), len(index), width, len(words))
    body = [
        np.array([0 if d is None else d for d in doc_ids], dtype="<i8"), np.array([d is None for d in doc_ids], dtype="u1"),
        counts.astype("<u4"), index, states.astype("<u8"), words.astype("<u4"),
    ]
    raw = MAGIC + head + b"".join(x.tobytes() for x in body)
    return raw + struct.pack("<I", zlib.crc32(raw))


def from_bytes(raw: bytes, t: Table) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, token counts and ids of a file."""
    if raw[:8] != MAGIC or len(raw) < 52 or zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise CorruptFile("wrong magic or checksum")
    n_docs, n_tokens, n_blocks, _, n_words = struct.unpack("<5Q", raw[8:48])
    at = 48

    def take(dtype, n):
        nonlocal at
        x = np.frombuffer(raw, dtype=dtype, count=n, offset=at)
        at += x.nbytes
        return x

    docs, null, counts = take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs)
    index, states, words = take(INDEX, n_blocks), take("<u8", n_blocks * LANES).reshape(-1, LANES), take("<u4", n_words)
    ids = decode_blocks(index, states.astype(np.uint64), words, n_tokens, t)
    return [None if z else int(d) for d, z in zip(docs, null)], counts.astype(np.int64), ids


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


_TABLES: dict[str, Table] = {}


def _shared_table(uri: str) -> Table:
    if uri not in _TABLES:
        _TABLES.clear()
        store, path = _fs(uri)
        with store.open_input_file(path) as f:
            _TABLES[uri] = Table(np.frombuffer(f.read(), dtype="<u4").astype(np.int64))
    return _TABLES[uri]


def tokenised(df: DataFrame, tokenizer: str, end_id: int, vocabulary: int) -> DataFrame:
    """(doc_id, n_tokens, ids binary, seen) of every whole text, the end id included; besides, a row of each
    task in which only seen is set: the ids that it met and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        total = np.zeros(vocabulary, dtype=np.int64)

        def rows(doc, n, ids, seen):
            return pa.RecordBatch.from_arrays([doc, pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(seen, SEEN)], names=["doc_id", "n_tokens", "ids", "seen"])

        for batch in batches:
            ids = list(enc.encode_many((x.as_py() for x in batch.column(1)), end_id))
            if ids:
                total += np.bincount(np.concatenate(ids), minlength=vocabulary)
            yield rows(batch.column(0), [len(x) for x in ids], [x.tobytes() for x in ids], [None] * len(ids))
        at = np.nonzero(total)[0]
        yield rows(pa.array([None], pa.int64()), [None], [None], [[{"id": i, "n": n} for i, n in zip(at.tolist(), total[at].tolist())]])

    return doc_text(df).mapInArrow(run, "doc_id long, n_tokens long, ids binary, seen array<struct<id:long,n:long>>")


def count_ids(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """Occurrences of each id over all rows of tokenised(); the result has one number per vocabulary entry."""
    found = tokens.where("n_tokens is null").select(F.explode("seen").alias("s")).groupBy("s.id").agg(F.sum("s.n").alias("n")).toPandas()
    out = np.zeros(vocabulary, dtype=np.int64)
    out[found["id"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    return out


def write_files(df: DataFrame, at: str, tokenizer: str, end_id: int, tokens_per_file: int = 8_000_000) -> DataFrame:
    """Write a table's texts as token files under the folder ``at``; returns the manifest
    (file, piece: both long, in order; path, n_docs, n_tokens, n_bytes), one row per file.

    A range holds about tokens_per_file ids and a file at most twice that and a text; rows of one id
    are dealt out by their ids' hash, in whose order they stand."""
    enc = encoder(tokenizer)
    width, vocabulary = enc.dtype.itemsize, max(enc.lib.get_vocab_size(), end_id + 1)
    tokens = stage(tokenised(df, tokenizer, end_id, vocabulary), "ids")
    counts = count_ids(tokens, vocabulary)
    table_uri = f"{at}/table.freq"
    store, path = _fs(at)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/table.freq") as f:
        f.write(scaled(counts).astype("<u4").tobytes())
    files = max(1, math.ceil(int(counts.sum()) / tokens_per_file))
    kinds = "file long, piece long, path string, n_docs long, n_tokens long, n_bytes long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, (fs, folder) = TaskContext.get(), _fs(at)
        docs, sizes, ids, piece = [], [], [], 0

        def written() -> pa.RecordBatch:
            raw = to_bytes(docs, np.array(sizes), np.concatenate(ids), _shared_table(table_uri), width)
            name = f"part-{context.partitionId():08d}-{piece:06d}.rans"
            with fs.open_output_stream(f"{folder}/{name}.{context.taskAttemptId()}.tmp") as f:  # a retry never meets a half-written file
                f.write(raw)
            fs.move(f"{folder}/{name}.{context.taskAttemptId()}.tmp", f"{folder}/{name}")
            values = [context.partitionId(), piece, f"{at}/{name}", len(docs), sum(sizes), len(raw)]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["file", "piece", "path", "n_docs", "n_tokens", "n_bytes"])

        held = 0
        for batch in batches:
            for doc, n, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                docs.append(doc)
                sizes.append(n)
                ids.append(np.frombuffer(x.as_py(), dtype=f"<u{width}"))
                held += n
                if held >= 2 * tokens_per_file:  # a range may be larger than meant, so it is cut as it comes
                    yield written()
                    docs, sizes, ids, piece, held = [], [], [], piece + 1, 0
        if docs:
            yield written()

    rows = tokens.where("n_tokens is not null").select("doc_id", "n_tokens", "ids")
    ordered = rows.repartitionByRange(files, "doc_id", F.xxhash64("ids")).sortWithinPartitions("doc_id", F.xxhash64("ids"))
    manifest = stage(ordered.mapInArrow(run, kinds), "manifest")
    discard(tokens)
    return manifest


def read_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary as unsigned 32-bit) of the files a manifest lists."""
    files = manifest.withColumn("first", F.sum("n_tokens").over(W.orderBy("file", "piece")) - F.col("n_tokens")).select("path", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, path = _fs(uri)
                with store.open_input_file(path) as f:
                    raw = f.read()
                docs, counts, ids = from_bytes(raw, _shared_table(f"{uri.rpartition('/')[0]}/table.freq"))
                ends = np.cumsum(counts)
                for lo in range(0, len(docs), 2000):
                    hi = min(lo + 2000, len(docs))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(docs[lo:hi], pa.int64()), pa.array(first + ends[lo:hi] - counts[lo:hi]), pa.array(counts[lo:hi]),
                            pa.array([ids[e - n : e].astype("<u4").tobytes() for e, n in zip(ends[lo:hi], counts[lo:hi])], pa.binary()),
                        ], names=["doc_id", "start", "n_tokens", "ids"],
                    )

    workers = manifest.sparkSession.sparkContext.defaultParallelism
    return files.repartition(max(workers, 1) * 4).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op7_rans(spark, sf_dir: str) -> DataFrame:
    at = f"{shared_dir(spark)}/rans-{uuid.uuid4().hex}"
    manifest = write_files(table(spark, sf_dir, "documents"), at, tokenizer_path("byte_bpe_50k.json"), 2)
    return read_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
