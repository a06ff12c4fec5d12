"""Media columns: AVI motion JPEG that stores bytes without loss, read back into timed clips.

A payload is laid out as 8-bit grey samples, WIDTH to a row, HEIGHT rows to a frame (the last frame
may be lower). Each frame is one JPEG of the lossless process (SOF3, predictor 1) with a restart
marker every RESTART rows, and frames lie in a RIFF AVI file with an index. Reading parses the RIFF
chunks and the index, checks them against each other, and decodes the restart intervals of many
frames side by side. A shot ends where a frame's histogram moves from its predecessor's by more than
the recent mean plus SIGMAS deviations; a shot is a clip with start and end in milliseconds.

Defined cases: null text is empty and fills one row of zeros; equal texts give equal files; repeated
rows are handled each; an empty table gives an empty result; a damaged file raises CorruptMedia.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinemill.llm.common import doc_text, table

WIDTH, HEIGHT, RESTART, FRAME_MS = 64, 64, 8, 40
SIGMAS, WINDOW, FLOOR = 3.0, 8, 0.1
#: Code lengths of the difference categories 0 to 8 in the Huffman table that every frame carries.
LENGTHS = (5, 5, 4, 3, 3, 3, 2, 3, 4)
GROUP = 2 << 20


class CorruptMedia(ValueError):
    """A media value that does not parse or decode."""


def _canonical(counts: bytes, values: bytes) -> dict[int, tuple[int, int]]:
    """category -> (code, length) of a JPEG Huffman table."""
    out, code, k = {}, 0, 0
    for n, c in enumerate(counts, 1):
        for _ in range(c):
            out[values[k]] = (code, n)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _table() -> tuple[bytes, bytes]:
    order = sorted(range(len(LENGTHS)), key=lambda c: (LENGTHS[c], c))
    return bytes(LENGTHS.count(n) for n in range(1, 17)), bytes(order)


@lru_cache(maxsize=1)
def _codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number (code and extra bits) for each difference -255..255."""
    table, bits, size = _canonical(*_table()), np.zeros(511, dtype=np.int64), np.zeros(511, dtype=np.int64)
    for d in range(-255, 256):
        category = abs(d).bit_length()
        code, n = table[category]
        bits[d + 255] = code << category | (d if d >= 0 else d + (1 << category) - 1)
        size[d + 255] = n + category
    return bits, size


@lru_cache(maxsize=8)
def _lookup(counts: bytes, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Difference and number of bits for each 16-bit window; zero bits where no code fits."""
    diff, size = np.zeros(1 << 16, dtype=np.int16), np.zeros(1 << 16, dtype=np.uint8)
    for category, (code, n) in _canonical(counts, values).items():
        if category > 8 or n + category > 16:
            raise CorruptMedia("a code that 8-bit samples do not need")
        for extra in range(1 << category):
            d = extra if not category or extra >> (category - 1) else extra - (1 << category) + 1
            lo = (code << category | extra) << (16 - n - category)
            diff[lo : lo + (1 << (16 - n - category))] = d
            size[lo : lo + (1 << (16 - n - category))] = n + category
    return diff, size


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _frame_head(rows: int) -> bytes:
    counts, values = _table()
    return (
        b"\xff\xd8" + _segment(0xC4, b"\0" + counts + values) + _segment(0xC3, struct.pack(">BHHB3B", 8, rows, WIDTH, 1, 1, 0x11, 0))
        + _segment(0xDD, struct.pack(">H", RESTART * WIDTH)) + _segment(0xDA, bytes((1, 1, 0, 1, 0, 0)))
    )


def _coded_intervals(samples: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Entropy-coded bytes of each restart interval; first: the intervals' first samples."""
    x = samples.astype(np.int16)
    diff = np.empty_like(x)
    diff[1:] = x[1:] - x[:-1]
    rows = np.arange(0, len(x), WIDTH)
    diff[rows[1:]] = x[rows[1:]] - x[rows[:-1]]  # a row's first sample is told from the one above
    diff[first] = x[first] - 128
    bits, size = _codes()
    key = diff + 255
    val, n = bits[key], size[key]
    end = np.cumsum(n)
    begin = end - n
    lane_bits = np.diff(np.append(begin[first], end[-1]))
    lane_bytes = (lane_bits + 7) // 8
    at = np.concatenate([[0], np.cumsum(lane_bytes)])
    lane = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
    pos = begin + (at[:-1] * 8 - begin[first])[lane]
    word, byte = val << (24 - n - (pos & 7)), pos >> 3
    total = int(at[-1]) + 3
    out = sum(np.bincount(byte + k, weights=(word >> (16 - 8 * k)) & 255, minlength=total) for k in range(3))[: at[-1]].astype(np.uint8)
    out[at[1:] - 1] |= ((1 << (lane_bytes * 8 - lane_bits)) - 1).astype(np.uint8)
    full = np.nonzero(out == 255)[0]
    raw = np.insert(out, full + 1, 0).tobytes()
    at = (at + np.searchsorted(full, at)).tolist()
    return [raw[a:b] for a, b in zip(at[:-1], at[1:])]


def _avi(frames: list[bytes], rows: int) -> bytes:
    n, largest = len(frames), max(map(len, frames))
    chunk = lambda kind, body: kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    main = struct.pack("<14I", FRAME_MS * 1000, largest * 1000 // FRAME_MS, 0, 0x10, n, 0, 1, largest, WIDTH, rows, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, FRAME_MS, 1000, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, WIDTH, rows)
    form = struct.pack("<IiiHH4sIiiII", 40, WIDTH, rows, 1, 8, b"MJPG", WIDTH * rows, 0, 0, 0, 0)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", form)))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        movi.append(chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(movi[-1])
    body = b"AVI " + head + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def encode(payloads: list[bytes]) -> list[bytes]:
    """AVI files of payloads, whose lengths are positive multiples of WIDTH."""
    samples = np.frombuffer(b"".join(payloads), dtype=np.uint8)
    rows = [len(p) // WIDTH for p in payloads]
    first, heights, at = [], [], 0
    for r in rows:
        own = [min(HEIGHT, r - k) for k in range(0, r, HEIGHT)]
        heights.append(own)
        for h in own:
            first += [(at + k) * WIDTH for k in range(0, h, RESTART)]
            at += h
    coded, k, out = _coded_intervals(samples, np.array(first)), 0, []
    for own in heights:
        frames = []
        for h in own:
            n = -(-h // RESTART)
            parts = [_frame_head(h), coded[k]]
            for i in range(1, n):
                parts += [bytes((0xFF, 0xD0 + (i - 1) % 8)), coded[k + i]]
            frames.append(b"".join([*parts, b"\xff\xd9"]))
            k += n
        out.append(_avi(frames, own[0]))
    return out


def _chunks(raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        kind, n = struct.unpack_from("<4sI", raw, at)
        if at + 8 + n > end:
            raise CorruptMedia("a chunk beyond its parent")
        yield kind, at + 8, n
        at += 8 + n + (n & 1)


def frames_of(raw: bytes) -> list[tuple[int, int]]:
    """(offset, length) of the frames that the index of an AVI file lists."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"AVI " or struct.unpack_from("<I", raw, 4)[0] + 8 != len(raw):
        raise CorruptMedia("no whole RIFF AVI file")
    movi, index = None, None
    for kind, at, n in _chunks(raw, 12, len(raw)):
        if kind == b"LIST" and raw[at : at + 4] == b"movi":
            movi = at
        elif kind == b"idx1":
            index = [struct.unpack_from("<4sIII", raw, at + k) for k in range(0, n, 16)]
    if movi is None or index is None:
        raise CorruptMedia("no frames or no index")
    out = []
    for kind, _, offset, n in index:
        if struct.unpack_from("<4sI", raw, movi + offset) != (kind, n):
            raise CorruptMedia("the index and a chunk differ")
        if kind == b"00dc":
            out.append((movi + offset + 8, n))
    return out


@lru_cache(maxsize=512)
def _parsed(head: bytes) -> tuple[int, int, int, bytes, bytes]:
    """Rows, columns, rows in a restart interval and Huffman table of a frame's head."""
    rows = columns = interval = 0
    counts = values = b""
    at = 2
    while at < len(head):
        if head[at] != 0xFF:
            raise CorruptMedia("no marker where one is due")
        marker, n = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + n]
        if marker == 0xC3:
            depth, rows, columns, parts = struct.unpack_from(">BHHB", body)
            if depth != 8 or parts != 1:
                raise CorruptMedia("samples other than 8-bit grey")
        elif marker == 0xC4:
            counts, values = body[1:17], body[17:]
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA and body[3] != 1:
            raise CorruptMedia("a predictor other than the left neighbour")
        elif 0xC0 <= marker <= 0xCF and marker != 0xC4:
            raise CorruptMedia("a process other than the lossless one")
        at += 2 + n
    if not rows or not columns or not counts:
        raise CorruptMedia("a frame without size or table")
    return rows, columns, interval // columns or rows, counts, values


def decode(files: list[bytes]) -> list[list[np.ndarray]]:
    """The frames of AVI files as arrays of samples (rows x columns)."""
    data, shapes, owner, table = [], [], [], None
    for f, raw in enumerate(files):
        for at, n in frames_of(raw):
            scan = raw.find(b"\xff\xda", at, at + n)
            if scan < 0 or raw[at + n - 2 : at + n] != b"\xff\xd9":
                raise CorruptMedia("a frame without scan or end")
            body = scan + 2 + struct.unpack_from(">H", raw, scan + 2)[0]
            rows, columns, interval, counts, values = _parsed(raw[at:body])
            if table not in (None, (counts, values)):
                raise CorruptMedia("frames with different tables")
            table = (counts, values)
            data.append(raw[body : at + n - 2] + b"\xff\xd7")  # every interval ends with a restart marker
            shapes.append((rows, columns, interval))
            owner.append(f)
    out: list[list[np.ndarray]] = [[] for _ in files]
    if not shapes:
        return out
    b = np.frombuffer(b"".join(data), dtype=np.uint8)
    escape = np.nonzero(b[:-1] == 255)[0]
    after = b[escape + 1]
    marks = escape[(after & 0xF8) == 0xD0]
    gone = np.concatenate([escape[after == 0] + 1, marks, marks + 1])
    keep = np.ones(len(b), dtype=bool)
    keep[gone] = False
    kept = np.cumsum(keep)
    begin = np.concatenate([[0], kept[marks[:-1]]]) * 8
    bits = np.concatenate([b[keep], np.full(4, 255, np.uint8)]).astype(np.uint32)
    window = bits[:-2] << 16 | bits[1:-1] << 8 | bits[2:]
    sizes = np.array([min(i, r - k) * c for r, c, i in shapes for k in range(0, r, i)])
    if len(sizes) != len(marks):
        raise CorruptMedia("a wrong number of restart markers")
    diff_of, size_of = _lookup(*table)
    order = np.argsort(-sizes, kind="stable")
    pos, left = begin[order].astype(np.int64), sizes[order]
    active = np.searchsorted(-left, -np.arange(left[0]), side="left")  # intervals that have a sample at a step
    diffs = np.zeros((left[0], len(order)), dtype=np.int16)
    last = len(window) - 1
    for i in range(left[0]):
        p = pos[: active[i]]
        x = window[np.minimum(p >> 3, last)] >> (8 - (p & 7)).astype(np.uint32) & 0xFFFF
        n = size_of[x]
        if not n.all():
            raise CorruptMedia("bits that are no code")
        diffs[i, : active[i]] = diff_of[x]
        p += n
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    k = 0
    by_shape: dict[tuple[int, int], tuple[list, list]] = {}
    for f, (r, c, i) in enumerate(shapes):
        for row in range(0, r, i):
            lanes, where = by_shape.setdefault((min(i, r - row), c), ([], []))
            lanes.append(place[k])
            where.append((f, row))
            k += 1
    images = [np.empty((r, c), dtype=np.uint8) for r, c, _ in shapes]
    for (r, c), (lanes, where) in by_shape.items():
        d = diffs[: r * c, lanes].T.reshape(-1, r, c).astype(np.int32)
        d[:, 0, 0] += 128
        d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
        samples = np.cumsum(d, axis=2)
        if samples.min() < 0 or samples.max() > 255:
            raise CorruptMedia("a sample out of range")
        samples = samples.astype(np.uint8)
        for s, (f, row) in zip(samples, where):
            images[f][row : row + r] = s
    for f, image in zip(owner, images):
        out[f].append(image)
    return out


def shots(frames: list[np.ndarray]) -> list[tuple[int, int]]:
    """(first, last + 1) frame of each shot."""
    if not frames:
        return []
    hist = [np.bincount(f.reshape(-1) >> 4, minlength=16) / f.size for f in frames]
    cuts, recent = [0], []
    for i in range(1, len(hist)):
        d = float(np.abs(hist[i] - hist[i - 1]).sum()) / 2
        if len(recent) >= 2 and d > max(FLOOR, float(np.mean(recent) + SIGMAS * np.std(recent))):
            cuts.append(i)
            recent = []
        else:
            recent = [*recent[1 - WINDOW :], d]
    return list(zip(cuts, [*cuts[1:], len(frames)]))


def _groups(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose values hold about GROUP bytes."""
    sizes = [len(v.as_py() or b"") for v in batch.column(column)]
    at = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > GROUP:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield batch.slice(at)


def stored(df: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media binary): every whole text as an AVI file, padded with zero bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _groups(batch, 1):
                raw = [x.as_py().encode() for x in part.column(1)]
                media = encode([x + b"\0" * (-len(x) % WIDTH if x else WIDTH) for x in raw])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, raw)), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return doc_text(df).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def clips(media: DataFrame) -> DataFrame:
    """(doc_id, clip, start_ms, end_ms, n_frames): one row for each shot of every media value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _groups(batch, 1):
                docs = [(d, x) for d, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if x is not None]
                rows = [
                    (d, k, a * FRAME_MS, b * FRAME_MS, b - a)
                    for (d, _), frames in zip(docs, decode([x for _, x in docs])) for k, (a, b) in enumerate(shots(frames))
                ]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names=["doc_id", "clip", "start_ms", "end_ms", "n_frames"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, clip long, start_ms long, end_ms long, n_frames long")


def digests(media: DataFrame) -> DataFrame:
    """Payload and media digests and the shots of every media value, from the stored bytes."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _groups(batch, 2):
                files = part.column(2).to_pylist()
                out = [[] for _ in range(6)]
                for raw, frames in zip(files, decode(files)):
                    payload = b"".join(f.tobytes() for f in frames)
                    cut = ",".join(f"{a * FRAME_MS}-{b * FRAME_MS}" for a, b in shots(frames))
                    row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), f"frames={len(frames)};clips={cut}")
                    for column, value in zip(out, row):
                        column.append(value)
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(v, k) for v, k in zip(out, kinds))], names=names)

    return media.mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def op6_media(spark, sf_dir: str) -> DataFrame:
    return digests(stored(table(spark, sf_dir, "documents")))
