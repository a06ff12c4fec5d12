"""Periodic runs of words: maximal stretches that repeat with some period, found from Lyndon stacks.

A run of period q contains a Lyndon root of length q that is, under one of two opposite orders of
the words, the longest Lyndon word at its start. A stack scanned from the right end holds the starts
of the longest Lyndon words, so the distance from a position to what lies below it on the stack is a
period to look at. Suffixes are compared, and periods extended, by the longest common extension: a
few words directly, then binary search over rolling hashes, whose answer is verified word by word
(a collision falls back to a direct scan). What was verified for a period is kept, so that a long
run is not verified again from each of its roots. Python handles one text at a time, with memory in
proportion to it; Spark deals out the texts, and nothing is shuffled.

Defined cases: null text has no words and no runs; a null id has no rewriting in the query; repeated
rows each give a row; words are cut at ASCII white space only; an empty table gives an empty result.
Texts of one word over and over, or of no word twice, take time in proportion to n log n at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cinemill.llm.common import doc_text, table

#: A run has at least LEAST words and REPEATS periods.
LEAST, REPEATS = 6, 4
#: Words compared one by one before hashes are asked.
DIRECT = 6
_MASK, _BASE = (1 << 64) - 1, 0x9E3779B97F4A7C15


class Extensions:
    """Longest common extensions of one sequence of codes, to the right and to the left."""

    def __init__(self, codes: list[int]):
        self.codes, self.n = codes, len(codes)
        self.prefix: list[int] = []
        self.power: list[int] = []

    def _hashed(self) -> None:
        """Prefix hashes modulo 2^64, made when first asked for."""
        power = np.full(self.n + 1, _BASE, dtype=np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        terms = (np.asarray(self.codes, dtype=np.uint64) + np.uint64(0x632BE59BD9B4E019)) * power[:-1]
        self.prefix = [0, *np.add.accumulate(terms).tolist()]
        self.power = power.tolist()

    def _equal(self, i: int, j: int, length: int) -> bool:
        """Whether the hashes of two stretches agree; i < j."""
        h = self.prefix
        return ((h[i + length] - h[i]) * self.power[j - i] - h[j + length] + h[j]) & _MASK == 0

    def right(self, i: int, j: int, most: int | None = None) -> int:
        """Words that agree from i and from j on; i < j."""
        code, limit = self.codes, self.n - j if most is None else min(most, self.n - j)
        k = 0
        while k < limit and k < DIRECT:
            if code[i + k] != code[j + k]:
                return k
            k += 1
        if k == limit:
            return k
        if not self.prefix:
            self._hashed()
        low, high = k, limit  # low words agree
        while low < high:
            mid = (low + high + 1) // 2
            if self._equal(i, j, mid):
                low = mid
            else:
                high = mid - 1
        if code[i : i + low] != code[j : j + low]:  # a collision
            return next(x for x in range(low) if code[i + x] != code[j + x])
        return low

    def left(self, i: int, j: int) -> int:
        """Words that agree before i and before j; i < j."""
        code, k = self.codes, 0
        while k < i and k < DIRECT:
            if code[i - k - 1] != code[j - k - 1]:
                return k
            k += 1
        if k == i:
            return k
        if not self.prefix:
            self._hashed()
        low, high = k, i
        while low < high:
            mid = (low + high + 1) // 2
            if self._equal(i - mid, j - mid, mid):
                low = mid
            else:
                high = mid - 1
        if code[i - low : i] != code[j - low : j]:
            return next(x for x in range(low) if code[i - x - 1] != code[j - x - 1])
        return low


def _roots(order: list[int], extend: Extensions, found: dict[tuple[int, int], int]) -> None:
    """Scan one order from the right; put (end, period) -> leftmost root of every long stretch into found.

    order ends with a mark below all codes, as the end of the text is below all words.
    """
    n = len(order) - 1
    stack = [n]
    push, pop = stack.append, stack.pop
    verified: dict[int, tuple[int, int]] = {}  # period -> its last stretch [x, y) of positions that agree with those a period on

    def agree(i: int, p: int) -> int:
        """How far positions i and i + p agree; their first words do."""
        x, y = verified.get(p, (n, n))
        if x < y and i < y:
            if i < x:
                gap = extend.right(i, i + p, x - i)
                y = y if gap == x - i else i + gap
                verified[p] = (i, y)
            return y - i
        y = i + extend.right(i, i + p)
        verified[p] = (i, y)
        return y - i

    for i in range(n - 1, -1, -1):
        c = order[i]
        j = stack[-1]
        while True:
            d = order[j]
            if c < d:
                pop()
                j = stack[-1]
            elif c > d:
                break
            else:
                p = j - i
                common = agree(i, p)
                if order[i + common] < order[j + common]:
                    pop()
                    j = stack[-1]
                    continue
                # the leftmost root of a run leaves all but two of its periods to the right
                if common >= (REPEATS - 2) * p and common + 2 * p > LEAST:
                    found[j + common, p] = i
                break
        push(i)


def runs(codes: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of small integers, by start and period."""
    extend = Extensions(codes)
    found: dict[tuple[int, int], int] = {}
    top = max(codes, default=0)
    _roots([*codes, -1], extend, found)
    _roots([*(top - c for c in codes), -1], extend, found)
    out = []
    for (end, p), root in found.items():
        start = root - extend.left(root, root + p)
        if end - start >= max(LEAST, REPEATS * p):
            out.append((start, end - start, p))
    return sorted(set(out), key=lambda r: (r[0], r[2]))


def coded(words: list[bytes]) -> list[int]:
    """Words as integers, equal words alike."""
    code = {w: k for k, w in enumerate(dict.fromkeys(words))}
    return list(map(code.__getitem__, words))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by single spaces."""
    if not found:
        return b" ".join(words)
    kept, at = [], 0
    for a, b in sorted((s + p, s + n) for s, n, p in found):
        if b > at:
            kept += words[at : max(a, at)]
            at = b
    return b" ".join(kept + words[at:])


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The query's rewriting: the words of one document in ten or so repeat from some word on."""
    h, n = crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def found_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """Runs of a list of words; texts without a repeated word have none."""
    codes = coded(words)
    return runs(codes) if len(codes) >= LEAST and max(codes) + 1 < len(codes) else []


def periodic(docs: DataFrame, rewrite: Callable[[list[bytes], int | None], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): each text's runs, and its words without their repetitions as UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts, lists, texts = [], [], []
                for doc_id, text in zip(part.column(0), part.column(1), strict=True):
                    words = text.as_py().encode().split()
                    words = rewrite(words, doc_id.as_py()) if rewrite else words
                    found = found_runs(words)
                    counts.append(len(words))
                    lists.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                    texts.append(collapsed(words, found))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(lists, kind), pa.array(texts, pa.binary())], names=["doc_id", "n_words", "runs", "collapsed"])

    return doc_text(docs).mapInArrow(run, SCHEMA)


def digests(found: DataFrame) -> DataFrame:
    """Counts, the longest run and checksums of periodic()'s rows."""
    least = "array_min(transform(filter(runs, r -> r.length = longest), r -> struct(r.start, r.period)))"
    lines = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"
    df = found.selectExpr("*", "array_max(transform(runs, r -> r.length)) AS longest").selectExpr("*", f"{least} AS first")
    return df.selectExpr(
        "doc_id", "CAST(size(runs) AS long) AS n_runs", "first.start AS start", "longest AS length", "first.period AS period", "1000 * longest DIV first.period AS exponent_milli",
        f"sha2({lines}, 256) AS runs_sha256", "sha2(collapsed, 256) AS collapsed_sha256",
    )


def op13_periodic(spark, sf_dir: str) -> DataFrame:
    return digests(periodic(table(spark, sf_dir, "documents"), planted))
