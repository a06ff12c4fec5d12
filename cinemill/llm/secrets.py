"""Secret scans: fixed patterns plus a randomness test battery with false-discovery control.

Fixed kinds, leftmost and non-overlapping each: assign, access, hex. Beyond them every run of 16 or
more token characters is a candidate under the smallest encoding that its characters fit (hex, lower
or upper letters, those with digits, base32, base62, base64), and so is each such part of a run that
is glued together by the marks + / - _. The battery tests a candidate twice. As draws from the whole
alphabet: chi-squared uniformity, a runs test and lag-1 serial correlation; a candidate that any of
them rejects (Bonferroni, ALPHA) is not random. And as ordinary text, by what the corpus itself holds
(letters and letter pairs of all texts): are its letters, its pairs and its runs of common and rare
letters those of the corpus? The three p-values are combined (Cauchy). As they shrink with length,
Benjamini-Hochberg runs on the combined p-values per encoding and length class, over all candidates
of the corpus, and only those it rejects as ordinary text are reported.

Defined cases: null text is empty (no span, digest of the empty string); repeated rows are scanned
each; an empty table gives an empty result. A run of digits alone is no candidate, as from 16 on it
is a base span (hex). Work grows with the text's length however many matches it holds.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinemill.llm.common import doc_text, stage, table

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}")
PART = re.compile(r"[A-Za-z0-9]{16,}")
WORDS = ("passw", "secret", "token", "api")
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings with their alphabets in order of value, the smaller first.
ALPHABETS = {
    "hex": DIGITS + LOWER[:6],
    "HEX": DIGITS + UPPER[:6],
    "lower": LOWER,
    "upper": UPPER,
    "base32": UPPER + DIGITS[2:8],
    "lower36": LOWER + DIGITS,
    "upper36": UPPER + DIGITS,
    "base62": UPPER + LOWER + DIGITS,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
}
NAMES = tuple(ALPHABETS)
SETS = {name: frozenset(a) for name, a in ALPHABETS.items()}
VALUE = {name: {c: i for i, c in enumerate(a)} for name, a in ALPHABETS.items()}
LENGTHS = (16, 20, 24, 32, 48, 96)
ALPHA, FDR, BIN = 0.001, 0.01, 20


def base_spans(text: str, runs: list[tuple[int, str]]) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed kinds. runs: the candidates, which hold all long hex and access runs."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    for at, run in runs:
        if "AKIA" in run:
            out += [(at + m.start(), 1, at + m.end()) for m in ACCESS.finditer(run) if m.end() - m.start() >= 18]
        out += [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(run) if m.end() - m.start() >= 16]
    return sorted(out)


def encoding(run: str) -> str | None:
    """The smallest alphabet that a run's characters fit; None for numbers and runs that fit no alphabet."""
    chars = frozenset(run)
    return None if chars <= SETS["hex"] & SETS["HEX"] else next((n for n in NAMES if chars <= SETS[n]), None)


def candidates(start: int, run: str) -> list[tuple[int, str, str]]:
    """(start, word, encoding) of a run and of its parts between marks."""
    out = [(start, run)]
    if any(c in run for c in "+/-_"):
        out += [(start + m.start(), m[0]) for m in PART.finditer(run)]
    return [(at, w, e) for at, w in out if (e := encoding(w))]


def apart(found: list[tuple[int, str, str]], spans: list[tuple[int, int, int]]) -> list[tuple[int, str, str]]:
    """The candidates that overlap no base span. spans are in order of their starts; the furthest end so far tells of all before."""
    if not spans:
        return found
    starts, reach = [s for s, _, _ in spans], list(accumulate((e for _, _, e in spans), max))
    return [c for c in found if not (k := bisect_left(starts, c[0] + len(c[1]))) or reach[k - 1] <= c[0]]


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi2_tail(x: float, df: int) -> float:
    """Upper tail of chi-squared, by Wilson and Hilferty's cube root."""
    c = 2 / (9 * df)
    return _normal_tail(((x / df) ** (1 / 3) - (1 - c)) / math.sqrt(c))


def battery(v: np.ndarray, k: int, rank: np.ndarray) -> tuple[float, float, float]:
    """p-values of uniformity, runs and serial correlation of values below k under uniform draws.

    rank: the values' order by how common they are in text, by which uniformity groups them.
    """
    n = len(v)
    groups = min(k, max(2, n // 5))
    seen, share = np.bincount(rank[v] * groups // k, minlength=groups), np.bincount(np.arange(k) * groups // k) / k
    uniform = _chi2_tail(float(((seen - n * share) ** 2 / (n * share)).sum()), groups - 1)
    high = v >= k / 2
    n1 = int(high.sum())
    n2 = n - n1
    mean = 2 * n1 * n2 / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    runs = 2 * _normal_tail(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(var)) if var > 0 else 0.0
    d = v - v.mean()
    total = float((d * d).sum())
    serial = 2 * _normal_tail(abs(float((d[1:] * d[:-1]).sum()) / total + 1 / n) * math.sqrt(n)) if total else 0.0
    return uniform, runs, serial


class Ordinary:
    """What text of one encoding's letters looks like, by the corpus's counts of letters and of letter pairs."""

    def __init__(self, name: str, pairs: np.ndarray):
        """pairs: how often each of 128 characters is followed by each other."""
        letters = ALPHABETS[name]
        at = np.frombuffer(letters.encode(), dtype=np.uint8)
        self.k = k = len(at)
        if letters.upper() == letters or letters.lower() == letters:  # in one case, letters follow each other as in the other
            low = np.arange(128)
            low[65:91] += 32
            folded = np.zeros((128, 128))
            np.add.at(folded, (low[:, None], low[None, :]), pairs)
            pairs = folded[np.ix_(low, low)]
        joint = pairs[np.ix_(at, at)] + 1.0 / k
        self.share = joint.sum(1) / joint.sum()
        follow = joint / joint.sum(1, keepdims=True)
        self.rank = np.empty(k, dtype=np.int64)
        self.rank[np.argsort(-self.share, kind="stable")] = np.arange(k)
        rare = self.rank >= k / 2
        turn = rare[:, None] != rare[None, :]
        weight = self.share[:, None] * follow
        self.tables = [(-np.log(k * self.share), self.share), (-np.log(follow), weight), (np.where(turn, 1.0, 0.0), weight)]
        self.moments = []
        for score, w in self.tables:
            mean = float((w * score).sum())
            self.moments.append((mean, float((w * score * score).sum()) - mean * mean))
        self.more_turns = float((np.full((k, k), 1 / k / k) * turn).sum()) >= self.moments[2][0]

    def p_values(self, v: np.ndarray) -> tuple[float, float, float]:
        """p-values of a word's letters, pairs and runs of common and rare letters as ordinary text."""
        sums = (self.tables[0][0][v], self.tables[1][0][v[:-1], v[1:]], self.tables[2][0][v[:-1], v[1:]])
        out = []
        for x, (mean, var) in zip(sums, self.moments):
            out.append(_normal_tail((float(x.sum()) - len(x) * mean) / math.sqrt(len(x) * var)) if var > 1e-12 else 1.0)
        return out[0], out[1], out[2] if self.more_turns else 1 - out[2]


def combined(ps: tuple[float, ...]) -> float:
    """Cauchy combination, which holds for dependent tests too."""
    low = min(ps)
    if low < 1e-12:
        return min(1.0, low * len(ps))
    t = sum(math.tan((0.5 - min(p, 1 - 1e-9)) * math.pi) for p in ps) / len(ps)
    return max(0.5 - math.atan(t) / math.pi, 1e-16)


def ordinary_p(word: str, name: str, texts: dict[str, Ordinary]) -> float | None:
    """Combined p-value of a candidate as ordinary text; None where the battery says that it is not random."""
    known, of = texts[name], VALUE[name]
    v = np.array([of[c] for c in word])
    if 3 * min(battery(v, known.k, known.rank)) < ALPHA:
        return None
    return combined(known.p_values(v))


def _class(n: int) -> int:
    return sum(n >= x for x in LENGTHS)


def _bin(p: float) -> int:
    return min(2000, int(-math.log10(max(p, 1e-100)) * BIN))


def thresholds(rows) -> dict[tuple[int, int], int]:
    """Least bin of -log10 p that Benjamini-Hochberg rejects, per (encoding, length class)."""
    tests: dict[tuple[int, int], dict[int, int]] = {}
    for name, length, b, n in rows:
        tests.setdefault((name, length), {})[b] = n
    out = {}
    for key, bins in tests.items():
        m, above = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):
            above += bins[b]
            if 10 ** (-b / BIN) <= FDR * above / m:
                out[key] = b
    return out


def scan(df: DataFrame) -> DataFrame:
    """(doc_id, base spans, candidates: at, name, word) of every row, and a row of each task, marked by
    counts, with how often each ASCII character follows each other (in base)."""
    longs, strings = pa.list_(pa.int64()), pa.list_(pa.string())

    def rows(counts, doc, base, at, name, word):
        return pa.RecordBatch.from_arrays(
            [pa.array([counts] * len(base)), doc, pa.array(base, longs), pa.array(at, longs), pa.array(name, longs), pa.array(word, strings)],
            names=["counts", "doc_id", "base", "at", "name", "word"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(128 * 128, dtype=np.int64)
        for batch in batches:
            base, at, name, word = [], [], [], []
            for text in batch.column(1).to_pylist():
                raw = np.frombuffer(text.encode(), dtype=np.uint8)
                for lo in range(0, len(raw), 1 << 20):
                    a, b = raw[lo : lo + (1 << 20)], raw[lo + 1 : lo + 1 + (1 << 20)]
                    both = a[: len(b)].astype(np.int32) * 128 + b
                    pairs += np.bincount(both[(a[: len(b)] < 128) & (b < 128)], minlength=128 * 128)
                runs = [(m.start(), m[0]) for m in CANDIDATE.finditer(text)]
                spans = base_spans(text, runs)
                found = apart([c for r in runs for c in candidates(*r)], spans)
                base.append([x for s in spans for x in s])
                at.append([x for x, _, _ in found])
                name.append([NAMES.index(x) for _, _, x in found])
                word.append([x for _, x, _ in found])
            yield rows(False, batch.column(0), base, at, name, word)
        yield rows(True, pa.array([None], pa.int64()), [pairs.tolist()], [[]], [[]], [[]])

    return doc_text(df).mapInArrow(run, "counts boolean, doc_id long, base array<long>, at array<long>, name array<long>, word array<string>")


def find_secrets(df: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) of every row."""
    seen = stage(scan(df), "secrets")
    pairs = np.zeros(128 * 128)
    for row in seen.where("counts").select(F.posexplode("base")).groupBy("pos").agg(F.sum("col").alias("n")).where("n > 0").collect():  # 16,384 rows at most
        pairs[row["pos"]] = row["n"]
    texts = {name: Ordinary(name, pairs.reshape(128, 128)) for name in NAMES}

    def tested(names: list[int], words: list[str]) -> list[tuple[int, int, int] | None]:
        ps = [ordinary_p(w, NAMES[n], texts) for n, w in zip(names, words)]
        return [None if p is None else (n, _class(len(w)), _bin(p)) for n, w, p in zip(names, words, ps)]

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x or (n, _class(len(w)), 0) for ns, ws in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x, n, w in zip(tested(ns, ws), ns, ws)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int32()) for i in range(3)], names=["name", "length", "bin"])

    all_tests = seen.where("not counts and size(at) > 0").select("name", "word").mapInArrow(bins, "name int, length int, bin int")
    least = thresholds([tuple(r) for r in all_tests.groupBy("name", "length", "bin").count().collect()])  # 10 encodings x 7 lengths x 2001 bins at most

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(6)]
            for base, at, name, word in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                spans = list(zip(base[::3], base[1::3], base[2::3]))
                text = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
                more = []
                for s, w, x in zip(at, word, tested(name, word)):
                    if x and x[:2] in least and x[2] >= least[x[:2]] and not (more and s < more[-1][2]):  # a whole run stands before its parts
                        more.append((s, 3, s + len(w)))
                for i in range(3):
                    out[i].append(sum(k == i for _, k, _ in spans))
                out[3].append(len(more))
                out[4].append(hashlib.sha256(text.encode()).hexdigest())
                out[5].append(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans + more)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.string()), pa.array(out[5], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"],
            )

    return seen.where("not counts").select("doc_id", "base", "at", "name", "word").mapInArrow(
        final, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
    )


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
