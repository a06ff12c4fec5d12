"""Quality rules whose cutoffs carry a guarantee: no stratum loses more than RISK of its good texts.

Every text gets scores, higher for worse: shares, in thousandths, of symbols, repeated lines, repeated
eight-word windows, capitals, words seen before and exclamation marks. A stratum is a language and a
length class. Labelled rows are dealt into two folds by their id. On one, each rule of a stratum gets a proposed
cutoff: the lowest that all but SLACK of the good texts stay under and some bad text reaches. On the
other, the holdout, the proposals are tested: all cutoffs of the stratum times a factor, from the
most lenient factor down. A factor stands if the exact (Clopper-Pearson) upper bound of the share of
good texts rejected by any rule is at most RISK; the first that does not ends the sequence, which
needs no correction within it. The bounds' error, DELTA over all strata, is split evenly among them
(Bonferroni). So with probability 1 - DELTA every stratum at once keeps all but RISK of good texts
like the labelled ones that passed the fixed base rules. A stratum whose holdout is too small to show this
has no cutoffs, and all texts there that pass the base rules stay.

Nothing but counts is gathered: histograms of at most 1,001 scores a rule and stratum, and one row a
stratum.

Defined cases: null text has no words and fails the base rules; a null language is a stratum of its own; of
repeated labels the lower counts; labels other than 0 and 1 and ids without a label teach nothing;
repeated rows each give a row; without labels only the base rules act; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinemill.llm.common import stage, table

RISK, DELTA, SLACK = 0.02, 0.05, 0.002
#: Words from which a text is in the next length class.
CLASSES = (200,)
RULES = ("symbols", "repeated_lines", "repeated_windows", "capitals", "repeated_words", "exclamations")
#: Factors, in thousandths, by which proposed cutoffs are multiplied, from the most lenient down.
FACTORS = (8000, 4000, 3000, 2000, 1500, 1250, 1100, 1000)
#: The base rules: least words, and the most words in repeated windows in hundredths.
FEWEST, REPEATED = 20, 30
WINDOW = 8
_SYMBOLS = b"#*$%&|<>"


def repeated(codes: np.ndarray, width: int = WINDOW) -> int:
    """Words that lie in a window of so many words found twice or more; windows with equal hashes are compared word by word."""
    m = len(codes) - width + 1
    if m < 2:
        return 0
    h, base = np.zeros(m, dtype=np.uint64), np.uint64(0x9E3779B97F4A7C15)
    for k in range(width):
        h = h * base + codes[k : k + m]
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    a, b = order[:-1][same], order[1:][same]
    mark = np.zeros(m, dtype=bool)
    if all(np.array_equal(codes[a + k], codes[b + k]) for k in range(width)):
        mark[a] = mark[b] = True
    else:  # a collision: equal windows by their words
        seen: dict[bytes, int] = {}
        for i in range(m):
            first = seen.setdefault(codes[i : i + width].tobytes(), i)
            if first != i:
                mark[first] = mark[i] = True
    ends = np.concatenate([[0], np.cumsum(mark)])
    at = np.arange(len(codes))
    return int((ends[np.minimum(at + 1, m)] > ends[np.clip(at - width + 1, 0, m)]).sum())


def measures(text: str) -> tuple[list[int], list[int]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the scores of a whole text."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0, 0, sum(map(raw.count, map(bytes, zip(_SYMBOLS)))), 0, 0], [0] * len(RULES)
    code = {w: k for k, w in enumerate(dict.fromkeys(words))}
    codes = np.fromiter(map(code.__getitem__, words), dtype=np.uint64, count=n)
    chars = len(text) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    symbols = sum(map(raw.count, map(bytes, zip(_SYMBOLS))))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    doubled = len(lines) - len(set(lines))
    again = repeated(codes) if len(code) < n else 0
    capitals = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    scores = (symbols / chars, doubled / len(lines), again / n, capitals / chars, 1 - len(code) / n, raw.count(b"!") / n)
    return [n, chars, symbols, doubled, again], [min(1000, int(1000 * x)) for x in scores]


MEASURED = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, scores array<int>"


def measured(docs: DataFrame) -> DataFrame:
    """Counts and scores of every whole text, its stratum, and whether it fails the base rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [measures(t.as_py()) for t in part.column(2)]
                counts = zip(*(c for c, _ in found), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, pa.int64()) for c in counts), pa.array([s for _, s in found], pa.list_(pa.int32()))], names=[x.split()[0] for x in MEASURED.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = sum((F.when(F.col("n_words") >= n, 1).otherwise(0) for n in CLASSES), F.lit(0))
    failed = (F.col("n_words") < FEWEST) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    return rows.mapInArrow(run, MEASURED).select("*", F.concat("lang", F.lit(":"), size.cast("string")).alias("stratum"), failed.alias("base_failed"))


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of n draws at probability p, exactly."""
    if p <= 0 or k >= n:
        return 1.0
    if p >= 1:
        return 0.0
    i = np.arange(k, dtype=float)
    logs = n * np.log1p(-p) + np.concatenate([[0.0], np.cumsum(np.log((n - i) / (i + 1)) + np.log(p) - np.log1p(-p))])
    top = logs.max()
    return float(min(1.0, np.exp(top) * np.exp(logs - top).sum()))


def upper_bound(k: int, n: int, error: float) -> float:
    """Clopper-Pearson: the largest share at which k or fewer of n are seen with probability error."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(k, n, mid) > error else (low, mid)
    return high


def proposals(known: DataFrame, slack: float = SLACK) -> DataFrame:
    """(stratum, proposed map of rule number to cutoff) from labelled rows (stratum, y, scores)."""
    counts = known.select("stratum", "y", F.posexplode("scores").alias("rule", "score")).groupBy("stratum", "rule", "score").agg(F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad"))
    above = W.partitionBy("stratum", "rule").orderBy(F.desc("score"))
    tails = counts.select("stratum", "rule", "score", F.sum("good").over(above).alias("good"), F.sum("bad").over(above).alias("bad"), F.sum("good").over(W.partitionBy("stratum", "rule")).alias("all"))
    fit = tails.where((F.col("score") > 0) & (F.col("good") <= slack * F.col("all")) & (F.col("bad") > 0))
    return fit.groupBy("stratum", "rule").agg(F.min("score").alias("cutoff")).groupBy("stratum").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "cutoff")))).alias("proposed"))


#: By how much the worst score exceeds its proposed cutoff, in thousandths; only rules with a proposal count.
EXCESS = "array_max(transform(map_entries(proposed), e -> 1000L * scores[e.key] DIV e.value))"


def certified(holdout: DataFrame, proposed: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, n, rejected, bound, factor, cutoffs): strata whose cutoffs are shown to reject at most risk of good rows (stratum, scores)."""
    over = holdout.join(proposed, "stratum").withColumn("excess", F.expr(EXCESS))
    counts = over.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.count(F.when(F.col("excess") >= f, 1)) for f in FACTORS)).alias("hits"))
    counts = stage(counts, "hits")
    strata = max(1, counts.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                best = None
                for factor, k in zip(FACTORS, row["hits"], strict=True):
                    bound = upper_bound(k, row["n"], delta / strata)
                    if bound > risk:
                        break
                    best = {"stratum": row["stratum"], "n": row["n"], "rejected": k, "bound": bound, "factor": factor}
                out += [best] if best else []
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("stratum", pa.string()), ("n", pa.int64()), ("rejected", pa.int64()), ("bound", pa.float64()), ("factor", pa.int64())]))

    chosen = counts.mapInArrow(run, "stratum string, n long, rejected long, bound double, factor long")
    return chosen.join(proposed, "stratum").select("stratum", "n", "rejected", "bound", "factor", F.expr("transform_values(proposed, (r, c) -> (c * factor + 999) DIV 1000)").alias("cutoffs"))


def cutoffs(found: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Certified cutoffs by stratum, from measured() rows and labels (doc_id, quality)."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("y").alias("y"))
    known = found.where(~F.col("base_failed")).select("doc_id", "stratum", "scores").join(marks, "doc_id")
    known = stage(known.select("stratum", "y", "scores", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0).alias("held_out")), "known")
    proposed = stage(proposals(known.where("NOT held_out")), "proposed")
    return certified(known.where("held_out AND y = 1"), proposed, risk, delta)


def verdicts(found: DataFrame, chosen: DataFrame) -> DataFrame:
    """measured() rows with broken_rules, the names of the rules that reject a row, and kept."""
    names = F.array(*(F.lit(r) for r in RULES))
    df = found.join(chosen.select("stratum", "cutoffs"), "stratum", "left").withColumn("names", names)
    broken = F.expr("array_join(transform(filter(map_entries(cutoffs), e -> scores[e.key] >= e.value), e -> names[e.key]), ',')")
    df = df.withColumn("broken_rules", F.coalesce(broken, F.lit("")))
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("broken_rules") == ""))


def op12_rules(spark, sf_dir: str) -> DataFrame:
    found = stage(measured(table(spark, sf_dir, "documents")), "measured")
    out = verdicts(found, cutoffs(found, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum", "broken_rules")
