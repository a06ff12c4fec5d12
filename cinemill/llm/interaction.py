"""Filter interaction audit: what every filter removes under every order of the filters.

Each text gets a mask of the filters that it fails. Rows are counted by part, mask and labels, and
those few cells give every count of every order. The orders are visited by adjacent transpositions:
one swap changes only the two steps that trade places, whose counts are taken from the cells again;
all other steps keep theirs, and each filter's removals are added up along the walk, which gives its
Shapley sum over all orders.

A text's copies are found by its SHA-256: rows are counted by id, digest and mask first, the smallest
id of each digest is found by a pre-aggregated minimum, and joined to the one row that has it, so no
text held by many rows meets in one task. Only counts of cells reach Python, at most 2^filters x 4 a
part, and parts stay spread over the tasks.

Defined cases: null text is empty; a null part is the empty string; a row without an id is no copy of
another and none of it, and has no labels; rows equal in id and text are no copies of each other, but
are counted each; of repeated labels the lower quality and the higher toxicity count, and null or
missing ones are 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinemill.llm.common import stage, table

#: Failure conditions of the audited filters as SQL over text, n_words and n_distinct; E, the copies, is added by masks().
FILTERS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_capitals > 3 * n_chars",
    "D": "text RLIKE '[#$%&*|]'",
}
COPY = "E"


def masks(docs: DataFrame, filters: dict[str, str] = FILTERS, part: str = "lang") -> DataFrame:
    """(doc_id, part, digest, mask, n): rows counted by id, whole text and the filters that it fails.

    Bit k of mask is the k-th filter's; the copies' bit is not set yet.
    """
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = F.array_remove(F.split("text", "[ \t-\r]+"), "")
    df = df.withColumn("words", words).select(
        "*", F.size("words").cast("long").alias("n_words"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("n_capitals"), F.length("text").cast("long").alias("n_chars"),
    )
    mask = sum((F.when(F.expr(c), 1 << k).otherwise(0) for k, c in enumerate(filters.values())), F.lit(0))
    df = df.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))
    return df.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))


def cells(docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS, part: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): documents by part, failed filters (the copies' bit is the highest) and labels."""
    found = stage(masks(docs, filters, part), "masks")
    known = found.where("doc_id IS NOT NULL")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.lit(True).alias("first"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    one = lambda c: F.when(F.col(c) == 1, 1).otherwise(0).alias(c)
    known = known.join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    known = known.select("part", (F.col("mask") + F.when(F.col("first"), 0).otherwise(1 << len(filters))).alias("mask"), one("quality"), one("toxic"), "n")
    nameless = found.where("doc_id IS NULL").select("part", "mask", F.lit(0).alias("quality"), F.lit(0).alias("toxic"), "n")
    return known.unionByName(nameless).groupBy("part", "mask", F.col("quality").alias("good"), "toxic").agg(F.sum("n").alias("n"))


def swaps(n: int) -> Iterator[int]:
    """Places k whose entries k and k + 1 are swapped, one after another, to visit all n! orders once."""
    if n < 2:
        return
    back = False
    inner = swaps(n - 1)
    while True:
        # the last entry travels through the others, which then make one step of their own walk
        yield from (range(n - 1) if back else range(n - 2, -1, -1))
        step = next(inner, None)
        if step is None:
            return
        back = not back
        yield step + 1 if back else step


class Walk:
    """Counts of one part under a running order, from its cells."""

    def __init__(self, n_filters: int, counts: np.ndarray):
        """counts: (mask, 3) documents, good ones and toxic ones."""
        self.n, self.counts = n_filters, counts
        self.bits = np.arange(len(counts))
        self.unique = [int(counts[1 << f, 0]) for f in range(n_filters)]
        self.steps: list[list[int]] = [[]] * n_filters
        self.shapley = [0] * n_filters

    def step(self, order: Sequence[int], k: int) -> None:
        """The counts of the filter in place k: kept, removed, redundant, good and toxic lost."""
        before = sum(1 << f for f in order[:k])
        fails, earlier = self.bits >> order[k] & 1 == 1, self.bits & before != 0
        removed = self.counts[fails & ~earlier].sum(axis=0)
        self.steps[k] = [int(self.counts[~fails & ~earlier, 0].sum()), int(removed[0]), int(self.counts[fails & earlier, 0].sum()), int(removed[1]), int(removed[2])]

    def rows(self) -> Iterator[tuple[list[int], list[list[int]]]]:
        """(order, counts by step) of every order; shapley is complete at the end."""
        order = list(range(self.n))
        for k in range(self.n):
            self.step(order, k)
        for swap in [None, *swaps(self.n)]:
            if swap is not None:
                order[swap], order[swap + 1] = order[swap + 1], order[swap]
                self.step(order, swap)
                self.step(order, swap + 1)
            for f, s in zip(order, self.steps, strict=True):
                self.shapley[f] += s[1]
            yield list(order), [list(s) for s in self.steps]


RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(found: DataFrame, names: Sequence[str]) -> DataFrame:
    """Every order's steps for every part of cells()'s rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.zeros((1 << len(names), 3), dtype=np.int64)
                for c in row["cells"]:
                    counts[c["mask"]] += np.array([1, c["good"], c["toxic"]]) * c["n"]
                walk = Walk(len(names), counts)
                out = [("".join(names[f] for f in order), k + 1, order[k], s) for order, steps in walk.rows() for k, s in enumerate(steps)]
                yield pa.RecordBatch.from_pylist(
                    [
                        {"part": row["part"], "filter_order": o, "step": k, "kept": s[0], "removed": s[1], "redundant": s[2], "unique_fails": walk.unique[f], "good_lost": s[3], "toxic_lost": s[4], "shapley": walk.shapley[f]}
                        for o, k, f, s in out
                    ],
                    schema=pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))]),
                )

    nested = found.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("cells"))
    return nested.mapInArrow(run, RESULT)


def op11_interaction(spark, sf_dir: str) -> DataFrame:
    found = cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit(found, [*FILTERS, COPY])


_WORDS = r"list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
#: The same rows from sums over masks for each order and step.
OP11_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
marked AS (
  SELECT part, doc_id, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask
  FROM (SELECT *, {_WORDS} AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM d)),
marks AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
  FROM marked LEFT JOIN marks USING (doc_id) GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(name, bit)),
orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
steps AS (
  SELECT filter_order, s AS step, bits[s] AS bit, coalesce(list_sum(bits[1:s - 1]), 0)::INTEGER AS earlier FROM orders, unnest([1, 2, 3, 4, 5]) AS u(s)),
counted AS (
  SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (earlier | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & earlier = 0), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (mask & bit > 0 AND mask & earlier > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (mask & bit > 0 AND mask & earlier = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & earlier = 0), 0)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM counted
"""
