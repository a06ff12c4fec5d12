"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

Index terms are pairs of neighbouring words (single words for items of one word). An item's impacts
are its BM25 weights divided by their sum, so a passage that holds the whole item scores 1 and one
threshold serves all items. Passages are windows of twice the longest item, every longest item's
length, so each item lies whole in some passage. A passage whose terms' maxima cannot reach the
threshold is left at once; for the others block-max WAND walks the postings and returns every item
above the threshold. A hit counts when the item's question and answer are found in the passage:
shares of their word five-grams.

Document frequencies, the number of items, their mean length and the longest one are counted over all
items, so the rows do not depend on how the table is cut. The index travels to the executors with
the function. Its size is checked: the items are dealt into shards of about SHARD_WORDS words, the
documents are read once for each shard, and the driver holds one shard at a time.

Defined cases: null text or item is empty; an item without words is never found; repeated items are
reported each under its id; repeated documents are reported each; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinemill.llm.common import doc_text, parts_for, stage, table

WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
K1, B, BLOCK = 1.2, 0.75, 32
THRESHOLD, NGRAM, QUESTION, ANSWER = 0.5, 5, 0.8, 0.5
SHARD_WORDS = 250_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _grams(words: list[str]) -> set[tuple[str, ...]]:
    n = min(NGRAM, len(words))
    return set(zip(*(words[i:] for i in range(n)))) if n else set()


def _parts(text: str) -> tuple[list[str], list[str]]:
    """Words of question and answer: the last sentence answers, one sentence is both."""
    found = [w for s in SENTENCE.split(text) if (w := words_of(s))]
    if len(found) < 2:
        return (found[0], found[0]) if found else ([], [])
    return [w for s in found[:-1] for w in s], found[-1]


def index_terms(words: list[str]) -> set[str]:
    """The distinct index terms of an item's words: neighbours, joined by a space no word holds, or the only word."""
    return {f"{a} {b}" for a, b in zip(words, words[1:])} if len(words) > 1 else set(words)


class Counts(NamedTuple):
    """Of the whole item table: items with words, their words, and the longest one's."""

    items: int
    words: int
    longest: int


class Index:
    """Postings of (item number, impact) by term, in blocks with their largest impact."""

    def __init__(self, items: list[tuple[int, str]], counts: Counts | None = None, often: dict[str, int] | None = None):
        """counts and often (items by term, as index_terms() names it) are the whole table's; without them these items are the table."""
        self.items = [(i, t, w) for i, t in items if (w := words_of(t))]
        if counts is None:
            lengths = [len(w) for _, _, w in self.items]
            counts = Counts(len(lengths), sum(lengths), max(lengths, default=1))
            often = Counter(t for _, _, w in self.items for t in index_terms(w))
        self.word: dict[str, int] = {}
        bags = []
        for _, _, w in self.items:
            ids = [self.word.setdefault(x, len(self.word)) for x in w]
            bags.append(Counter(zip(ids, ids[1:])) if len(ids) > 1 else Counter({(ids[0], -1): 1}))
        n, mean = counts.items, counts.words / max(1, counts.items)
        names = list(self.word)
        df = {(a, b): often[names[a] if b < 0 else f"{names[a]} {names[b]}"] for bag in bags for a, b in bag}
        postings: dict[tuple[int, int], list[tuple[int, float]]] = {}
        for i, (bag, (_, _, w)) in enumerate(zip(bags, self.items)):
            norm = K1 * (1 - B + B * len(w) / mean)
            raw = {t: np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + norm) for t, f in bag.items()}
            total = sum(raw.values())
            for t, x in raw.items():
                postings.setdefault(t, []).append((i, float(x / total)))
        self.longest = counts.longest
        terms = sorted(postings)
        size = len(self.word) + 1
        self.size, self.codes = size, np.array([a * size + b + 1 for a, b in terms], dtype=np.int64)
        order = np.argsort(self.codes)
        self.codes = self.codes[order]
        lists = [postings[terms[k]] for k in order]
        self.item = [[i for i, _ in p] for p in lists]
        self.impact = [[x for _, x in p] for p in lists]
        self.block = [[max(x[k : k + BLOCK]) for k in range(0, len(x), BLOCK)] for x in self.impact]
        self.top = np.array([max(b) for b in self.block] or [0.0])
        self.parts = [tuple(map(_grams, _parts(t))) + (_grams(w),) for _, t, w in self.items]

    def terms(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Positions and term numbers of a text's index terms, in order of position."""
        ids = np.fromiter(map(self.word.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        if not len(self.codes) or not len(ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.nonzero((ids[:-1] >= 0) & (ids[1:] >= 0))[0]
        code, at = [ids[at] * self.size + ids[at + 1] + 1, ids[ids >= 0] * self.size], [at, np.nonzero(ids >= 0)[0]]
        code, at = np.concatenate(code), np.concatenate(at)
        k = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = self.codes[k] == code
        at, k = at[hit], k[hit]
        order = np.argsort(at, kind="stable")
        return at[order], k[order]

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Every (item number, score) at the threshold or above: block-max WAND over the terms' postings."""
        found, eps = [], 1e-9
        at = {t: 0 for t in terms}
        live = list(terms)
        while live:
            live.sort(key=lambda t: self.item[t][at[t]])
            bound, pivot = 0.0, -1
            for k, t in enumerate(live):
                bound += self.top[t]
                if bound + eps >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = self.item[live[pivot]][at[live[pivot]]]
            while pivot + 1 < len(live) and self.item[live[pivot + 1]][at[live[pivot + 1]]] == item:
                pivot += 1
            ahead = live[: pivot + 1]
            blocks, ends = 0.0, []
            for t in ahead:  # the block that holds the pivot's item, if the list has it
                i, p = self.item[t], at[t] // BLOCK * BLOCK
                while p + BLOCK < len(i) and i[p + BLOCK - 1] < item:
                    p += BLOCK
                blocks += self.block[t][p // BLOCK]
                ends.append(i[min(p + BLOCK, len(i)) - 1])
            if blocks + eps >= threshold:
                if self.item[live[0]][at[live[0]]] == item:
                    score = sum(self.impact[t][at[t]] for t in ahead)
                    if score + eps >= threshold:
                        found.append((item, score))
                    to = item + 1
                else:
                    to = item
            else:  # nothing up to the nearest block end can reach it, nor before the next list's item
                to = max(item + 1, min(ends) + 1)
                if pivot + 1 < len(live):
                    to = max(item + 1, min(to, self.item[live[pivot + 1]][at[live[pivot + 1]]]))
            for t in ahead:
                i, p = self.item[t], at[t]
                while p < len(i) and i[p] < to:
                    p += 1
                at[t] = p
            live = [t for t in live if at[t] < len(self.item[t])]
        return found

    def leaks(self, text: str, threshold: float = THRESHOLD) -> list[tuple[int, float, float, float]]:
        """(item_id, score, question share, answer share) of the items that a whole text holds."""
        words = words_of(text)
        at, term = self.terms(words)
        weight = np.concatenate([[0.0], np.cumsum(self.top[term])])
        if weight[-1] + 1e-9 < threshold:
            return []
        step = self.longest
        starts = np.arange(0, max(1, len(words) - step + 1 if len(words) > 2 * step else 1), step)
        lo, hi = np.searchsorted(at, starts), np.searchsorted(at, starts + 2 * step)
        best: dict[int, tuple[float, float, float]] = {}
        for k in np.nonzero(weight[hi] - weight[lo] + 1e-9 >= threshold)[0]:
            found = self.search(np.unique(term[lo[k] : hi[k]]).tolist(), threshold)
            if not found:
                continue
            held = {n: set(zip(*(words[starts[k] : starts[k] + 2 * step][i:] for i in range(n)))) for n in range(1, NGRAM + 1)}
            for i, score in found:
                q, a, whole = (sum(g in held[len(g)] for g in part) / len(part) for part in self.parts[i])
                if (q >= QUESTION and a >= ANSWER or whole >= QUESTION) and (i not in best or best[i] < (score, q, a)):
                    best[i] = (score, q, a)
        return [(self.items[i][0], *best[i]) for i in sorted(best)]


def indexes(items: DataFrame, id_col: str = "item_id", text_col: str = "text", shard_words: int = SHARD_WORDS) -> Iterator[tuple[Index, bool]]:
    """Indexes of the item table, one for each shard, and whether it is the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t.as_py()) for t in batch.column(1)]
            terms = pa.array([list(index_terms(w)) for w in words], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, words), pa.int64()), terms], names=["i", "t", "words", "terms"])

    rows = items.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    held = stage(rows.mapInArrow(run, "i long, t string, words long, terms array<string>").where("words > 0"), "items")
    counts = Counts(*held.agg(F.count(F.lit(1)), F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.max("words"), F.lit(1))).first())
    often = stage(held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")), "often")
    shards = parts_for(counts.words, shard_words) if counts.items else 0
    dealt = held.withColumn("shard", F.pmod(F.xxhash64("i", "t"), F.lit(max(1, shards))))
    for k in range(shards):
        mine = dealt.where(F.col("shard") == k)
        terms = mine.select(F.explode("terms").alias("term")).distinct()
        known = {r["term"]: r["n"] for r in often.join(terms, "term", "left_semi").toLocalIterator()}
        yield Index([(r["i"], r["t"]) for r in mine.select("i", "t").orderBy("i", "t").toLocalIterator()], counts, known), k == shards - 1


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): one row per document row and item it holds."""
    text, out = doc_text(docs), None
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"

    def finder(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1)) for hit in index.leaks(t.as_py(), threshold)]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        return run

    for index, last in indexes(items, shard_words=shard_words):
        part = text.mapInArrow(finder(index), schema)
        part = part if last else stage(part, "found")  # so that no later plan holds this index
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The table's rows that hold no test item, all columns as they are."""

    def keeper(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                text = batch.column(batch.schema.get_field_index("text"))
                yield batch.filter(pa.array([not index.leaks(t.as_py() or "", threshold) for t in text], pa.bool_()))

        return run

    for index, last in indexes(items, shard_words=shard_words):
        docs = docs.mapInArrow(keeper(index), docs.schema)
        docs = docs if last else stage(docs, "clean")
    return docs


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
