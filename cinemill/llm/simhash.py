"""SimHash near-duplicates: BK-trees over shards of fingerprints, then connected components.

A fingerprint is cut into five blocks; two that differ in at most three bits agree in two whole
blocks, so the ten pairs of blocks give ten shard keys and every link lies within a shard. In each
shard a BK-tree keeps its children by their Hamming distance to the parent; a search follows the
edges whose distance is within the radius of the query's own. Trees are built where their shard is,
so none has to be sent to all executors. Equal fingerprints are merged first and shards of one
fingerprint dropped. A shard above HOT fingerprints is dealt out again by four blocks of its other
bits, of which a link must share one.

Defined cases: null or wordless text has fingerprint zero and links like any other; repeated rows
share a fingerprint; a null doc_id never names a component unless it has no other; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinemill.llm.common import arrow_rows, discard, doc_text, parts_for, release, stage, table
from cinemill.llm.graph import components

BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
HOT = 4096


def shingle_digests(text: str, words: int) -> bytes:
    """XXH64 of each shingle in turn, eight bytes each; a text of fewer words is one shingle, no words are none."""
    w = text.encode().lower().split()
    if not w:
        return b""
    shingles = [b" ".join(w)] if len(w) <= words else map(b" ".join, zip(*(w[i:] for i in range(words))))
    return b"".join([xxhash.xxh64_digest(x, 42) for x in shingles])


def fingerprint(text: str, words: int = 3) -> int:
    """The 64-bit fingerprint of one text, unsigned; zero without words."""
    return fingerprint_of(shingle_digests(text, words))


def fingerprint_of(hashes: bytes) -> int:
    votes, n = np.zeros(64, dtype=np.int64), len(hashes) // 8
    for at in range(0, len(hashes), 8 * 8192):
        votes += np.unpackbits(np.frombuffer(hashes[at : at + 8 * 8192], dtype=np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(df: DataFrame, words: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), words) for x in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return doc_text(df).mapInArrow(run, "doc_id long, fp long")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = np.bitwise_count(a ^ b)
    return (d.sum(1) if d.ndim == 2 else d).astype(np.int64)


class BKTree:
    """Fingerprints in a tree whose edges carry the Hamming distance of child and parent.

    fps: one number each, or one row of numbers each for longer fingerprints. With roots, the number
    of each fingerprint's root, it holds a tree for every root; all are built and searched together.
    """

    def __init__(self, fps: np.ndarray, roots: np.ndarray | None = None):
        self.fps, n = fps, len(fps)
        self.roots = np.zeros(n, dtype=np.int64) if roots is None else roots
        pending = np.nonzero(self.roots != np.arange(n))[0]
        parent = self.roots[pending]
        parents, kids, far = [], [], []
        while len(pending):
            d = _distance(fps[pending], fps[parent])
            edge, first, which = np.unique(parent * 4096 + d, return_index=True, return_inverse=True)
            parents.append(edge // 4096)
            kids.append(pending[first])
            far.append(edge % 4096)
            stay = np.ones(len(pending), dtype=bool)
            stay[first] = False
            pending, parent = pending[stay], pending[first][which][stay]
        parents, kids, far = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (parents, kids, far))
        order = np.argsort(parents, kind="stable")
        self.kids, self.far = kids[order], far[order]
        self.first = np.searchsorted(parents[order], np.arange(n + 1))

    def within(self, queries: np.ndarray, radius: int, roots: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query number, node) at distance radius or less, each query from its root."""
        q, node = np.arange(len(queries)), np.zeros(len(queries), dtype=np.int64) if roots is None else roots
        hits_q, hits_n = [], []
        while len(q):
            d = _distance(queries[q], self.fps[node])
            near = d <= radius
            hits_q.append(q[near])
            hits_n.append(node[near])
            n = self.first[node + 1] - self.first[node]
            q, d, begin = np.repeat(q, n), np.repeat(d, n), np.repeat(self.first[node] - (np.cumsum(n) - n), n)
            edge = begin + np.arange(len(q))
            follow = np.abs(self.far[edge] - d) <= radius
            q, node = q[follow], self.kids[edge[follow]]
        return np.concatenate(hits_q), np.concatenate(hits_n)


def local_roots(fps: np.ndarray, radius: int, roots: np.ndarray | None = None) -> np.ndarray:
    """For each of the distinct fingerprints, the number of the first it reaches within its tree."""
    label, tree = np.arange(len(fps)), BKTree(fps, roots)
    size = np.bincount(tree.roots, minlength=len(fps))[tree.roots]
    part = np.cumsum(size) // 1_000_000  # pairs in memory at once
    for at, to in zip((cuts := np.concatenate([[0], np.nonzero(np.diff(part))[0] + 1])), np.append(cuts[1:], len(fps))):
        q, node = tree.within(fps[at:to], radius, tree.roots[at:to])
        a, b = q + at, node
        while True:
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            label = label[label]
            if (label == before).all():
                break
    while (label[label] != label).any():
        label = label[label]
    return label


def _shard_keys(fp, radius: int):
    """Ten keys, each of two blocks of the fingerprint and the pair's number in the high bits."""
    if radius > 3:
        raise ValueError("two of five blocks are shared up to three differing bits only")
    part = [F.shiftrightunsigned(fp, at).bitwiseAND((1 << n) - 1) for at, n in BLOCKS]
    return F.array(*(F.shiftleft(part[i], 13).bitwiseOR(part[j]).bitwiseOR(F.lit(k << 32)) for k, (i, j) in enumerate(combinations(range(5), 2))))


def _within_shards(keyed: DataFrame, radius: int, rows: int) -> DataFrame:
    """Links (a, b) to the local roots, of all shards (key, fp)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "fp"])
        key, fp = pdf["key"].to_numpy(), pdf["fp"].to_numpy()
        cuts = np.nonzero(np.diff(key))[0] + 1
        a, b = [], []
        for part in np.split(fp, cuts):
            if len(part) == 2:
                roots = np.array([0, 0]) if (int(part[0]) ^ int(part[1])).bit_count() <= radius and (part[0] < 0) == (part[1] < 0) else None
                if roots is None:
                    roots = local_roots(part.view(np.uint64), radius)
            else:
                roots = local_roots(part.view(np.uint64), radius)
            moved = roots != np.arange(len(part))
            a.append(part[moved])
            b.append(part[roots[moved]])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    shards = parts_for(rows, 40_000, 8)
    return keyed.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInPandas(run, "a long, b long")


def link_roots(nodes: DataFrame, radius: int = 3, hot: int = HOT) -> DataFrame:
    """Links that join all fingerprints (fp) within the radius of each other into components."""
    keyed = nodes.select("fp", F.explode(_shard_keys(F.col("fp"), radius)).alias("key"))
    sizes = stage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shards")
    rows = sizes.agg(F.coalesce(F.sum(F.when(F.col("n") <= hot, F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("n") > hot, F.col("n"))), F.lit(0))).first()
    links = _within_shards(keyed.join(sizes.where(F.col("n") <= hot).select("key"), "key"), radius, rows[0])
    if rows[1]:
        many = keyed.join(sizes.where(F.col("n") > hot).select("key"), "key")
        shared = [c for c in combinations(range(5), 2)]
        rest = F.element_at(F.array(*(_rest(F.col("fp"), c) for c in shared)), (F.shiftright("key", 32) + 1).cast("int"))
        again = many.withColumn("rest", rest).select(
            "fp", F.explode(F.array(*(F.xxhash64("key", F.lit(k), F.shiftrightunsigned("rest", 10 * k).bitwiseAND(1023)) for k in range(4)))).alias("key")
        )
        links = links.unionByName(_within_shards(again, radius, 4 * rows[1]))
    return links


def _rest(fp, pair: tuple[int, int]):
    """The bits outside two blocks, moved together; 39 at most."""
    out, at = F.lit(0).cast("long"), 0
    for k, (low, n) in enumerate(BLOCKS):
        if k not in pair:
            out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, low).bitwiseAND((1 << n) - 1), at))
            at += n
    return out


def near_duplicates(df: DataFrame, words: int = 3, radius: int = 3, hot: int = HOT) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links."""
    docs = stage(fingerprints(df, words), "fingerprints")
    nodes = stage(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(link_roots(nodes, radius, hot)).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return docs.join(named, "fp").select("doc_id", "fp", "component_id")


#: For the pipeline: texts that share 4 of 5 shingles or more (exact Jaccard). SAMPLE texts tell
#: which shingles are common; they only set the order in which shingles become keys, never a result.
SHARE_NUM, SHARE_DEN = 4, 5
SAMPLE, COMMON = 8192, 100_000
#: Shingles that meet in one cell of a text's counts, on average, in the coarse and the fine counts.
COARSE, FINE = 4, 2
#: Texts whose results a Python worker hands over at once, and texts a file of the tables in between.
PART, PER_FILE = 256, 5_000


def shingle_hashes(text: str, words: int = 5) -> np.ndarray:
    """The distinct shingles' hashes, in order; zero alone stands for a text without words."""
    return _distinct(shingle_digests(text, words))


def _distinct(digests: bytes) -> np.ndarray:
    return np.unique(np.frombuffer(digests or bytes(8), dtype=np.int64))


def _node(grams: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(grams.tobytes(), 42) - (1 << 63)


def _cells(grams: np.ndarray, share: int) -> bytes:
    """Counts of shingles by cell: the sum of two texts' differences never exceeds the shingles they do not share.

    Cells grow with the text, in powers of two, so that unlike texts of any length differ in most of
    them. Counts of twice as many cells, their halves added, are counts too: texts of nearly the same
    length can be compared.
    """
    cells = 1 << min(12, max(5, (max(1, len(grams)) // share).bit_length()))
    return np.minimum(np.bincount(grams & (cells - 1), minlength=cells), 255).astype(np.uint8).tobytes()


def _folded(cells: np.ndarray, size: int) -> np.ndarray:
    """Rows of counts by as many cells, or by half as many as they have."""
    return cells if cells.shape[1] == size else cells.reshape(len(cells), -1, size).sum(1, dtype=np.int16)


def _unlike(one: bytes, two: bytes) -> int:
    """A bound from below on the shingles that two texts do not share."""
    size = min(len(one), len(two))
    a, b = (_folded(np.frombuffer(x, dtype=np.uint8).astype(np.int16)[None], size) for x in (one, two))
    return int(np.abs(a - b).sum(dtype=np.int64))


def _common(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes, in order, that several of a sample's texts hold, and in how many."""
    rows = texts.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(x.as_py(), words))], names=["gram"])

    sample = texts.select("text") if rows <= SAMPLE else texts.select("text").sample(SAMPLE / rows, 1)
    found = sample.mapInArrow(run, "gram long").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 3")
    found = found.orderBy(F.desc("n"), "gram").limit(COMMON).toPandas().sort_values("gram")
    return found["gram"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def _prints(texts: DataFrame, words: int) -> DataFrame:
    """(doc_id, th, fp, node, n, keys, cells, fine): fp is the SimHash, node names the set of shingles, n counts them,
    by few and by many cells.

    keys are the n - ceil(0.8 n) + 1 rarest shingles in one order for all texts: two sets whose Jaccard
    is 0.8 or more have one of those in common, whatever the order.
    """
    gram, often = _common(texts, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, PART) for whole in batches for at in range(0, whole.num_rows, PART)):
            fp, node, n, keys, cells, fine = [], [], [], [], [], []
            for x in batch.column(2):
                digests = shingle_digests(x.as_py(), words)
                g = _distinct(digests)
                fp.append(fingerprint_of(digests))
                node.append(_node(g))
                n.append(len(g))
                cells.append(_cells(g, COARSE))
                fine.append(_cells(g, FINE))
                rank = np.zeros(len(g), dtype=np.int64)
                if len(gram):
                    at = np.minimum(np.searchsorted(gram, g), len(gram) - 1)
                    rank = np.where(gram[at] == g, often[at], 0)
                first = np.lexsort((g, rank))[: len(g) - -(-SHARE_NUM * len(g) // SHARE_DEN) + 1]
                keys.append(g[first])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(np.array(fp, dtype=np.uint64).view(np.int64)), pa.array(node, pa.int64()), pa.array(n, pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())), pa.array(cells, pa.binary()), pa.array(fine, pa.binary()),
                ], names=["doc_id", "th", "fp", "node", "n", "keys", "cells", "fine"],
            )

    return texts.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, fp long, node long, n long, keys array<long>, cells binary, fine binary")


def _alike(texts: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, parts: int) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose shingles' Jaccard is 0.8 or more, by the shingles themselves."""
    ends = [nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("fine").alias(f"c{x}")) for x in "ab"]
    pairs = pairs.join(ends[0], "a").join(ends[1], "b").where(F.least("na", "nb") * SHARE_DEN >= F.greatest("na", "nb") * SHARE_NUM)

    def may_be(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unlike = np.array([_unlike(a, b) for a, b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())], dtype=np.int64)
            both = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            yield batch.filter(pa.array(unlike * (SHARE_NUM + SHARE_DEN) <= both * (SHARE_DEN - SHARE_NUM))).select(["a", "b", "na", "nb"])

    pairs = stage(pairs.select("a", "b", "na", "nb", "ca", "cb").mapInArrow(may_be, "a long, b long, na long, nb long"), "pairs", parts)
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = nodes.join(wanted, "node", "left_semi").select(F.col("least").alias("_d"), F.col("th").alias("_h"))
    held = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_h")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                grams = [shingle_hashes(x.as_py(), words) for x in batch.column(0).slice(lo, 128)]
                yield pa.RecordBatch.from_arrays([pa.array(map(_node, grams), pa.int64()), pa.array(grams, pa.list_(pa.int64()))], names=["node", "grams"])

    sets = stage(held.select("text").mapInArrow(run, "node long, grams array<long>"), "sets", parts).dropDuplicates(["node"])
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
    shared = F.size(F.array_intersect("ga", "gb"))
    return both.where(shared * SHARE_DEN >= (F.col("na") + F.col("nb") - shared) * SHARE_NUM).select("a", "b")


def _candidates(members: DataFrame, rows: int, best: bool = False) -> DataFrame:
    """Pairs (a, b) of each group (part) of members (node, root, n, cells) under different roots that may be alike.

    Where a group holds both sides 0 and 1, only pairs of one of each are compared. With best, only
    each node's pair that looks most alike.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "n", "node"])
        part, node, root, n, side = (pdf[c].to_numpy() for c in ("part", "node", "root", "n", "side"))
        cells = pdf["cells"].to_numpy()
        cuts = np.concatenate([[0], np.nonzero(np.diff(part))[0] + 1, [len(part)]])
        found, held = [np.zeros((0, 2), dtype=np.int64)], 0
        least, other = np.full(len(pdf), np.inf), np.zeros(len(pdf), dtype=np.int64)
        for begin, end in zip(cuts[:-1], cuts[1:]):
            whole = side[begin:end].min() == side[begin:end].max()
            last = begin + np.searchsorted(n[begin:end], n[begin:end] * SHARE_DEN // SHARE_NUM, "right")  # of more shingles none is alike
            sizes = np.fromiter(map(len, cells[begin:end]), dtype=np.int64, count=end - begin)
            turns = [begin, *(begin + 1 + np.nonzero(np.diff(sizes))[0]), end]  # rows of as many cells stand together
            tables = [np.frombuffer(b"".join(cells[lo:hi]), dtype=np.uint8).reshape(hi - lo, -1).astype(np.int16) for lo, hi in zip(turns[:-1], turns[1:])]
            for k, (lo, hi) in enumerate(zip(turns[:-1], turns[1:])):
                near = [(lo, tables[k])]
                if k + 1 < len(tables) and tables[k + 1].shape[1] == 2 * tables[k].shape[1]:
                    near.append((hi, _folded(tables[k + 1], tables[k].shape[1])))
                for i in range(lo, hi):
                    for first, table in near:
                        j = np.arange(max(i + 1, first), min(last[i - begin], first + len(table)))
                        j = j[(root[j] != root[i]) if whole else (root[j] != root[i]) & (side[j] != side[i])]
                        # at Jaccard 0.8 a ninth of both counts together is not shared
                        apart = np.abs(table[j - first] - tables[k][i - lo]).sum(1, dtype=np.int64)
                        near_enough = apart * (SHARE_NUM + SHARE_DEN) <= (n[j] + n[i]) * (SHARE_DEN - SHARE_NUM)
                        j, apart = j[near_enough], apart[near_enough]
                        if len(j) and best:  # of each row only the nearest is kept
                            far = apart / (n[j] + n[i])
                            at = far.argmin()
                            if far[at] < least[i]:
                                least[i], other[i] = far[at], node[j[at]]
                            nearer = far < least[j]
                            least[j[nearer]], other[j[nearer]] = far[nearer], node[i]
                        elif len(j):
                            found.append(np.stack([np.broadcast_to(node[i], len(j)), node[j]], axis=1))
                            held += len(j)
                        if held > 1_000_000:  # pairs repeat under the keys of a shard
                            found = [np.unique(np.sort(np.concatenate(found), axis=1), axis=0)]
                            held = 0
        if best:
            order = np.lexsort((other, least, node))
            order = order[np.isfinite(least[order])]
            order = order[np.unique(node[order], return_index=True)[1]]
            return pd.DataFrame({"a": node[order], "b": other[order], "far": least[order]})
        found = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1], "far": 0.0})

    # keys of one passage have the same head and nearly the same members: in one shard they give a pair once
    shards = parts_for(rows, 20_000, 64)
    block = (F.least("mine", "other"), F.greatest("mine", "other"))
    found = members.withColumn("shard", F.pmod(F.xxhash64("head", *block), F.lit(shards))).groupBy("shard").applyInPandas(run, "a long, b long, far double")
    if best:
        found = found.groupBy("a").agg(F.min(F.struct("far", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _blocks(members: DataFrame, hot: int) -> DataFrame:
    """The members (key, node, size and more) with part and side: a key of more than hot members is cut into
    blocks of about hot by the node's hash, and every pair of blocks is a part of its own, so no pair is lost."""
    blocks = F.ceil(F.col("size") / hot).cast("int")
    cut = members.withColumn("mine", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    part = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
    return cut.withColumn("part", part).withColumn("side", (F.col("mine") > F.col("other")).cast("int"))


def _by_fingerprint(nodes: DataFrame, radius: int, hot: int) -> DataFrame:
    """Pairs (a, b) of nodes that the BK-trees link: each node with the first of its fingerprint, and those
    firsts with each other."""
    first = stage(nodes.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    same = nodes.join(first, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    ends = [first.select(F.col("fp").alias(x), F.col("head").alias(f"h{x}")) for x in "ab"]
    linked = link_roots(first, radius, hot).distinct().join(ends[0], "a").join(ends[1], "b").select(F.col("ha").alias("a"), F.col("hb").alias("b"))
    return same.unionByName(linked)


def copy_groups(df: DataFrame, words: int = 5, hot: int = HOT, radius: int = 3) -> DataFrame:
    """_copy_groups() with few rows at once in Python, as texts and counts by cell are wide."""
    with arrow_rows(df.sparkSession, 1000):
        return _copy_groups(df, words, hot, radius)


def _copy_groups(df: DataFrame, words: int, hot: int, radius: int) -> DataFrame:
    """(doc_id, th, root) of every row: root is the same for texts linked by exact Jaccard of 0.8 or more.

    Candidates come from the BK-trees over the texts' SimHash fingerprints, and, as no radius of a
    SimHash holds all links of 0.8, from their rarest shingles. First every text is held against one
    text, the smallest head of its keys, which joins nearly all of a group; then, under keys that still
    hold several components, against the text of another that looks most alike by its counts, and last,
    where several are left, against each text of the others that its counts admit. All are decided by the shingles themselves.

    Null text is empty and wordless texts are one group; a null id names no group unless it has no other.
    """
    texts = doc_text(df).withColumn("th", F.xxhash64("text"))
    prints = stage(_prints(texts, words), "prints")
    parts = parts_for(prints.count(), PER_FILE)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("least")
    firsts = prints.groupBy("node").agg(least, *(F.first(c).alias(c) for c in ("fp", "n", "keys", "cells", "fine")))
    firsts = stage(firsts.select("node", F.col("least.doc_id").alias("least"), F.col("least.th").alias("th"), "fp", "n", "keys", "cells", "fine"), "firsts", parts)
    docs = stage(prints.select("doc_id", "th", "node"), "rows")
    discard(prints)
    release(df.sparkSession)
    keyed = firsts.select("node", F.explode("keys").alias("key"))
    heads = stage(keyed.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1"), "heads", parts)
    release(df.sparkSession)
    shared = stage(keyed.join(heads, "key"), "shared", parts)
    nodes = stage(firsts.drop("keys"), "nodes", parts)
    discard(firsts, heads)
    release(df.sparkSession)
    star = shared.where("node <> head").groupBy("node").agg(F.min("head").alias("head")).select(F.col("head").alias("a"), F.col("node").alias("b"))
    near = _by_fingerprint(nodes, radius, hot).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    tried = stage(star.unionByName(near).distinct(), "tried", parts)
    links = stage(_alike(texts, nodes, tried, words, parts), "alike", parts)
    for best in (True, False):  # what looks most alike first, as most groups are joined by it
        rooted = shared.join(components(links, parts=parts), "node", "left").select("key", "head", "node", "size", F.coalesce("root", "node").alias("root"))
        several = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        rest = stage(rooted.join(several, "key"), "rest", parts)
        members = _blocks(rest.join(nodes.select("node", "n", "cells"), "node"), hot)
        rows = rest.agg(F.coalesce(F.sum(F.ceil(F.col("size") / hot)), F.lit(0))).first()[0]
        more = stage(_candidates(members, rows, best).join(tried, ["a", "b"], "left_anti"), "more", parts)
        links = stage(links.unionByName(_alike(texts, nodes, more, words, parts)), "alike", parts)
        tried = tried.unionByName(more)
        discard(rest)
    roots = components(links, parts=parts)
    discard(shared)
    release(df.sparkSession)
    return docs.join(roots, "node", "left").select("doc_id", "th", F.coalesce("root", "node").alias("root"))


def near_copies(df: DataFrame, words: int = 5, hot: int = HOT) -> DataFrame:
    """(doc_id, component_id) by exact links of 0.8: component_id is the smallest doc_id of the group."""
    docs = stage(copy_groups(df, words, hot), "groups")
    return docs.join(docs.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
