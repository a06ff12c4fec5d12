"""Quality classifier: attention-based multiple-instance learning over the passages of a text.

A text is a bag of passages of PASSAGE words. Each passage is encoded (its words and its three-byte
strings hashed into BUCKETS counts each, character kinds, word shape and repetition, then one tanh
layer); gated attention weighs the encoded passages; the weighted sum is scored. Only document labels
are needed. The model is fitted, in batches of BATCH texts, on at most SAMPLE labelled rows of each
class outside the held-out fold, chosen by the hash of their id, none longer than LONGEST characters
and together of no more than FITTED passages a class, so that fitting takes the same memory whatever
the table's size and its texts are like; every whole text is scored.

Defined cases: null text is empty; an empty text is one passage without words and is scored; rows
without a label, repeated labels (the lower counts) and labels of one class only (score: their
share) are allowed; a null doc_id counts as empty text in the fold's hash; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinemill.llm.common import doc_text, drop_caches, stage, table

PASSAGE, SAMPLE, LONGEST, FOLDS, THRESHOLD = 64, 2000, 50_000, 5, 0.3
BUCKETS, HASHED = 64, 0.3
HIDDEN, GATES, EPOCHS, BATCH, RATE, DECAY = 16, 8, 24, 128, 0.03, 1e-3
#: Passages of one class that the fit holds at most: 40,000 rows of 144 numbers of four bytes.
FITTED = 40_000
#: Kinds of byte: other, space, lower, upper, digit, stop, exclamation, symbol, bar, beyond ASCII.
_KIND = np.zeros(256, dtype=np.int64)
for _k, _chars in enumerate((b" \n\t\r", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"-()", b"!", b"#$%&*@^~=+<>{}[]\\/_`", b"|"), 1):
    _KIND[list(_chars)] = _k
_KIND[128:] = 9
KINDS = 10
SHAPE = KINDS + 6
WIDTH = SHAPE + 2 * BUCKETS


def passages(text: str) -> np.ndarray:
    """One row of features for each passage of a whole text; one row at least."""
    words = text.split()
    out = np.zeros((max(1, -(-len(words) // PASSAGE)), WIDTH), dtype=np.float32)
    for i in range(0, len(words), PASSAGE):
        w = words[i : i + PASSAGE]
        joined = " ".join(w).encode()
        raw = np.frombuffer(joined, dtype=np.uint8)
        row = out[i // PASSAGE]
        row[:KINDS] = np.bincount(_KIND[raw], minlength=KINDS) / len(raw)
        n = len(w)
        row[SHAPE : SHAPE + BUCKETS] = np.bincount([crc32(x) % BUCKETS for x in joined.lower().split()], minlength=BUCKETS) / n
        if len(raw) > 2:
            three = (raw[:-2].astype(np.uint32) * 40503 + raw[1:-1]) * 40503 + raw[2:]
            row[SHAPE + BUCKETS :] = np.bincount((three * np.uint32(0x9E3779B1)) >> np.uint32(26), minlength=BUCKETS) / len(three)
        row[KINDS:SHAPE] = (
            len(set(w)) / n,
            sum(map(str.__eq__, w[1:], w)) / n,
            min(len(raw) / n, 40) / 20,
            sum(map(str.isupper, w)) / n,
            n / PASSAGE,
            1,
        )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class AttentionBags:
    """Gated-attention multiple-instance model; bags are runs of rows of one feature matrix."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        shapes = {"E": (WIDTH, HIDDEN), "V": (HIDDEN, GATES), "U": (HIDDEN, GATES), "w": (GATES,), "c": (HIDDEN,)}
        self.p = {k: r.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shapes.items()} | {"b": np.zeros(1)}
        self.mean, self.scale, self.shift = np.zeros(WIDTH), np.ones(WIDTH), 0.0

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        """x: rows of features; first: each bag's first row, ascending."""
        p, bag = self.p, np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        h = np.tanh(x @ p["E"])
        tv, su = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        g = (tv * su) @ p["w"]
        e = np.exp(g - np.maximum.reduceat(g, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first)
        return {"h": h, "tv": tv, "su": su, "a": a, "z": z, "bag": bag, "y": _sigmoid(z @ p["c"] + p["b"])}

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict:
        p, f = self.p, self.forward(x, first)
        d = (f["y"] - y) / len(y)
        dz = np.outer(d, p["c"])
        of = dz[f["bag"]]
        dh = f["a"][:, None] * of
        da = (of * f["h"]).sum(1)
        dg = f["a"] * (da - np.add.reduceat(f["a"] * da, first)[f["bag"]])
        dt, ds = np.outer(dg, p["w"]) * f["su"] * (1 - f["tv"] ** 2), np.outer(dg, p["w"]) * f["tv"] * f["su"] * (1 - f["su"])
        dh += dt @ p["V"].T + ds @ p["U"].T
        return {
            "c": f["z"].T @ d, "b": np.array([d.sum()]), "w": (f["tv"] * f["su"]).T @ dg, "V": f["h"].T @ dt, "U": f["h"].T @ ds,
            "E": x.T @ (dh * (1 - f["h"] ** 2)),
        }

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, prior: float) -> "AttentionBags":
        """prior: the share of label 1 among all labelled rows, which the scores are set to."""
        if not len(labels) or labels.min() == labels.max():
            self.p["c"][:] = 0
            share = (prior * 98 + 1) / 100
            self.p["b"][:] = np.log(share / (1 - share))
            return self
        n = sum(map(len, bags))
        self.mean = sum(b.sum(0, dtype=np.float64) for b in bags) / n
        self.scale = np.sqrt(sum(((b - self.mean) ** 2).sum(0) for b in bags) / n) + 1e-3
        self.mean[SHAPE - 1], self.scale[SHAPE - 1] = 0, 1
        self.scale[SHAPE:] /= HASHED
        m, v = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}
        r, t, steps = np.random.default_rng(11), 0, EPOCHS * -(-len(bags) // BATCH)
        for _ in range(EPOCHS):
            order = r.permutation(len(bags))
            for at in range(0, len(bags), BATCH):
                some = order[at : at + BATCH]
                x, first = self._rows([bags[i] for i in some])
                t += 1
                rate = RATE * (1 - 0.9 * t / steps)
                for k, g in self.gradients(x, first, labels[some]).items():
                    g = g + DECAY * self.p[k] * (k != "b")
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        here = labels.mean()
        self.shift = float(np.log(prior / (1 - prior)) - np.log(here / (1 - here)))
        return self

    def _rows(self, bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """One matrix of the bags' scaled passages, and each bag's first row."""
        x = (np.concatenate(bags) - self.mean) / self.scale
        return x, np.cumsum([0, *(len(b) for b in bags[:-1])])

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        y = self.forward(*self._rows(bags))["y"]
        return _sigmoid(np.log(y / (1 - y)) + self.shift)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> AttentionBags:
    """Fit on a bounded sample of the rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.min("y").alias("y")).where(~held_out(F.col("doc_id")))
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        some = part if some is None else some.unionByName(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [passages(x.as_py()).tobytes() for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), batch.column(1), batch.column(2)], names=["bag", "y", "doc_id"])

    rows = doc_text(docs).join(F.broadcast(some), "doc_id").where(F.length("text") <= LONGEST).select("text", "y", "doc_id")
    bags = stage(rows.mapInArrow(run, "bag binary, y int, doc_id long"), "bags")
    order = ("h", "doc_id", "bag")  # an id may stand on any number of rows
    bags = bags.withColumn("h", F.xxhash64("doc_id")).withColumn("size", F.octet_length("bag") / (4 * WIDTH))
    found = []
    for y in (0, 1):
        some = bags.where(F.col("y") == y).orderBy(*order).limit(sample)
        taken = some.withColumn("upto", F.sum("size").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
        found += taken.where(F.col("upto") <= FITTED).select("bag", "y").collect()
    bags = [np.frombuffer(r["bag"], dtype=np.float32).reshape(-1, WIDTH) for r in found]
    prior = n.get(1, 0) / max(1, sum(n.values()))
    return AttentionBags().fit(bags, np.array([r["y"] for r in found], dtype=float), prior if n else 0.5)


def scored(docs: DataFrame, model: AttentionBags) -> DataFrame:
    """(doc_id, score) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                y = model.score([passages(x.as_py()) for x in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(y, pa.float64())], names=["doc_id", "score"])

    return doc_text(docs).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: AttentionBags, threshold: float = THRESHOLD) -> DataFrame:
    """The table's rows whose score reaches the threshold, all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                y = model.score([passages(x.as_py() or "") for x in part.column(part.schema.get_field_index("text"))])
                yield part.filter(pa.array(y >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
