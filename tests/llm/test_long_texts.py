"""Long texts of nothing but matches: work must grow with the text, not with the square of its matches."""

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from cinemill.llm import pii, secrets


def test_secrets_of_a_long_text(spark):
    text = " ".join(f"{i:020d}" for i in range(60_000)) + " " + " ".join(f"Zq{i:014d}x" for i in range(40_000))
    began = time.time()
    row = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert row.n_hex == 60_000 and time.time() - began < 60
    wanted = ",".join(f"hex:{m.start()}:{m.end()}" for m in re.finditer("[0-9a-f]{16,}", text))
    assert row.base_sha256 == hashlib.sha256(wanted.encode()).hexdigest()


def test_candidates_apart_equal_all_pairs():
    r = random.Random(8)
    for _ in range(300):
        spans = sorted((a, 0, a + r.randint(1, 30)) for a in (r.randint(0, 200) for _ in range(r.randint(0, 12))))
        found = [(a, "x" * r.randint(1, 25), "hex") for a in sorted(r.randint(0, 200) for _ in range(12))]
        assert secrets.apart(found, spans) == [c for c in found if not any(s < c[0] + len(c[1]) and c[0] < e for s, _, e in spans)]


def test_personal_data_of_a_long_text(spark):
    text = " ".join(f"pérson{i}.name@mail{i % 97}.example.org tel" for i in range(50_000))
    docs = spark.createDataFrame([(1, text), (2, "see a.b@c.de and more")], "doc_id long, text string")
    began = time.time()
    rows = {r.doc_id: r for r in pii.find_personal(docs).select("doc_id", "base").collect()}
    assert time.time() - began < 60
    assert [(s.start, s.end) for s in rows[1].base] == [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert clean[1] == " ".join("pé[EMAIL] tel" for _ in range(50_000)) and clean[2] == "see [EMAIL] and more"


def test_running_sums_and_places(spark):
    r = random.Random(9)
    lists = [[r.randint(0, 5) for _ in range(n)] for n in (0, 1, 2, 127, 128, 129, 256, 1000)]
    df = pii._with_running(spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<int>"), "x", "sums")
    got = {row.i: row.sums for row in df.collect()}
    assert all((got[i] or []) == [sum(x[:k]) for k in range(len(x))] for i, x in enumerate(lists))


def test_covered_stretches_and_parts(spark):
    r = random.Random(10)
    rows = []
    for i in range(120):
        n = r.choice([0, 5, 255, 256, 257, 900])
        text = "".join(r.choice("ab é\U0001f600\n") for _ in range(n))
        spans = sorted((a, r.randint(0, 3), min(n, a + r.randint(1, 300))) for a in (r.randint(0, max(0, n - 1)) for _ in range(r.randint(0, 5) * (n > 0))))
        rows.append((i, text, spans))
    df = spark.createDataFrame(rows, "i int, text string, spans array<struct<start:int,kind:int,end:int>>")
    df = pii._with_covered(df, "text", "spans", pii._blank, "free")
    df = pii._with_covered(df, "text", "spans", lambda s, n: F.lit("") if s is None else F.concat(F.lit("<"), s["kind"].cast("string"), F.lit(">")), "marked")
    for row in df.collect():
        text, spans = rows[row.i][1:]
        hidden = {k for a, _, b in spans for k in range(a, b)}
        assert row.free == "".join(" " if k in hidden else c for k, c in enumerate(text))
        out, at = "", 0
        for a, kind, b in sorted(spans, key=lambda s: (s[0], s[1], s[2])):
            if a >= at:
                out += text[at:a] + f"<{kind}>"
            at = max(at, b)
        assert row.marked == out + text[at:]
    parts = spark.createDataFrame([(i, t, a, b) for i, t, _ in rows for a, b in [(0, len(t)), (len(t) // 3, len(t) // 2), (5, 5), (0, min(256, len(t))), (min(len(t), 100), len(t))]], "i int, text string, a int, b int")
    for row in pii._with_chunks(parts, "text", "chunks").withColumn("part", pii._between("chunks", F.col("a"), F.col("b"))).collect():
        assert row.part == row.text[row.a : row.b]


def test_fit_holds_a_bounded_number_of_passages(spark, monkeypatch):
    from cinemill.llm import quality

    seen = []
    real = quality.AttentionBags.fit

    def fit(self, bags, labels, prior):
        seen.append((sum(len(b) for b, y in zip(bags, labels) if y == 0), sum(len(b) for b, y in zip(bags, labels) if y == 1)))
        return real(self, bags, labels, prior)

    monkeypatch.setattr(quality.AttentionBags, "fit", fit)
    monkeypatch.setattr(quality, "FITTED", 100)
    rows = [(i, ("a " if i % 2 else "| ") * (64 * 30), "x") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    assert seen == [(90, 90)]  # three texts of thirty passages a class
    assert [r.doc_id % 2 for r in quality.scored(docs, model).where("score >= 0.5").collect()] == [1] * 20
