"""The pipeline's stages against plain versions of their decisions, on the small table and awkward rows."""

import random

import corpus_pipeline
from cinemill.llm import decontaminate, simhash
from cinemill.llm.common import table
from tests.llm.helpers import awkward, empty


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages_on_the_small_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = step(spark, docs, sf_dir)
        rows = out.collect()
        if k < 4:
            assert out.columns == columns
            assert {r.doc_id for r in rows} <= set(before)
        if name == "near_dedup":
            left = {r.doc_id for r in rows}
            texts = {}
            for d in sorted(before):
                texts.setdefault(before[d], d)
            assert left <= set(texts.values())
            grams = {d: shingles(before[d]) for d in before}
            alike = lambda a, b: 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b])
            assert not [(a, b) for a in left for b in left if a < b and alike(a, b)]
            assert all(any(alike(d, e) for e in before if e != d) for d in set(before) - left)
            assert left == set(exact_groups(before).values())
        if name == "decontamination":
            items = [" ".join(decontaminate.words_of(r.text)) for r in table(spark, sf_dir, "benchmark").collect()]
            leaks = lambda t: any(i in " ".join(decontaminate.words_of(t)) for i in items)
            assert {r.doc_id for r in rows} == {d for d, t in before.items() if not leaks(t)}
        if name == "vector_packing":
            assert {r.doc_id for r in rows} == set(before)
        docs = spark.createDataFrame(rows, out.schema)


def test_stages_on_awkward_and_empty_rows(spark, sf_dir):
    for docs in (awkward(spark), empty(spark)):
        for k, (_, step) in enumerate(corpus_pipeline.STAGES):
            out = step(spark, docs, sf_dir)
            out.collect()
            assert k == 4 or out.columns == docs.columns


def exact_groups(texts):
    """Smallest id of each text's group, by all pairs."""
    grams = {d: shingles(t or "") for d, t in texts.items()}
    root = {d: d for d in texts}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: top(d) for d in texts}


def near_threshold_texts():
    """Texts of 300 words with 12 to 17 words apart changed, so that pairs lie close to 0.8 on both sides."""
    r = random.Random(8)
    rows = {}
    for k in range(60):
        w = ["w%d" % r.randrange(5000) for _ in range(300)]
        copy = list(w)
        for at in r.sample(range(3, 297, 12), 6 + k % 4):
            copy[at] = "x%d" % r.randrange(5000)
        rows[2 * k], rows[2 * k + 1] = " ".join(w), " ".join(copy)
    return rows


def test_near_copies_link_exactly_from_0_8_on(spark):
    texts = near_threshold_texts()
    wanted = exact_groups(texts)
    assert 20 < len(set(wanted.values())) - 60 < 50  # pairs on both sides
    found = simhash.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == wanted


def test_hot_keys_lose_no_link(spark):
    """A chain of near copies in which only neighbours are alike, all under the same keys, with tiny blocks."""
    r = random.Random(9)
    w = ["w%d" % r.randrange(5000) for _ in range(300)]
    texts = {}
    for k in range(24):
        for at in r.sample(range(3, 297, 12), 6):
            w[at] = "x%d" % r.randrange(10**6)
        texts[k] = " ".join(w)
    wanted = exact_groups(texts)
    assert len(set(wanted.values())) < 20
    found = simhash.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), hot=3).collect()
    assert {x.doc_id: x.component_id for x in found} == wanted


def test_near_dedup_keeps_texts_under_null_and_repeated_ids(spark, sf_dir):
    one, two, three, four, five = ("%s starts a text of quite other words than those beside it %s ends" % (c, c * 3) for c in "abcde")
    one, two, three, four, five = (" ".join(f"{c}{k}" for k in range(40)) + t for c, t in zip("abcde", (one, two, three, four, five)))
    rows = [(None, one), (None, two), (None, one), (7, three), (7, four), (3, four), (None, five), (9, five), (9, five), (None, None)]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [(None, one), (None, two), (7, three), (3, four), (9, five), (None, None)]))
