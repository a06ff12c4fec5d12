"""Filter interaction audit, risk-controlled rules and periodic runs against plain versions of their contracts."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from cinemill.llm import interaction, periodic, riskrules
from cinemill.llm.common import table
from tests.llm.helpers import awkward, awkward_rows, empty


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


# periodic runs


def brute_runs(c):
    n, out = len(c), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if c[i] != c[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and c[i] == c[i + q]:
                i += 1
            length = i + q - s
            w = c[s : s + length]
            if length >= max(6, 4 * q) and all(any(w[k] != w[k + p] for k in range(length - p)) for p in range(1, q)):
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences(r, times):
    for _ in range(times):
        k = r.choice([1, 2, 2, 3, 5])
        c = [r.randrange(k) for _ in range(r.randint(0, 40))]
        if r.random() < 0.5:
            block = [r.randrange(k) for _ in range(r.randint(1, 6))]
            c = c[:10] + block * r.randint(2, 9) + c[10:20] + block * r.randint(1, 5)
        yield periodic.coded(c)


def test_runs_equal_all_periods():
    for c in sequences(random.Random(1), 3000):
        assert periodic.runs(c) == brute_runs(c), c


@pytest.mark.parametrize("base", [0, 1, 2])
def test_runs_stand_hash_collisions(monkeypatch, base):
    monkeypatch.setattr(periodic, "_BASE", base)
    for c in sequences(random.Random(2), 600):
        assert periodic.runs(c) == brute_runs(c), c


def test_runs_of_very_long_texts():
    n = 400_000
    r = random.Random(3)
    block = [r.randrange(n) for _ in range(1000)]
    assert periodic.runs([0] * n) == [(0, n, 1)]
    assert periodic.runs([0, 1] * (n // 2)) == [(0, n, 2)]
    assert periodic.runs(periodic.coded([-1, *block * (n // 1000), -2])) == [(1, n, 1000)]
    a, b = [0], [0, 1]  # Fibonacci words hold no fourth power
    while len(b) < n:
        a, b = b, b + a
    assert periodic.runs(b) == []


def plain_periodic(doc_id, text, rewrite):
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text or "").split(" ") if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if rewrite and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    longest = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    best = (None,) * 4 if longest is None else (*longest, 1000 * longest[1] // longest[2])
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (doc_id, len(found), *best, sha(lines.encode()), sha(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()))


def test_periodic_query_equals_plain_version(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect() if len(r.text or "") < 6000]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = periodic.digests(periodic.periodic(docs, periodic.planted))
    assert Counter(map(tuple, found.collect())) == Counter(plain_periodic(d, t, True) for d, t in rows)
    assert found.where("n_runs > 0").count() > 5


def test_periodic_on_awkward_rows(spark):
    rows = [(d, t) for d, t, *_ in awkward_rows() if len(t or "") < 6000]
    extra = [(90, "a " * 50), (91, "x y " * 9 + "z " * 9 + "x y " * 9), (92, "p q r p q r p q r p q"), (93, "p\x1cq p\x1cq  p\x1cq " * 6), (94, "a a a a a"), (95, "a a a a a a")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string")
    found = periodic.digests(periodic.periodic(docs)).collect()
    assert Counter(map(tuple, found)) == Counter(plain_periodic(d, t, False) for d, t in rows + extra)
    assert periodic.periodic(awkward(spark)).count() == len(awkward_rows())
    assert periodic.digests(periodic.periodic(empty(spark))).collect() == []


# filter interaction audit


def test_swaps_visit_every_order_once():
    for n in range(1, 7):
        order = list(range(n))
        seen = [tuple(order)]
        for k in interaction.swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.append(tuple(order))
        assert sorted(seen) == list(itertools.permutations(range(n)))


def plain_audit(docs, labels):
    """docs: (doc_id, text, lang); every filter is applied to every row in every order."""
    rows = []
    for i, t, part in docs:
        t = t or ""
        words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in t).split(" ") if w]
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
        }
        rows.append((part or "", fails, *labels.get(i, (0, 0))))
    out, shapley = [], Counter()
    for part in {r[0] for r in rows}:
        for order in itertools.permutations("ABCDE"):
            left, gone = [r for r in rows if r[0] == part], []
            for k, f in enumerate(order):
                lost = [r for r in left if r[1][f]]
                redundant = sum(r[1][f] for r in gone)
                left, gone = [r for r in left if not r[1][f]], gone + lost
                unique = sum(r[0] == part and r[1][f] and sum(r[1].values()) == 1 for r in rows)
                out.append((part, "".join(order), k + 1, len(left), len(lost), redundant, unique, sum(r[2] == 1 for r in lost), sum(r[3] == 1 for r in lost)))
                shapley[part, f] += len(lost)
    return Counter((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_equals_plain_version_on_awkward_rows(spark):
    rows = awkward_rows() + [(r[0], r[1], "fr", *r[3:]) for r in awkward_rows()[3:9]]
    marks = [(6, 1, 1), (7, 1, 0), (3, 0, 1), (3, 1, 0), (12, None, None), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame(rows, awkward(spark).schema)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    found = interaction.audit(interaction.cells(docs, labels), "ABCDE").collect()
    wanted = plain_audit([r[:3] for r in rows], {6: (1, 1), 7: (1, 0), 3: (0, 1), 999: (1, 1)})
    assert Counter(tuple(r[c] for c in COLUMNS) for r in found) == wanted
    assert interaction.audit(interaction.cells(empty(spark), labels), "ABCDE").collect() == []


def test_audit_equals_sql(spark, sf_dir):
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = interaction.op11_interaction(spark, sf_dir).select(*COLUMNS).collect()
    assert Counter(map(tuple, found)) == Counter(db.sql(f"select {', '.join(COLUMNS)} from ({interaction.OP11_SQL})").fetchall())


def test_audit_takes_other_filters(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "a", "x"), (3, "a b c", "x")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = interaction.audit(interaction.cells(docs, labels, {"S": "n_words < 2"}), ["S", "E"]).collect()
    assert {(r.filter_order, r.step): (r.kept, r.removed) for r in found} == {("SE", 1): (2, 1), ("SE", 2): (1, 1), ("ES", 1): (2, 1), ("ES", 2): (1, 1)}


# risk-controlled rules


def plain_rules(text):
    white = "\t\n\v\f\r "
    split = lambda t: [w for w in "".join(" " if c in white else c for c in t).split(" ") if w]
    text = text or ""
    w, lines, dup, seen = split(text), text.split("\n"), 0, set()
    for x in lines:
        dup += bool(split(x)) and x in seen
        seen.add(x)
    count = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {j for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(again)


def test_rules_base_equals_plain_version(spark, sf_dir):
    rows = [(d, t) for d, t, *_ in awkward_rows()] + [(80, "a b c d e f g h " * 3), (81, "x\n\nx\n \n \nx\n"), (82, "#|\x1c<é>  é"), (83, " ".join("abcdefgh") + " z " + " ".join("abcdefgh"))]
    docs = spark.createDataFrame([(d, t, "en") for d, t in rows], "doc_id long, text string, lang string").unionByName(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    given = [(r.doc_id, r.text) for r in docs.collect()]
    found = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in riskrules.measured(docs).collect()]
    wanted = []
    for d, t in given:
        c = plain_rules(t)
        wanted.append((d, *c, c[0] < 20 or 100 * c[4] > 30 * c[0]))
    assert Counter(found) == Counter(wanted)
    assert riskrules.measured(awkward(spark)).count() == len(awkward_rows())


def test_repeated_windows_stand_hash_collisions(monkeypatch):
    r = random.Random(4)
    for _ in range(300):
        c = [r.randrange(3) for _ in range(r.randint(0, 60))]
        wanted = plain_rules(" ".join("abc"[x] for x in c))[4]
        assert riskrules.repeated(np.array(c, dtype=np.uint64)) == wanted
    monkeypatch.setattr(riskrules.np, "argsort", lambda h, kind: np.arange(len(h)))  # equal hashes for all
    same = np.array([0] * 9, dtype=np.uint64)
    assert riskrules.repeated(same) == 9


def test_exact_bounds():
    for n, p in ((10, 0.3), (50, 0.02), (200, 0.5)):
        pmf = [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
        for k in (0, 1, n // 2, n - 1):
            assert riskrules.tail(k, n, p) == pytest.approx(sum(pmf[: k + 1]))
    assert riskrules.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100))
    assert riskrules.tail(riskrules.RULES and 7, 300, riskrules.upper_bound(7, 300, 0.01)) == pytest.approx(0.01)
    assert riskrules.upper_bound(5, 5, 0.05) == 1.0 and 0 < riskrules.upper_bound(20_000, 2_000_000, 0.01) - 0.01 < 0.001


def scored_rows(r, n, stratum, bad_share=0.3, overlap=0.0):
    """(doc_id, stratum, y, scores): bad rows are high on the first score, good ones too at the given rate."""
    out = []
    for i in range(n):
        y = int(r.random() >= bad_share)
        high = y == 0 or r.random() < overlap
        out.append((i, stratum, y, [r.randint(300, 900) if high else r.randint(0, 60), *[0] * (len(riskrules.RULES) - 1)]))
    return out


def test_certified_cutoffs_hold_and_small_strata_get_none(spark):
    r = random.Random(5)
    rows = scored_rows(r, 3000, "large") + scored_rows(r, 60, "small") + scored_rows(r, 3000, "mixed", overlap=0.1)
    df = spark.createDataFrame(rows, "doc_id long, stratum string, y int, scores array<int>")
    proposed = riskrules.proposals(df.where("doc_id % 2 = 0"), slack=0.002)
    found = {x.stratum: x for x in riskrules.certified(df.where("doc_id % 2 = 1 AND y = 1"), proposed).collect()}
    assert "small" not in found and found["large"].bound <= riskrules.RISK and found["large"].rejected == 0
    cut = found["large"].cutoffs[0]
    assert 60 < cut <= 330
    if "mixed" in found:  # only where a cutoff above nearly all good rows exists
        lost = sum(x[3][0] >= found["mixed"].cutoffs[0] for x in rows if x[1] == "mixed" and x[2] == 1)
        assert lost <= 2 * riskrules.RISK * sum(x[1] == "mixed" and x[2] == 1 for x in rows)


def test_guarantee_over_many_draws():
    """The chance that a chosen factor rejects more than the risk stays below the error."""
    r, broken, draws = np.random.default_rng(6), 0, 400
    true = np.array([0.001, 0.004, 0.009, 0.015, 0.019, 0.0215, 0.03, 0.05])
    for _ in range(draws):
        u = r.random(1500)
        chosen = None
        for rate in true:
            if riskrules.upper_bound(int((u < rate).sum()), 1500, 0.1) > riskrules.RISK:
                break
            chosen = rate
        broken += chosen is not None and chosen > riskrules.RISK
    assert broken / draws <= 0.1 + 3 * math.sqrt(0.1 * 0.9 / draws)


def test_rules_verdicts(spark):
    r = random.Random(7)
    vocabulary = ["".join(r.choice("aeioutrnsl") for _ in range(r.randint(3, 8))) for _ in range(4000)]
    docs, labels = [], []
    for i in range(2400):
        w = r.sample(vocabulary, 60)
        bad = i % 4 == 0
        docs.append((i, " ".join(x + "###" if bad and r.random() < 0.6 else x for x in w), "en"))
        if i < 2000:
            labels.append((i, int(not bad), 0))
    docs += [(None, None, None), (5000, "", None), (5001, "one", "xx"), (5002, docs[0][1], None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([*labels, (None, 1, 1), (1, None, None), (3000, 7, 0)], "doc_id long, quality int, toxic int")
    found = riskrules.measured(d)
    out = {x.doc_id: x for x in riskrules.verdicts(found, riskrules.cutoffs(found, marks)).collect()}
    assert all(out[i].kept == (i % 4 != 0) for i in range(2400))
    assert "symbols" in out[2396].broken_rules
    assert not out[None].kept and out[None].base_failed and out[5002].kept  # a language without labels has no cutoffs
    none = riskrules.verdicts(found, riskrules.cutoffs(found, marks.limit(0)))
    assert none.where("kept = base_failed").count() == 0 and none.count() == len(docs)
    nothing = riskrules.measured(empty(spark))
    assert riskrules.verdicts(nothing, riskrules.cutoffs(nothing, marks)).collect() == []
