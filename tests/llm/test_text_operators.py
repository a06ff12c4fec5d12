"""Each operator against a plain version of its contract, on awkward rows and on the small table."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cinemill.llm import decontaminate, htmlcrf, media, packing, pii, quality, rans, secrets, simhash, substrings, suffix
from cinemill.llm.common import table
from cinemill.llm.htmlpages import labelled_pages
from cinemill.llm.tokens import encoder, tokenizer_path
from tests.llm.helpers import awkward, awkward_rows, empty


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def pairs():
    return [(r[0], r[1] or "") for r in awkward_rows()]


def same_rows(found, wanted):
    assert Counter(map(tuple, found)) == Counter(wanted)


# secrets


def secret_base(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def test_secrets_match_the_patterns(spark):
    found = secrets.find_secrets(awkward(spark)).collect()
    wanted = []
    for d, t in pairs():
        spans = secret_base(t)
        n = [sum(k == i for _, k, _ in spans) for i in range(3)]
        wanted.append((d, *n, sha(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans).encode())))
    same_rows([(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in found], wanted)
    assert secrets.find_secrets(empty(spark)).collect() == []


def test_secrets_find_random_strings_and_leave_words(spark):
    import random

    r = random.Random(2)
    words = [" ".join("".join(r.choice("aeinorst") for _ in range(r.randint(2, 9))) for _ in range(200)) for _ in range(20)]
    key = "".join(r.choice(secrets.ALPHABETS["base64"]) for _ in range(40)).replace("+", "A").replace("/", "7")
    upper = "".join(r.choice(secrets.ALPHABETS["base32"]) for _ in range(40))
    rows = [(i, f"{w} {key if i == 3 else upper if i == 4 else 'internationalization2024plain'} end") for i, w in enumerate(words)]
    found = {x.doc_id: x.n_random for x in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[3] == 1 and found[4] == 1 and sum(found.values()) == 2


def test_battery_finds_planted_tokens_of_every_encoding_and_few_words(spark):
    """Random strings of each alphabet, alone or glued to words, among the small table's whole texts."""
    r = random.Random(6)
    rows = [(i, n, "".join(r.choice(secrets.ALPHABETS[n]) for _ in range(size))) for i, (n, size, _) in enumerate((n, size, k) for n in secrets.NAMES for size in (20, 40) for k in range(8))]
    texts = [(10**6 + i, f"see my-app/{w} for more" if i % 4 == 0 else f"see {w} for more") for i, _, w in rows]
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    found = {x.doc_id: x for x in secrets.find_secrets(docs.unionByName(spark.createDataFrame(texts, "doc_id long, text string"))).collect()}
    hit = Counter(n for i, n, _ in rows if found[10**6 + i].n_random + found[10**6 + i].n_hex)
    assert all(hit[n] >= 14 for n in secrets.NAMES) and sum(hit.values()) >= 0.95 * len(rows)
    false = sum(x.n_random for d, x in found.items() if d < 10**6)
    assert false <= max(1, 0.03 * len(rows))
    assert not any(x.n_random for x in secrets.find_secrets(docs.where("doc_id < 200")).collect())


def test_battery_p_values_are_uniform_for_random_draws_and_small_for_words():
    r = np.random.default_rng(3)
    rank = np.arange(26)
    ps = np.array([secrets.battery(r.integers(0, 26, 60), 26, rank) for _ in range(2000)])
    assert (np.abs((ps < 0.05).mean(0) - 0.05) < 0.03).all()
    words = np.array([secrets.VALUE["lower"][c] for c in "internationalizationandlocalizationofapplications"])
    pairs_of = np.zeros((128, 128))
    for a, b in zip("internationalizationsofapplicationsandlocalizationforusers" * 50, "nternationalizationsofapplicationsandlocalizationforusers" * 50):
        pairs_of[ord(a), ord(b)] += 1
    known = secrets.Ordinary("lower", pairs_of)
    assert secrets.combined(known.p_values(words)) > 0.001 > secrets.combined(known.p_values(r.integers(0, 26, 49)))
    assert 3 * min(secrets.battery(words, 26, known.rank)) < secrets.ALPHA


# personal data


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        c = int(c) * (1 + i % 2)
        total += c - 9 if c > 9 else c
    return total % 10 == 0


def personal_base(text):
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    out = []
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = (True, k != 1 or all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(digits) <= 19 and luhn(digits), 9 <= len(digits) <= 15)[k]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_personal_data_matches_the_patterns(spark):
    extra = [
        "a@b.c_d@e.f", "1.2.3.4.5.6.7.8.9", "001.002.003.255 1.2.3.999", "4111111111111111" * 3, "+1234567890 +(12) +1 2", "é 😀 me@ex.org", "9" * 5000, ("1." * 3000) + "1",
        "x" * 4000 + "@", "-@-.- %@%.c 5555 5555-5555 4444",
    ]
    rows = pairs() + [(100 + i, t) for i, t in enumerate(extra)]
    found = pii.find_personal(spark.createDataFrame(rows, "doc_id long, text string"))
    got = found.select("doc_id", F.transform("base", lambda s: F.struct(s["start"], s["kind"], s["end"])).alias("b")).collect()
    same_rows([(r[0], tuple(tuple(x) for x in r[1])) for r in got], [(d, tuple(personal_base(t))) for d, t in rows])
    assert pii.find_personal(empty(spark)).collect() == []


def test_disclosing_terms_need_two_contexts(spark):
    filler = [(i, f"ordinary words number nothing {i}") for i in range(200)]
    told = [(1000, "Quentin wrote to q@x.org about lunch"), (1001, "call Quentin or mail q@x.org today please"), (1002, "copy one hapaxword z@x.org end"), (1003, "copy one hapaxword z@x.org end")]
    docs = spark.createDataFrame(filler + told, "doc_id long, text string")
    terms = {(r.doc_id, docs_text[s.start : s.end]) for r in pii.find_personal(docs).where("size(terms) > 0").collect() for docs_text in [dict(filler + told)[r.doc_id]] for s in r.terms}
    assert terms == {(1000, "Quentin"), (1001, "Quentin")}
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert clean[1000] == " wrote to [EMAIL] about lunch" and clean[1002] == "copy one hapaxword [EMAIL] end" and clean[5] == "ordinary words number nothing 5"


def test_disclosure_counts_whole_documents_and_generalises(spark):
    """Against counts by hand: near the entity twice, beside it in all its documents, marked wherever it stands."""
    r = random.Random(4)
    far = " ".join("".join(r.choice("bdfg") + r.choice("aeiou") for _ in range(4)) for _ in range(60))
    texts = {i: f"common words and quartz quest quiet {''.join(r.choice('klmn') + r.choice('aeiou') for _ in range(4))}" for i in range(300)}
    for k in range(10):  # within the window in two of ten documents only
        texts[1000 + k] = f"no {k} Querelle {'' if k < 2 else far} o@x.org and Xylotomo{'' if k < 2 else ' ' + far}"
    texts[2000] = "Querelle stands alone"  # in a document without the entity
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {x.doc_id: [(texts[x.doc_id][t.start : t.end], t.ratio, t.put) for t in x.terms] for x in pii.find_personal(docs).collect()}
    total, content = len(texts), math.log2(len(texts) / 10)
    for k in range(10):
        marked = {w: (ratio, put) for w, ratio, put in found[1000 + k]}
        assert {"Querelle", "Xylotomo"} <= set(marked)
        assert marked["Xylotomo"] == (pytest.approx(1.0), "")  # no class of its is frequent
        assert marked["Querelle"] == (pytest.approx(math.log2(10 * total / (10 * 11)) / content), "[QUE*]")
    assert not any(found[d] for d in found if d < 1000 or d == 2000)
    clean = {x.doc_id: x.text for x in pii.sanitised(docs).collect()}
    assert clean[1000] == "no 0 [QUE*]  [EMAIL] and " and clean[2000] == texts[2000]


def test_sanitised_keeps_columns_and_rows(spark):
    df = awkward(spark)
    out = pii.sanitised(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert pii.sanitised(empty(spark)).columns == df.columns


# near duplicates


def fingerprint(text, k=3):
    w = text.encode().lower().split()
    grams = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints_and_components(spark):
    rows = pairs()
    found = simhash.near_duplicates(awkward(spark)).collect()
    fps = [fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    least = {k: min((rows[i][0] for i in range(len(rows)) if label[i] == k and rows[i][0] is not None), default=None) for k in set(label)}
    same_rows([(r.doc_id, r.fp % (1 << 64), r.component_id) for r in found], [(d, f, least[k]) for (d, _), f, k in zip(rows, fps, label)])
    assert simhash.near_duplicates(empty(spark)).collect() == []


def brute_roots(fps, radius):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if (int(fps[i]) ^ int(fps[j])).bit_count() <= radius and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


@pytest.mark.parametrize("hot", [4096, 3])
def test_links_through_shards_and_hot_shards(spark, hot):
    r = np.random.default_rng(4)
    centres = r.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = {int(c) for c in centres}
    for c in centres:
        for _ in range(12):
            x = int(c)
            for b in r.integers(0, 64, r.integers(0, 6)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = np.array(sorted(fps), dtype=np.uint64)
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    from cinemill.llm.graph import components

    roots = {r.node: r.root for r in components(simhash.link_roots(nodes, 3, hot)).collect()}
    wanted = brute_roots(fps, 3)
    signed = fps.view(np.int64).tolist()
    groups = defaultdict(set)
    for i, x in enumerate(signed):
        groups[wanted[i]].add(x)
    got = defaultdict(set)
    for x in signed:
        got[roots.get(x, x)].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_bk_tree_finds_what_a_scan_finds():
    r = np.random.default_rng(1)
    fps = np.unique(r.integers(0, 1 << 12, 300, dtype=np.uint64))
    q, n = simhash.BKTree(fps).within(fps, 2)
    assert set(zip(q.tolist(), n.tolist())) == {(i, j) for i in range(len(fps)) for j in range(len(fps)) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 2}


@pytest.mark.parametrize("hot", [4096, 5])
def test_near_copies_share_most_shingles(spark, hot):
    import random

    r = random.Random(6)
    rows, base = [], []
    for k in range(20):
        w = ["w%d" % r.randrange(5000) for _ in range(300)]
        base.append(w)
        rows.append((k, " ".join(w)))
        close, apart = list(w), list(w)
        for i in r.sample(range(300), 4):
            close[i] = "changed"
        for i in r.sample(range(300), 90):
            apart[i] = "x%d" % r.randrange(5000)
        rows += [(100 + k, " ".join(close)), (200 + k, " ".join(apart)), (300 + k, " ".join(w).upper())]
    found = {x.doc_id: x.component_id for x in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()}
    assert all(found[k] == found[100 + k] == found[300 + k] == k and found[200 + k] == 200 + k for k in range(20))
    assert simhash.near_copies(empty(spark)).collect() == []


# repeated substrings


@pytest.mark.parametrize("waves", [4096, 0])
def test_suffix_array_and_common_prefixes(monkeypatch, waves):
    monkeypatch.setattr(suffix, "WAVES", waves)
    r = random.Random(1)
    for _ in range(60):
        b = bytes(r.randrange(97, 97 + r.choice((1, 2, 3, 26))) for _ in range(r.randint(1, 120)))
        t = np.frombuffer(b, np.uint8)
        wanted = sorted(range(len(b)), key=lambda i: b[i:])
        sa = suffix.suffix_array(t)
        assert sa.tolist() == wanted
        lcp = suffix.permuted_lcp(t, sa)
        for x, y in zip(wanted, wanted[1:]):
            k = 0
            while k < min(len(b) - x, len(b) - y) and b[x + k] == b[y + k]:
                k += 1
            assert lcp[y] == k


def test_suffix_array_of_many_names():
    """A text whose recursion has more names than a scan by buckets takes, with copies and periods."""
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 9))) for _ in range(30_000)]
    raw = " ".join(words + words[5000:9000] + ["x"] * 3000).encode()
    t = np.frombuffer(raw, np.uint8)
    sa = suffix.suffix_array(t)
    assert sorted(sa.tolist()) == list(range(len(raw)))
    lcp = suffix.permuted_lcp(t, sa)
    for x, y in zip(sa[:-1].tolist(), sa[1:].tolist()):
        k = int(lcp[y])
        assert raw[x : x + k] == raw[y : y + k] and raw[x + k : x + k + 1] < raw[y + k : y + k + 1]


def brute_repeats(texts, width):
    seen = defaultdict(list)
    for d, t in enumerate(texts):
        for i in range(len(t) - width + 1):
            seen[t[i : i + width]].append((d, i))
    cover = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                cover[d][i : i + width] = b"\1" * width
    out = []
    for t, c in zip(texts, cover):
        kept = bytes(x for x, y in zip(t, c) if not y)
        out.append((len(t), sum(c), len(re.findall(b"\1+", bytes(c))), sha(kept)))
    return out


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeats_equal_brute_force(spark, hot):
    rows = [(d, t if len(t) < 50_000 else t[:9000]) for d, t in pairs()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = substrings.remove_repeats(df, width=40, hot=hot, shard_bytes=2000).collect()
    wanted = [(d, *w) for (d, _), w in zip(rows, brute_repeats([t.encode() for _, t in rows], 40))]
    same_rows([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found], wanted)


def test_repeats_of_whole_texts_at_full_width(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()] + [(-1, b"ab" * 4000)]
    seen = defaultdict(list)
    for k, (_, t) in enumerate(rows):
        for i in range(len(t) - 399):
            seen[xxhash.xxh3_128_digest(t[i : i + 400])].append((k, i))
    cover = [bytearray(len(t)) for _, t in rows]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                cover[k][i : i + 400] = b"\1" * 400
    wanted = []
    for (d, t), c in zip(rows, cover):
        kept = bytes(x for x, y in zip(t, c) if not y)
        wanted.append((d, len(t), sum(c), len(re.findall(b"\1+", bytes(c))), sha(kept), kept.decode(errors="replace")))
    found = substrings.remove_repeats(docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, "ab" * 4000)], "doc_id long, text string"))).collect()
    same_rows([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.text) for r in found], wanted)


def test_planted_passages_show_in_n_removed(spark, tmp_path):
    """Passages of over 50 words in two documents each: those of 400 bytes go whole, shorter ones stay; n_bytes is the input's length in either case."""
    r = random.Random(6)

    def text(n, longest):
        return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(4, longest))) for _ in range(n))

    rows, planted = [], {}
    for k in range(30):
        passage = text(r.randint(70, 200), 12) if k % 2 else text(r.randint(51, 55), 6)
        for d in (3 * k, 3 * k + 1):
            rows.append((d, f"{text(r.randint(30, 400), 12)} {passage} {text(r.randint(30, 400), 12)}"))
            planted[d] = passage
        rows.append((3 * k + 2, text(r.randint(30, 900), 12)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {x.doc_id: x for x in substrings.op3_substrings(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows)
    for d, t in rows:
        x, passage = found[d], planted.get(d, "")
        assert x.n_bytes == len(t)
        if len(passage) >= 400:
            assert x.n_spans == 1 and x.n_removed >= len(passage) and passage not in x.text and len(x.text) == len(t) - x.n_removed
        else:
            assert (x.n_removed, x.n_spans, x.text, x.kept_sha256) == (0, 0, t, sha(t.encode()))


def test_repeats_of_no_rows(spark):
    assert substrings.remove_repeats(empty(spark)).collect() == []


# tokens


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_ids_equal_the_library(spark, name):
    enc = encoder(tokenizer_path(name))
    odd = ["a  b", "a\tb", " a", "a\n\nb", "a \nb\x1cc x", "don't DON'T É'S İ, Σας ΟΔΟΣ,", "é x́", "<|endoftext|> a", "a\r\nb", "\x01 a \x01b", "12ab3 ½ ²", " x y"]
    for t in odd + [t for _, t in pairs()] + [r.text for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]:
        assert enc.encode_ids(t).tolist() == enc.lib.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_odd_texts_equal_the_librarys(name):
    enc, r = encoder(tokenizer_path(name)), random.Random(7)
    letters = " \n\t'sabtß\u03a3\u00c0\u0301\u0130中1.,!\x1c\x0b\u00a0\U0001f600\ufb01"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    for text, ids in zip(texts, enc.encode_many(texts, chars=500), strict=True):
        assert ids.tolist() == enc.lib.encode(text, add_special_tokens=False).ids, text


def check_pieces(rows, found, max_tokens, max_segments, max_loss):
    enc = encoder(tokenizer_path("word_bpe_49k.json"))
    docs = Counter()
    for d, t in rows:
        ids = np.array([*enc.lib.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
        docs[(d, ids.tobytes())] += 1
    by_doc = defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
    for d in {d for d, _ in docs}:
        total = sum(len(raw) // 4 * n for (e, raw), n in docs.items() if e == d)
        assert sum(r.length for r in by_doc[d]) == total
    for r in found:
        raws = [raw for (e, raw) in docs if e == r.doc_id and len(raw) // 4 == r.doc_tokens]
        assert any(zlib.crc32(raw[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for raw in raws)
    seqs = defaultdict(list)
    for r in found:
        seqs[r.sequence_id].append(r)
    for pieces in seqs.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for p in pieces:
            assert p.offset == at
            at += p.length
        assert at <= max_tokens and len(pieces) <= max_segments and sum(p.loss_tokens for p in pieces) <= max_loss
    return seqs


def test_packing_covers_every_token_once(spark):
    found = packing.pack(awkward(spark), tokenizer_path("word_bpe_49k.json"), 2).collect()
    seqs = check_pieces(pairs(), found, 4096, 256, 4096)
    padded = sum(4096 - n for n in (sum(p.length for p in s) for s in seqs.values()) if n & (n - 1))
    assert padded == 0
    assert packing.pack(empty(spark), tokenizer_path("word_bpe_49k.json"), 2).collect() == []


def test_packing_limits_bind_together():
    import random

    r = random.Random(3)
    lengths = [r.randint(1, 900) for _ in range(300)]
    prompts = [r.randint(0, n) for n in lengths]
    seqs = packing.place(lengths, prompts, 512, 4, 200)
    seen = [np.zeros(n, dtype=int) for n in lengths]
    for pieces in seqs:
        assert sum(n for _, _, n in pieces) <= 512 and len(pieces) <= 4
        assert sum(n - min(n, max(0, prompts[i] - s)) for i, s, n in pieces) <= 200
        for i, s, n in pieces:
            seen[i][s : s + n] += 1
    assert all((x == 1).all() for x in seen)


def test_packing_prompts_bear_no_loss(spark):
    df = spark.createDataFrame([(1, "a question", "the answer")], "doc_id long, q string, text string")
    found = packing.pack(df, tokenizer_path("word_bpe_49k.json"), 2, prompt_col="q").collect()
    assert sum(r.length for r in found) == 5 and sum(r.loss_tokens for r in found) == 3


# token files


def test_token_files_round_trip(spark, tmp_path):
    rows = sorted(pairs(), key=lambda r: (r[0] is not None, r[0]))
    enc = encoder(tokenizer_path("byte_bpe_50k.json"))
    manifest = rans.write_files(awkward(spark), f"file://{tmp_path}/t", tokenizer_path("byte_bpe_50k.json"), 2, tokens_per_file=5000)
    found = rans.read_files(manifest).collect()
    wanted = Counter()
    for d, t in rows:
        ids = np.array([*enc.lib.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
        wanted[(d, len(ids), ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids)) for r in found) == wanted
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    starts = [r.start for r in sorted((r for r in found if r.doc_id is not None), key=lambda r: r.doc_id)]
    assert starts == sorted(starts)
    none = rans.write_files(empty(spark), f"file://{tmp_path}/e", tokenizer_path("byte_bpe_50k.json"), 2)
    assert rans.read_files(none).collect() == []


def test_coder_blocks_and_corruption():
    r = np.random.default_rng(0)
    ids = np.minimum(r.geometric(0.01, 3 * rans.BLOCK + 777), 500).astype(np.uint32)
    t = rans.Table(rans.scaled(np.bincount(ids, minlength=600)))
    index, states, words = rans.encode_blocks(ids, t)
    assert (rans.decode_blocks(index, states, words, len(ids), t) == ids).all()
    assert (rans.decode_blocks(index, states, words, len(ids), t, 2, 3) == ids[2 * rans.BLOCK : 3 * rans.BLOCK]).all()
    raw = rans.to_bytes([1, None], np.array([len(ids) - 5, 5]), ids, t, 2)
    docs, counts, back = rans.from_bytes(raw, t)
    assert docs == [1, None] and counts.tolist() == [len(ids) - 5, 5] and (back == ids).all()
    for at in (5, 60, len(raw) // 2, len(raw) - 1):
        bad = bytearray(raw)
        bad[at] ^= 1
        with pytest.raises(rans.CorruptFile):
            rans.from_bytes(bytes(bad), t)


# media


def test_media_read_back(spark):
    found = media.digests(media.stored(awkward(spark))).collect()
    wanted = []
    for d, t in pairs():
        raw = t.encode()
        padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        wanted.append((d, len(raw), len(padded), sha(padded), zlib.crc32(padded[-64:])))
    same_rows([(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in found], wanted)
    by_text = defaultdict(set)
    for r in found:
        by_text[r.payload_sha256].add((r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_text.values())
    assert media.digests(media.stored(empty(spark))).collect() == []
    assert media.clips(media.stored(empty(spark))).collect() == []


def test_media_bytes_and_damage():
    r = np.random.default_rng(9)
    payloads = [bytes(64), b"\xff" * 128, r.integers(0, 256, 64 * 150, dtype=np.uint8).tobytes()]
    files = media.encode(payloads)
    assert [b"".join(f.tobytes() for f in frames) for frames in media.decode(files)] == payloads
    for at in (3, files[2].find(b"00dc") + 4, files[2].find(b"\xff\xda") + 7, len(files[2]) - 3):
        bad = bytearray(files[2])
        bad[at] ^= 0x55
        with pytest.raises(media.CorruptMedia):
            media.decode([bytes(bad)])
    with pytest.raises(media.CorruptMedia):
        media.decode([files[2][:-100]])


def test_shots_follow_histograms():
    r = np.random.default_rng(2)
    dark, light = (lambda: r.integers(0, 60, (64, 64), dtype=np.uint8)), (lambda: r.integers(150, 250, (64, 64), dtype=np.uint8))
    assert media.shots([dark() for _ in range(6)] + [light() for _ in range(5)]) == [(0, 6), (6, 11)]
    assert media.shots([]) == []


# pages


def test_pages_training_accuracy_and_null_html(spark):
    field = htmlcrf.tagger(labelled_pages(200))
    right = total = 0
    for page, labels in labelled_pages(80, seed=77):
        blocks = htmlcrf.leaf_blocks(page)
        assert [b[0] for b in blocks] == [" ".join(t.split()) for t, _ in labels]
        got = field.decode([htmlcrf.features(blocks, k) for k in range(len(blocks))])
        right += sum(a == b for a, (_, b) in zip(got, labels))
        total += len(labels)
    assert right / total > 0.98
    html = "<body><nav><a href=x>Home</a></nav><article><h1>T&amp;t</h1><p>One  two<br>three <b>four</b><p>&eacute;nd.</article><footer>&copy; x</footer><script>var a='<p>no</p>'</script>"
    rows = [(1, "u", html), (2, None, None), (3, "u", ""), (4, "u", "<p"), (5, "u", "<!-- never closed <p>x</p>"), (1, "u", html)]
    df = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    found = sorted((r.page_id, r.text, r.n_chars) for r in htmlcrf.extract(df, field).collect())
    text = "T&t\nOne two three four\nénd."
    assert [x for x in found if x[0] == 1] == [(1, text, len(text))] * 2
    assert [x for x in found if x[0] in (2, 3, 5)] == [(2, "", 0), (3, "", 0), (5, "", 0)]
    assert htmlcrf.extract(df.limit(0), field).collect() == []


@pytest.mark.parametrize(
    "page, wanted",
    [
        ("<article><svg/><p>one</p><svg class='i' />two</article>", ["one", "two"]),
        ("<article><svg><text>unseen</text></svg><p>one</p></article>", ["one"]),
        ("<html><head><title>t</title><meta charset=utf-8><div>one</div><p>two", ["one", "two"]),
        ("<head><noscript><div>unseen</div></noscript><title>t</title></head><p>one", ["one"]),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds<p><math/>end", ["so x=2 holds", "end"]),
    ],
)
def test_odd_pages_keep_their_text(page, wanted):
    assert [b[0] for b in htmlcrf.leaf_blocks(page)] == wanted


def test_viterbi_is_the_best_labelling():
    from itertools import product

    field = htmlcrf.ChainField()
    r = np.random.default_rng(3)
    field.weight, field.start, field.move = {k: float(r.normal()) for k in "abcd"}, r.normal(size=2), r.normal(size=(2, 2))
    for _ in range(20):
        page = [[k for k in "abcd" if r.random() < 0.5] for _ in range(6)]
        score = lambda y: field.start[y[0]] + sum(field.move[a, b] for a, b in zip(y, y[1:])) + sum(sum(field.weight[f] for f in x) for x, k in zip(page, y) if k)
        assert score(field.decode(page)) == pytest.approx(max(score(y) for y in product((0, 1), repeat=6)))


# decontamination


def test_wand_returns_all_above_the_threshold():
    import random

    r = random.Random(8)
    vocabulary = ["w%d" % i for i in range(12)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(2, 12)))) for i in range(150)]
    index = decontaminate.Index(items)
    for threshold in (0.1, 0.3, 0.6):
        for _ in range(40):
            words = [r.choice(vocabulary) for _ in range(r.randint(1, 30))]
            _, terms = index.terms(words)
            terms = sorted(set(terms.tolist()))
            score = Counter()
            for t in terms:
                for i, x in zip(index.item[t], index.impact[t]):
                    score[i] += x
            wanted = {i: s for i, s in score.items() if s >= threshold - 1e-9}
            assert dict(index.search(terms, threshold)) == pytest.approx(wanted)


@pytest.mark.parametrize("shard_words", [250_000, 1000, 20])
def test_leaks_are_found_and_clean_rows_stay(spark, shard_words):
    items = [(1, "What colour is the summer sky at noon. It is blue as the deep sea"), (2, "Single"), (3, ""), (4, None), (5, "first second third fourth fifth sixth. Seven eight.")]
    filler = " ".join("x%d" % i for i in range(300))
    docs = [
        (1, f"{filler} WHAT colour is the summer sky, at noon? It is blue as the deep sea! {filler}"), (2, f"{filler} the summer sky {filler}"), (3, None), (4, ""),
        (5, "first second third fourth fifth sixth. Seven eight."), (5, "first second third fourth fifth sixth. Seven eight."), (6, "first second third"),
    ]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, score string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(d, b, shard_words=shard_words).collect()
    assert Counter((r.doc_id, r.item_id) for r in found) == Counter({(1, 1): 1, (5, 5): 2})
    kept = decontaminate.without_leaks(d, b, shard_words=shard_words)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6]
    assert decontaminate.contaminated(d.limit(0), b).collect() == [] and decontaminate.contaminated(d, b.limit(0)).collect() == []


def test_rows_do_not_depend_on_how_the_items_are_cut(spark):
    import random

    r = random.Random(12)
    vocabulary = ["w%d" % i for i in range(40)]
    items = [(i, ". ".join(" ".join(r.choice(vocabulary) for _ in range(r.randint(3, 9))) for _ in range(2))) for i in range(60)]
    docs = []
    for i in range(150):  # parts of items, so that many scores lie about the threshold
        words = r.choice(items)[1].split()
        a = r.randint(0, len(words) // 2)
        docs.append((i, " ".join([*(r.choice(vocabulary) for _ in range(r.randint(0, 20))), *words[a : r.randint(a + 1, len(words))], *(r.choice(vocabulary) for _ in range(r.randint(0, 20)))])))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = [sorted(map(tuple, decontaminate.contaminated(d, b, threshold=0.3, shard_words=n).collect())) for n in (10**9, 200, 20)]
    assert len(found[0]) > 5 and any(x[2] < 0.9 for x in found[0])
    for other in found[1:]:
        assert [x[:2] for x in other] == [x[:2] for x in found[0]] and np.allclose([x[2:] for x in other], [x[2:] for x in found[0]])


# quality


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = quality.scored(table(spark, sf, "documents"), quality.train(table(spark, sf, "documents"), table(spark, sf, "labels")))
    rows = found.join(table(spark, sf, "labels"), "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    right = {y: [(r.score >= 0.3) == bool(r.quality) for r in rows if r.quality == y] for y in (0, 1)}
    assert len(rows) > 50 and np.mean(right[0] + right[1]) > 0.95 and np.mean(right[0]) >= 0.9 and np.mean(right[1]) >= 0.95


def test_quality_tells_texts_by_their_words(spark):
    """Both classes are made of the same letters, so only words and letter strings tell them apart; labelled ids stand on many rows."""
    r = random.Random(12)
    good, bad = "listen elbow night inch study dusty".split(), "silent below thing chin dusty study".split()
    texts = [(i, " ".join(r.choice((good if i % 2 else bad)[:4] + ["the", "of", "and"]) for _ in range(150))) for i in range(400)]
    docs = spark.createDataFrame(texts + [texts[5]] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    found = quality.scored(docs, quality.train(docs, labels, sample=150)).withColumn("out", quality.held_out(F.col("doc_id"))).collect()
    held = [(x.score >= 0.5) == bool(x.doc_id % 2) for x in found if x.out]
    assert len(held) > 50 and np.mean(held) > 0.95


def test_quality_awkward_rows(spark):
    labels = spark.createDataFrame([(6, 1, 0), (6, 0, 0), (10, 1, 0), (2, None, 0), (None, 1, 0), (12, 0, 0)], "doc_id long, quality int, toxic int")
    df = awkward(spark)
    model = quality.train(df, labels)
    found = quality.scored(df, model).collect()
    assert len(found) == df.count() and all(0 <= r.score <= 1 for r in found)
    kept = quality.keep_good(df, model, 0.0)
    assert kept.columns == df.columns and kept.count() == df.count()
    assert quality.scored(empty(spark), model).collect() == []
    for few in (labels.limit(0), labels.where("quality = 1")):
        assert all(0 <= r.score <= 1 for r in quality.scored(df, quality.train(df, few)).collect())


def test_attention_gradients():
    r = np.random.default_rng(0)
    m = quality.AttentionBags()
    x, first, y = r.normal(size=(9, quality.WIDTH)), np.array([0, 2, 6]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(y * np.log((p := m.forward(x, first)["y"])) + (1 - y) * np.log(1 - p))
    g = m.gradients(x, first, y)
    for k, a in m.p.items():
        at = tuple(0 for _ in a.shape)
        before = a[at]
        a[at] = before + 1e-6
        up = loss()
        a[at] = before - 1e-6
        down = loss()
        a[at] = before
        assert g[k][at] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-7)
