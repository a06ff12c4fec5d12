"""Every registered query with SQL against DuckDB on the small tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from cinemill.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(plain(x) for x in v)
    if v is None or pd.isna(v):
        return None
    if hasattr(v, "item") and not isinstance(v, pd.Timestamp):
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) and float(v).is_integer() and abs(v) < 1e15:
        return int(v)
    return str(v) if isinstance(v, pd.Timestamp) else v


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(x) for x in r) for r in df[cols].itertuples(index=False)), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, db, name):
    assert rows(registry.QUERIES[name](spark, sf_dir).toPandas()) == rows(db.sql(registry.ORACLE_SQL[name]).df())


def test_entry_has_rows(spark):
    assert entry.entry(spark).take(1)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_greedy_cover_is_greedy(spark):
    from cinemill.operators.catalogue import greedy_cover

    features = [(1, 10, "a"), (1, 10, "b"), (2, 5, "b"), (2, 5, "c"), (3, 5, "b"), (3, 5, "c"), (4, 1, "d"), (5, 99, "e")]
    got = greedy_cover(spark.createDataFrame(features, "item long, size long, feature string"), 5, 20).collect()
    assert [(r["item"], r["gain"]) for r in got] == [(2, 2), (4, 1), (1, 1)]


def test_lineage_walks_chains_to_their_transitions(spark, sf_dir):
    from cinemill.sources import library as L

    files = {r.id: r.superseded_by for r in L.files(spark, sf_dir).select("id", "superseded_by").collect()}
    before, logs = {}, {}
    for i, by in files.items():
        if by is not None:
            before.setdefault(by, []).append(i)
    for r in L.transitions(spark, sf_dir).select("id", "file_id").collect():
        logs.setdefault(r.file_id, []).append(r.id)
    wanted = []
    for root in files:
        level = [root]
        for hop in range(50):
            wanted += [(root, hop, i, t) for i in level for t in logs.get(i, [])]
            level = [k for i in level for k in before.get(i, []) if k != root]
    found = registry.QUERIES["j17_d19_u06_lineage_transitions"](spark, sf_dir).collect()
    assert sorted((r.root, r.hop, r.file_id, r.transition_id) for r in found) == sorted(wanted)
    assert max(r.hop for r in found) > 0


def test_greedy_cover_equals_brute_force(spark):
    import random

    from cinemill.operators.catalogue import greedy_cover

    r = random.Random(5)
    for _ in range(3):
        items = {i: (r.randint(1, 20), {r.choice("abcdefghijkl") for _ in range(r.randint(1, 5))}) for i in range(15)}
        rows = [(i, size, f) for i, (size, fs) in items.items() for f in fs]
        wanted, covered, left = [], set(), 40
        while len(wanted) < 5:
            open_ = [(-len(fs - covered), size, i) for i, (size, fs) in items.items() if size <= left and fs - covered and i not in {w[0] for w in wanted}]
            if not open_:
                break
            gain, size, i = min(open_)
            wanted.append((i, -gain))
            covered |= items[i][1]
            left -= size
        got = greedy_cover(spark.createDataFrame(rows, "item long, size long, feature string"), 5, 40).collect()
        assert [(x["item"], x["gain"]) for x in got] == wanted


def test_summed_speech_wins_a_vote(spark):
    from cinemill.operators.history import language_vote

    rows = [(1, 0, "eng", 5), (1, 0, "eng", 5)] + [(1, 0, "fre", 50)] * 3 + [(2, 0, "eng", 95), (2, 0, "eng", 99), (3, 1, "eng", 95), (3, 1, "spa", 20)]
    got = {(x["file_id"], x["track"]): (x["language"], x["confidence"]) for x in language_vote(spark.createDataFrame(rows, "file_id long, track long, language string, silence long")).collect()}
    assert got == {(1, 0): ("eng", 0.38), (2, 0): ("zxx", 0.97), (3, 1): ("spa", 0.8)}


def test_malformed_violations_are_an_error(spark):
    from cinemill.operators.measures import violations

    for bad in ('{"safeguard_violations":{"kind":"x"}}', '{"safeguard_violations":"x"}', '{"safeguard_violations":[{"message":"x"}]}'):
        df = spark.createDataFrame([(bad,)], "m string")
        with pytest.raises(Exception, match="malformed"):
            df.select(violations(df.m)).collect()


def test_crop_needs_no_lock_and_never_grows_beyond_the_source(spark):
    from cinemill.operators.measures import merged_crop

    rows = [(1, 1920, 1080, 10, 141, 9, 139), (1, 1920, 1080, 12, 145, 8, 150), (2, 640, 480, 0, 3, 0, 2)]
    df = spark.createDataFrame(rows, "file_id long, width int, height int, left int, top int, right int, bottom int")
    plain_ = {x.file_id: (x.left, x.top, x.right, x.bottom) for x in merged_crop(df, 4, 0, []).collect()}
    assert plain_ == {1: (10, 141, 8, 139), 2: (0, 0, 0, 0)}
    locked = {x.file_id: (x.left, x.top, x.right, x.bottom) for x in merged_crop(df, 4, 0, [(64, 27)]).collect()}
    left, top, right, bottom = locked[1]
    assert (1920 - left - right, 1080 - top - bottom) == (1902, 804) and top <= 141 and bottom <= 139 and locked[2] == (0, 0, 0, 0)
