"""Policies: laws of the two-valued logic, ordering, inheritance, failures."""

import pytest
from pyspark.sql import functions as F

from cinemill.functions.media import HOLDS
from cinemill.plans import policy as P
from cinemill.plans.policy_queries import CONDITIONS, FILTERS, _library


@pytest.fixture(scope="module")
def library(spark, sf_dir):
    return _library(spark, sf_dir).limit(300).cache()


def test_double_negation_and_de_morgan(library):
    specs = [s for s, _ in FILTERS.values()]
    tests = []
    for a, b in zip(specs, specs[1:]):
        tests.append((P.selected("any", {"not": {"not": a}}), P.selected("any", a)))
        tests.append((P.selected("any", {"not": {"all": [a, b]}}), P.selected("any", {"any": [{"not": a}, {"not": b}]})))
    bad = library.select(*(F.count_if(~x.eqNullSafe(y)).alias(str(i)) for i, (x, y) in enumerate(tests))).first()
    assert not any(bad)


def test_conditions_are_never_null(library):
    conditions = [P.condition(s, library) for s, _ in CONDITIONS.values()]
    assert not any(library.select(*(F.count_if(c.isNull()).alias(str(i)) for i, c in enumerate(conditions))).first())


def test_mixed_types_compare_false(library):
    for op in ("==", "!=", "<"):
        assert library.where(P.condition({"field": "file.container", "is": [op, 3]}, library)).count() == 0
        assert library.where(P.condition({"field": "file.size", "is": [op, "x"]}, library)).count() == 0


def test_phases_follow_their_dependencies():
    phases = [{"name": "c", "depends_on": ["a", "b"]}, {"name": "b", "run_if": ["a", "modified"]}, {"name": "a"}]
    assert [p["name"] for p in P.ordered(phases)] == ["a", "b", "c"]
    for bad in ([{"name": "a", "depends_on": ["a"]}], [{"name": "a", "depends_on": ["z"]}], [{"name": "a"}, {"name": "a"}]):
        with pytest.raises(ValueError):
            P.ordered(bad)


def test_failure_strategies(library):
    actions = F.array(P.act("verify"), P.act("fail"), P.act("verify"))
    ops = lambda s: library.select(F.transform(P.halted(actions, s), lambda a: a["op"]).alias("x")).first()["x"]
    assert ops("abort") == ops("quarantine") == ["verify", "warn"] and ops("continue") == ["verify", "warn", "verify"] and ops("skip") == ["verify", "skip"]


def test_inheritance_and_differences():
    base = {"phases": [{"name": "a", "x": 1}, {"name": "b"}], "config": 1}
    new = P.extended(base, {"phases": [{"name": "a", "x": 2}, {"name": "c"}]})
    assert [p["name"] for p in new["phases"]] == ["a", "b", "c"] and new["config"] == 1
    assert P.differences(base, new) == [("phases.a.x", "changed"), ("phases.c", "added")]


def test_unknown_parts_are_errors(library):
    with pytest.raises(ValueError):
        library.select(P.selected("any", {"colour": 1}))
    with pytest.raises(ValueError):
        P.condition({"weather": 1}, library)
    with pytest.raises(ValueError):
        P.operation({"explode": 1}, library)


def test_phases_in_order_of_need_and_name():
    order = lambda *ps: [p["name"] for p in P.ordered([{"name": n, "depends_on": list(on)} for n, on in ps])]
    assert order(("a", ""), ("b", ""), ("c", "")) == ["c", "b", "a"]
    assert order(("x", ""), ("b", "x"), ("a", "x")) == ["x", "a", "b"]
    assert order(("last", ["mid"]), ("mid", ["first"]), ("first", [])) == ["first", "mid", "last"]
    with pytest.raises(ValueError, match="each other"):
        order(("a", "b"), ("b", "a"))
    with pytest.raises(ValueError, match="no phase"):
        order(("a", ["zz"]))


def test_policies_extend_through_a_chain():
    base = {"metadata": {"a": 1, "b": 1}, "config": {"x": 1}, "phases": [{"name": "one", "operations": [{"verify": "quick"}]}, {"name": "two", "operations": []}]}
    mid = {"extends": "base", "metadata": {"b": 2}, "phases": [{"name": "one", "extend": True, "operations": [{"container": "mkv"}]}]}
    top = {"extends": "mid", "config": {"y": 2}, "phases": [{"name": "two", "operations": [{"verify": "hash"}]}, {"name": "three", "operations": []}]}
    got = P.resolved("top", {"base": base, "mid": mid, "top": top})
    assert got["metadata"] == {"a": 1, "b": 2} and got["config"] == {"y": 2} and "extends" not in got
    assert [(p["name"], p["operations"]) for p in got["phases"]] == [("one", [{"verify": "quick"}, {"container": "mkv"}]), ("two", [{"verify": "hash"}]), ("three", [])]
    with pytest.raises(ValueError, match="extend each other"):
        P.resolved("a", {"a": {"extends": "b"}, "b": {"extends": "a"}})
    with pytest.raises(ValueError, match="no such policy"):
        P.resolved("a", {"a": {"extends": "zz"}})


def test_safeguards_are_told(library):
    phases = [
        {"name": "a", "operations": [{"remove": "audio", "where": {"lang": ["eng"]}}, {"remove": "audio", "where": {"not": {"lang": ["eng"]}}}, {"warn": "look at {filename}"}]},
        {"name": "b", "operations": [{"container": "avi"}]},
        {"name": "c", "skip_when": {"field": "phase.a.error_count", "is": [">", 0]}, "operations": [{"verify": "quick"}]},
        {"name": "d", "skip_when": {"field": "phase.b.warning_count", "is": ["==", 0]}, "operations": [{"verify": "quick"}]},
    ]
    out = {}
    for r in P.evaluate(library, {"phases": phases}).collect():
        out.setdefault(r.id, {})[r.phase] = r
    files = {r.id: r for r in library.collect()}
    kinds = {"lost": 0, "unfit": 0}
    for i, f in files.items():
        audio = [t for t in f.tracks if t.track_type.startswith("audio")]
        a, b = out[i]["a"], out[i]["b"]
        mixed = len({t.language == "eng" for t in audio}) == 2  # each removal alone leaves some, both together none
        assert [v.kind for v in a.violations] == (["no_audio_track"] if mixed else [])
        assert a.warnings[0] == f"look at {i}" and a.warnings[1:] == [v.message for v in a.violations] and out[i]["c"].status == ("skipped" if mixed else "pending")
        if mixed:
            assert a.violations[0].message == f"Safeguard: would have removed all audio tracks in {f.filename}, keeping them instead" and not a.actions
        bad = [t for t in f.tracks if t.codec not in HOLDS["avi"]] if f.container != "avi" else []
        assert [v.kind for v in b.violations] == (["container_incompatible"] if bad else []) and b.status == ("completed" if bad or f.container == "avi" else "pending")
        assert out[i]["d"].status == ("pending" if bad else "skipped")
        kinds["lost"] += mixed
        kinds["unfit"] += bool(bad)
    assert min(kinds.values()) > 0


def test_transcodes_and_new_tracks_count_for_the_container(library):
    made = P.act("synthesize_audio", F.lit(1), "opus/6/eng")
    actions = F.array(P.act("convert_container", None, "avi"), made)
    got = library.select("tracks", P.offenders(F.lit("avi"), actions).alias("bad")).collect()
    for r in got:
        assert r.bad == [*(f"track {t.stream_index} ({t.codec})" for t in r.tracks if t.codec not in HOLDS["avi"]), "synthesized (opus)"]
    turned = F.array(P.act("transcode_video", F.lit(0), '{"codec": "h264"}'), P.act("transcode_audio", F.lit(1), '{"codec": "opus"}'), P.act("remove_track", F.lit(2)))
    for r in library.select("tracks", P.offenders(F.lit("avi"), turned).alias("bad")).collect():
        codec = {0: "h264", 1: "opus"}
        assert r.bad == [f"track {t.stream_index} ({codec.get(t.stream_index, t.codec)})" for t in r.tracks if t.stream_index != 2 and codec.get(t.stream_index, t.codec) not in HOLDS["avi"]]
