import datetime
import json

import pytest
from pyspark.sql import functions as F

from askloom import config
from askloom.operators import manifest as J
from askloom.operators import rubric as H
from askloom.operators import verification as Y
from askloom.sources import files


def test_roles_from_a_file(tmp_path, monkeypatch):
    monkeypatch.setenv("ASKLOOM_KEY", "set")
    raw = {"endpoints": {"a": {"model": "m1", "timeout": 4, "key": "$ASKLOOM_KEY"}, "b": {"model": "m2", "key": "${ASKLOOM_KEY}x"}}, "roles": {"judge": "a", "weak": {"endpoint": "b"}, "strong": {"endpoint": "a", "timeout": 7}}}
    (tmp_path / "c.json").write_text(json.dumps(raw))
    roles = config.load(str(tmp_path / "c.json"))["resolved"]
    assert roles == {"judge": {"model": "m1", "timeout": 4, "key": "set"}, "weak": {"model": "m2", "key": "setx"}, "strong": {"model": "m1", "timeout": 7, "key": "set"}}
    with pytest.raises(KeyError):
        config.expanded("$ASKLOOM_NOT_SET")
    assert config.preset({"name": "x", "weak_avg_max": 0.5, "weak_inclusive": True, "strong_avg_min": 0.65, "gap_min": 0.2}).weak_avg_max == 5000


def test_manifest_on_the_driver():
    first = config.merged_manifest(None, {"recipe": "x", "paper_ids": ["a", "b"]})
    same = config.merged_manifest(first, {"recipe": "x", "paper_ids": ["b", "c"]})
    with pytest.raises(ValueError):
        config.merged_manifest(same, {"recipe": "y", "paper_ids": ["a"]})
    other = config.merged_manifest(same, {"recipe": "y", "paper_ids": ["a"]}, allow_mismatch=True)
    assert same["paper_ids"] == other["paper_ids"] == ["a", "b", "c"] and other["history"] == [{"recipe": "x"}]


def test_manifests_as_tables(spark):
    stored = spark.createDataFrame([("r", "p2", 1), ("r", "p1", 2), ("s", "p9", 1)], "root string, paper string, place int")
    new = spark.createDataFrame([("r", "p1", 1), ("r", "p3", 2), ("r", "p0", 3), ("t", "p5", 1), ("t", "p5", 2)], "root string, paper string, place int")
    got = sorted(tuple(r) for r in J.merged_papers(stored, new).collect())
    assert got == [("r", "p0", 4), ("r", "p1", 2), ("r", "p2", 1), ("r", "p3", 3), ("s", "p9", 1), ("t", "p5", 1)]
    old = spark.createDataFrame([("r", "x", None, 1), ("s", "x", 3, 0)], "root string, recipe string, rounds int, n_history int")
    asked = spark.createDataFrame([("r", "y", None), ("s", "x", 3), ("t", "z", 1)], "root string, recipe string, rounds int")
    rows = {r.root: (r.changed, r.n_history) for r in J.merged_manifests(old, asked, ["recipe", "rounds"]).collect()}
    assert rows == {"r": (["recipe"], 2), "s": ([], 0), "t": ([], 0)}


def test_roles_as_tables(spark):
    endpoints = spark.createDataFrame([("a", {"model": "m", "url": "$HOST:${PORT}/$HOSTS"})], "endpoint string, options map<string,string>")
    roles = spark.createDataFrame([("x", "a", None), ("y", "a", {"model": "n"}), ("z", "none", None)], "role string, endpoint string, overrides map<string,string>")
    variables = F.create_map(*map(F.lit, ["HOST", "h", "HOSTS", "hh", "PORT", "1"]))
    got = {r.role: r.options for r in J.resolved_roles(roles, endpoints, variables).collect()}
    assert got == {"x": {"model": "m", "url": "h:1/hh"}, "y": {"model": "n", "url": "h:1/hh"}, "z": None}


def test_criteria_say_what_presets_say(spark):
    for p in H.PRESETS.values():
        c = lambda x: F.lit(None if x is None else x // 100).cast("int")
        row = spark.range(1).select(*J.criteria(c(p.weak_avg_max), F.lit(p.weak_inclusive), c(p.weak_attempt_max), F.lit(p.weak_no_zero), c(p.strong_avg_min), c(p.strong_avg_max), c(p.gap_min))).first()
        assert tuple(row) == (p.weak_text(), p.strong_text(), p.gap_text())


def test_readiness(spark):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    probes = [("a", at(0), True), ("a", at(5), False), ("b", at(1), False), ("b", at(16), False), ("b", at(31), True), ("b", at(46), True), ("c", at(0), False), ("c", at(61), True)]
    got = {r.service: (r.probes, r.ready, r.waited) for r in J.readiness(spark.createDataFrame(probes, "service string, at timestamp, ready boolean"), 60).collect()}
    assert got == {"a": (1, True, 0.0), "b": (3, True, 30.0), "c": (1, False, 60.0)}


def test_lookups_are_counted(spark):
    rows = spark.createDataFrame([(0, k) for k in (1, 2, 3, 4, 5, 5, None)] + [(1, k) for k in (4, 5, 6, 7)], "shard int, key long")
    cache = spark.createDataFrame([(1, "{}"), (7, None)], "key long, value string")
    asked = spark.sparkContext.accumulator(0)

    def fetch(ids):
        asked.add(1)
        assert ids == sorted(ids) and len(ids) <= 2
        return [None if k == 3 else f'{{"corpusId": {k + (k == 4)}}}' for k in ids]

    answers, fresh, counters = files.counted_lookup(rows, cache, fetch, batch=2)
    assert {r.key: r.value for r in answers.collect()} == {1: "{}", 2: '{"corpusId": 2}', 3: None, 4: '{"corpusId": 5}', 5: '{"corpusId": 5}', 6: '{"corpusId": 6}', 7: None}
    assert sorted(tuple(r) for r in counters.collect()) == [(0, 1, 4, 2, 1), (1, 3, 1, 1, 0)]
    assert fresh.count() == 5 and asked.value == 3  # written once, however often it is read


PRESET = H.PROSE
GOOD = [{"error": None, "satisfied": [True, True, False]}] * 3
ZERO = [{"error": None, "satisfied": [False, False, False]}] * 3
REPORT = (
    "struct<models:map<string,string>, prompts_dir:string, config_sha1:string, weak_source:string, error:string, question_hash:string, input_sha1:string, acceptance:map<string,string>, n_attempts:int, "
    "weak_attempts:array<struct<error:string,satisfied:array<boolean>>>, strong_attempts:array<struct<error:string,satisfied:array<boolean>>>, weak_passed:boolean, strong_passed:boolean, gap_passed:boolean, all_passed:boolean>"
)
EVALS = f"paper int, round int, seq int, mode string, path string, exit_code int, inside boolean, created boolean, question_hash string, legacy_hash string, input_sha1 string, weights array<int>, report {REPORT}"


def evaluation(seq, mode="both", changes=(), call=(), source=None, weights=(3, 2, -4)):
    report = {"models": None, "prompts_dir": None, "config_sha1": None, "weak_source": source, "error": None, "question_hash": "h", "input_sha1": None, "acceptance": {"name": "prose"}, "n_attempts": 3, "weak_attempts": ZERO, "strong_attempts": GOOD, "weak_passed": True, "strong_passed": True, "gap_passed": True, "all_passed": True} | dict(changes)
    row = {"paper": 1, "round": 1, "seq": seq, "mode": mode, "path": f"p{seq}", "exit_code": 0, "inside": True, "created": True, "question_hash": "h", "legacy_hash": "l", "input_sha1": "i", "weights": list(weights) if weights else None, "report": report} | dict(call)
    return row


def test_reports_are_verified(spark):
    marks = lambda *s: {"error": None, "satisfied": list(s)}
    cases = [
        (evaluation(1, "weak-only", {"strong_attempts": [], "strong_passed": None, "gap_passed": None, "all_passed": False}), []),
        (evaluation(2, "strong-only", source="p1"), []),
        (evaluation(3, "strong-only", source="p2"), []),  # reuses one that reused
        (evaluation(4, "strong-only", source="p9"), ["weak provenance"]),
        (evaluation(5, "strong-only", source="p4"), ["weak provenance"]),  # not verified itself
        (evaluation(6, "strong-only", source="p7"), ["weak provenance"]),  # later
        (evaluation(7, changes={"question_hash": "l", "models": {"judge": "j", "weak_solver": None}, "prompts_dir": "d", "config_sha1": "c", "input_sha1": "i"}), []),
        (evaluation(8, changes={"models": {"judge": "x", "strong_solver": "y"}, "prompts_dir": "x", "config_sha1": "x"}), ["strong_solver model", "judge model", "prompts_dir", "config"]),
        (evaluation(9, call={"exit_code": None, "inside": False, "created": None}), ["path outside", "path not of this call", "exit code"]),
        (evaluation(10, changes={"error": "SOLVER_ERROR", "question_hash": None, "input_sha1": "x", "acceptance": None, "n_attempts": None}), ["evaluator error", "question_hash", "input_sha1", "acceptance", "n_attempts"]),
        (evaluation(11, changes={"weak_attempts": ZERO[:2], "strong_attempts": GOOD * 2}), ["weak attempts", "strong attempts"]),
        (evaluation(12, changes={"weak_attempts": [*ZERO[:2], marks(True, True)]}), ["recomputation"]),
        (evaluation(13, changes={"weak_attempts": [*ZERO[:2], marks(True, None, True)]}), ["recomputation"]),
        (evaluation(14, changes={"strong_attempts": [*GOOD[:2], {"error": "X", "satisfied": [True, True, False]}]}), ["recomputation"]),
        (evaluation(15, weights=None), ["recomputation"]),
        (evaluation(16, changes={"strong_attempts": ZERO}), ["verdict strong_passed", "verdict gap_passed", "verdict all_passed"]),
        (evaluation(17, changes={"strong_attempts": None, "weak_passed": False}), ["verdict weak_passed", "verdict strong_passed", "verdict gap_passed", "verdict all_passed"]),
        (evaluation(18, changes={"weak_passed": None, "strong_passed": None, "gap_passed": None, "all_passed": None}), []),
        (evaluation(19, weights=(30, 20, -4)), []),
    ]
    expected = Y.Expected({"weak_solver": "w", "strong_solver": "s", "judge": "j"}, "d", "c", {"name": "prose"})
    got = {r.seq: r for r in Y.verified(spark.createDataFrame([c for c, _ in cases], EVALS), expected, PRESET).collect()}
    for c, want in cases:
        assert list(got[c["seq"]].problems) == want and got[c["seq"]].verified == (not want), c["seq"]
    assert list(got[19].warnings) == ["weights out of bounds"] and list(got[18].warnings) == [] and got[18].all_passed and not got[16].all_passed
    assert Y.verified(spark.createDataFrame([], EVALS), expected, PRESET).count() == 0
