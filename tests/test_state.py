import threading
import time

import pytest
from pyspark.sql import functions as F

from askloom import limiter as M
from askloom.functions import extract as X
from askloom.functions import text as T
from askloom.functions.lazy import ship
from askloom.operators import runs as N
from askloom.sources import sinks
from askloom.sources.leases import Leases
from askloom.sources.versions import Conflict, Store, Versions


ship(__name__)


# ------------------------------------------------------------------------------------------------ rate limit
def flaky(request):
    k, first = int(request["request_id"]), request["attempt"] == 1
    time.sleep(0.002)
    if k % 4 == 1 and first:
        raise M.Busy(0.2)
    if k == 6:
        raise ValueError("never")
    return {"content": "" if k % 5 == 3 and first else f"a{k}", "finish_reason": "stop", "completion_tokens": 1}


def test_tasks_share_one_limit(spark):
    calls = M.limited_answers(spark.range(14).selectExpr("cast(id as string) as request_id"), flaky, 0.03, tasks=4, retries=2, backoff=lambda a: 0.01, per_turn=2)
    rows = sorted(calls.collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(len(rows))) and len({r.task for r in rows}) == 4
    for a, b in zip(rows, rows[1:]):
        assert b.started - a.ended >= a.pause - 0.001 and a.pause >= (0.2 if a.error == "Busy" else 0.03)
    by_id = {}
    for r in rows:
        by_id.setdefault(int(r.request_id), []).append(r)
    for k, tries in by_id.items():
        assert len(tries) == (2 if k % 4 == 1 or k % 5 == 3 or k == 6 else 1) and [t.is_final for t in tries] == [False] * (len(tries) - 1) + [True]
        assert tries[-1].content == (None if k == 6 else f"a{k}") and (tries[-1].error == "ValueError") == (k == 6)
    table = spark.createDataFrame(rows, calls.schema)
    assert M.spacing_kept(table, 0.001).where("NOT kept").count() == 0 and M.spacing_kept(table).count() == len(rows) - 1
    assert M.pause_left(table, now=rows[-1].ended) == pytest.approx(rows[-1].pause) and M.pause_left(table, now=rows[-1].ended + 1000) == 0
    assert M.pause_left(table.where("false")) == 0


def test_limit_with_few_requests(spark):
    assert M.limited_answers(spark.range(0).selectExpr("cast(id as string) as request_id"), flaky, 0.01, tasks=3).count() == 0
    assert M.limited_answers(spark.range(1).selectExpr("cast(id as string) as request_id"), flaky, 0.01, tasks=3).count() == 1
    began = time.time()
    M.limited_answers(spark.range(1).selectExpr("cast(id as string) as request_id"), flaky, 0.0, tasks=2, first_pause=0.5).collect()
    assert time.time() - began > 0.5
    with pytest.raises(ValueError):
        M.limited_answers(spark.range(1), flaky, -1.0)


def test_turns():
    said = lambda *due: [{"left": d is not None, "due": d or 0.0} for d in due]
    assert M.choose(said(0, 0, 0), -1) == 0 and M.choose(said(0, 0, 0), 0) == 1 and M.choose(said(0, 0, 0), 2) == 0
    assert M.choose(said(None, 3.0, -1.0), 2) == 2 and M.choose(said(None, 3.0, None), 0) == 1 and M.choose(said(None, None), 0) is None
    assert M.pause_of(M.Busy(5000), 1.0) == M.LONGEST_PAUSE and M.pause_of(None, 1.0) == 1.0 and M.pause_of(ValueError(), 2.0) == 2.0


# ------------------------------------------------------------------------------------------------ versions and leases
def test_readers_see_old_or_new(spark, tmp_path):
    log = Versions(spark, f"{tmp_path}/v")
    assert log.latest() == 0 and log.read("t", "x long").count() == 0
    one = log.commit({"t": spark.range(3).toDF("x")}, 0)
    two = log.commit({"t": spark.range(5).toDF("x"), "u": spark.range(1).toDF("y")}, one, append=False)
    three = log.commit({"t": spark.range(2).toDF("x")}, two)
    assert [log.read("t", "x long", v).count() for v in (one, two, three)] == [3, 5, 7] and log.read("t", "x long").count() == 7
    assert log.read("u", "y long", three).count() == 1 and log.read("u", "y long", one).count() == 0
    with pytest.raises(Conflict):
        log.commit({"t": spark.range(9).toDF("x")}, two)
    assert log.latest() == three


def test_text_is_replaced_in_one_step(spark, tmp_path):
    path = f"{tmp_path}/note.json"
    for text in ("one", "zwei ü", ""):
        sinks.put_text(spark, text, path)
        assert Store(spark, path).text(path) == text
    store = Store(spark, path)
    assert not store.put(path, "late", replace=False) and store.text(path) == "" and store.names(str(tmp_path)) == ["note.json"]


def keys(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "key string")


def held(frame):
    return {(r.key, r.fence) for r in frame.collect()}


def test_lease_of_a_dead_holder_is_taken_over(spark, tmp_path):
    leases = Leases(spark, f"{tmp_path}/l", "result int")
    assert held(leases.acquire(keys(spark, "a", "b", "b", None), "one", 10, now=0)) == {("a", 1), ("b", 1)}
    assert held(leases.acquire(keys(spark, "a", "c"), "two", 10, now=5)) == {("c", 1)}
    assert held(leases.heartbeat("one", 10, now=8)) == {("a", 1), ("b", 1)}  # until 18
    assert held(leases.acquire(keys(spark, "a"), "two", 10, now=17)) == set()
    assert held(leases.heartbeat("one", 10, now=18)) == set()  # ended; not revived
    assert held(leases.acquire(keys(spark, "a", "b"), "two", 10, now=18)) == {("a", 2), ("b", 2)}
    row = lambda key, fence: spark.createDataFrame([(key, fence, 7)], "key string, fence long, result int")
    accepted, refused = leases.finish(row("a", 1), "one", now=19)
    assert held(accepted) == set() and held(refused) == {("a", 1)}
    accepted, refused = leases.finish(row("a", 2), "two", now=19)
    assert held(accepted) == {("a", 2)} and held(refused) == set()
    assert held(leases.finish(row("a", 2), "two", now=19)[1]) == {("a", 2)}  # once
    assert held(leases.finish(row("b", 2), "two", now=40)[1]) == {("b", 2)}  # after its lease
    assert held(leases.acquire(keys(spark, "a", "b"), "three", 10, now=41)) == {("b", 3)}  # a is finished
    leases.release("three", now=42)
    assert held(leases.acquire(keys(spark, "b"), "four", 10, now=42)) == {("b", 4)}
    before = sorted(map(tuple, leases.current().collect()))
    leases.compact()
    assert sorted(map(tuple, leases.current().collect())) == before
    assert [(r.key, r.holder, r.fence, r.result) for r in leases.work().collect()] == [("a", "two", 2, 7)]


def test_leases_taken_at_the_same_time(spark, tmp_path):
    """Several holders at once: every key goes to one of them."""
    path, got = f"{tmp_path}/race", {}
    wanted = keys(spark, *[f"k{i}" for i in range(20)])

    def take(name):
        got[name] = held(Leases(spark, path, "result int").acquire(wanted, name, 60, now=0))

    threads = [threading.Thread(target=take, args=(f"h{i}",)) for i in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(k for s in got.values() for k in s) == sorted((f"k{i}", 1) for i in range(20))


# ------------------------------------------------------------------------------------------------ values and malformed text
def test_word_lists_as_written_out():
    english = "the of and to is for that with on are by this be from which we our these was were has have been it its an or can"
    other = "de la le les des el los las en que del da das dos para um uma não une est dans pour sur und ist mit zu nicht het een il di che della"
    assert T.ENGLISH_WORDS == english.split() and T.OTHER_WORDS == other.split()


def test_times(spark):
    rows = [("123", False, None), ("123", True, 123.0), ("2024-01-02", False, 1704153600.0), ("2024-01-02T00:00:10", False, 1704153610.0), ("2024-01-02T01:00:00+01:00", False, 1704153600.0), ("2024", False, None), ("soon", False, None), (None, False, None), ("x", True, None)]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "x string, n boolean").coalesce(1)
    assert [r.t for r in df.select(T.epoch_seconds(F.col("x"), F.col("n")).alias("t")).collect()] == [float("-inf") if c is None else c for *_, c in rows]


def test_optional_provenance(spark):
    reports = spark.createDataFrame([(1, "m", None), (2, None, "p"), (3, "x", "q")], "k int, model string, prompts string")
    expected = spark.createDataFrame([(k, "m", "p") for k in (1, 2, 3)], "k int, model string, prompts string")
    got = {r.k: r.problems for r in N.report_problems(reports, expected, "k", ["model", "prompts"], optional=["prompts"]).collect()}
    assert got == {1: [], 2: ["model"], 3: ["model", "prompts"]}


def test_malformed_candidates():
    for raw in (None, "", "{", "[]", "7", '{"context": 1}', '{"context": null, "question": null, "rubric": null}', '{"context": "c", "question": "q", "rubric": [{"criterion": "x"}]}', '{"context": "c", "question": "q", "rubric": []}', '{"context": "c", "question": "q", "rubric": [{"criterion": "x", "weight": true}]}', "[" * 100_000):
        assert X.identity(raw) is None
        X.older_identity(raw), X.lacking("prompt", raw), X.lacking(None, raw)
    assert X.identity('{"context": "c", "question": "q\\ud800", "rubric": [{"criterion": "x", "weight": " 2 "}]}') is not None
    assert X.lacking("x", '{"question": "", "rubric": [{"criterion": "", "weight": 1}, 3]}') == ["question", "criterion 1", "criterion 2"]
    assert X.lacking("Why? 13 " + "w " * 30 + "names", '{"question": "Why?", "rubric": [{"criterion": "names", "weight": 3}]}') == ["weight of criterion 1"]


def test_brace_groups_by_brute_force():
    import random

    def slow(text):
        found = set()
        for s in (i for i, c in enumerate(text) if c == "{"):
            depth, quoted, escaped = 0, False, False
            for i in range(s, len(text)):
                c = text[i]
                if quoted:
                    escaped, quoted = c == "\\" and not escaped, not (c == '"' and not escaped)
                elif c == '"':
                    quoted = True
                elif c in "{}":
                    depth += 1 if c == "{" else -1
                    if depth == 0:
                        found.add((s, i + 1))
                        break
        return found

    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice('{{}}""\\ a') for _ in range(rng.randint(0, 24)))
        assert X.groups(text) == slow(text), text
    assert X.last_object("{ " * 200_000) is None
