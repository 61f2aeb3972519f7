"""Whole round and paper records, and what the report takes from them."""

import pytest
from pyspark.sql import functions as F

from askloom.operators import rounds as R
from askloom.operators import stats as S

RUBRIC = "array<struct<criterion:string,weight:int,category:string>>"
CAND = f"struct<question:string,context:string,rubric:{RUBRIC},question_type:string>"
VERDICT = "struct<weak_avg:double,weak_scores:array<double>,weak_passed:boolean,strong_avg:double,strong_scores:array<double>,strong_passed:boolean,gap:double,gap_passed:boolean,all_passed:boolean>"
SCHEMA = (
    f"paper string, index int, started_at double, challenger struct<question:string,context:string,rubric:{RUBRIC},reference_answer:string,question_type:string,reasoning_skills:array<string>>, "
    f"qv_calls array<struct<prompt:string,overall:boolean,contradiction:boolean,feedback:string>>, "
    f"evals array<struct<mode:string,has_report:boolean,question_hash:string,verified:boolean,problems:array<string>,warnings:array<string>,candidate:{CAND},verdict:{VERDICT}>>, "
    f"accepted struct<index:int,candidate:{CAND},reference_answer:string,verdict:{VERDICT}>"
)
ITEMS = [("names it", 7, "positive"), ("guesses", -2, "negative")]
PROMPT = "Why? ctx 7 names it, -2 guesses"


def verdict(weak, strong, weak_passed=True, all_passed=True):
    return (weak, [weak], weak_passed, strong, [strong], all_passed, strong - weak, all_passed, all_passed)


def ev(mode, h, v, verified=True, report=True, candidate=True, question="Why?"):
    return (mode, report, h, verified, ["p"] if not verified else [], ["w"], (question, "ctx", ITEMS, "how") if candidate else None, v)


CHALLENGER = ("Why?", "ctx", ITEMS, "because", "what", ["skill"])
FROZEN = (3, ("Frozen?", "fctx", ITEMS[:1], "fq"), "fref", verdict(0.1, 0.9))


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        # The weak run of the strong one's question counts, also if it is not the last.
        ("a", 1, 1.0, CHALLENGER, [("x", True, False, "f1"), (PROMPT, True, True, "f2")], [ev("weak-only", "h", verdict(0.2, 0.0)), ev("weak-only", "g", verdict(0.3, 0.0)), ev("strong-only", "h", verdict(0.0, 0.6, all_passed=False), verified=False)], FROZEN),
        # No verification, no evaluation; the challenger could not be read.
        ("a", 2, 2.0, None, None, None, FROZEN),
        # Accepted: what was frozen, whatever came later.
        ("a", 3, 3.0, CHALLENGER, [(PROMPT, True, False, None)], [ev("both", "h", verdict(0.1, 0.9)), ev("both", "z", verdict(0.8, 0.8, False, False), question="Later?")], FROZEN),
        ("b", 1, 1.0, CHALLENGER, [("nothing", False, False, None)], [ev("weak-only", "h", verdict(0.9, 0.0, False))], None),
        ("b", 2, 1.0, CHALLENGER, [(PROMPT, None, False, None)], [ev("both", "h", verdict(0.9, 0.9, False, False), report=False), ev("weak-only", "h", verdict(0.7, 0.0, False), question="Another?")], None),
        ("b", 3, 1.0, CHALLENGER, [(PROMPT, True, False, None)], [], None),
    ]
    return R.round_rows(spark.createDataFrame(data, SCHEMA))


def test_round_records(rows):
    assert rows.columns == ["paper", *R.ROUND_FIELDS]
    got = {(r.paper, r["index"]): r for r in rows.collect()}
    one = got["a", 1]
    assert (one.failure_mode, one.weak_avg, one.strong_avg, one.eval_verified, list(one.eval_problems), one.n_qv_calls, one.n_eval_calls) == ("FAILED_ON_STRONG", 0.2, 0.6, False, ["p"], 2, 3)
    assert (one.qv_passed, one.qv_bound, one.qv_contradiction, one.qv_feedback, one.reference_answer, one.question_type, list(one.reasoning_skills)) == (True, True, True, "f2", "because", "how", ["skill"])
    none = got["a", 2]
    assert (none.failure_mode, none.question, none.n_rubric_items, none.question_chars, none.challenger_parsed, none.qv_bound, none.qv_passed, none.eval_verified) == ("NO_QV", None, None, None, False, False, None, False)
    won = got["a", 3]
    assert (won.failure_mode, won.question, won.context, won.reference_answer, won.weak_avg, won.strong_avg, won.n_rubric_items, won.question_chars) == ("ACCEPTED", "Frozen?", "fctx", "fref", 0.1, 0.9, 1, 7)
    assert list(won.qv_missing) == ["question", "context head"]
    assert got["b", 1].failure_mode == "FAILED_QV" and list(got["b", 1].qv_missing) == ["question", "context head", "criterion 1", "criterion 2"]
    easy = got["b", 2]
    assert (easy.failure_mode, easy.weak_avg, easy.strong_avg, easy.question, easy.reference_answer, easy.n_eval_calls) == ("TOO_EASY", 0.7, None, "Another?", None, 2)
    assert (got["b", 3].failure_mode, got["b", 3].question, got["b", 3].n_eval_calls) == ("NO_EVAL", "Why?", 0)


PAPERS = (
    "paper string, title string, meta map<string,string>, accepted_round int, final_qv struct<passed:boolean>, stop_reason string, steps_used int, agent_error string, claim struct<present:boolean,round:int>, guardrail_events array<string>, "
    "main_usage map<string,long>, subagent_usage map<string,long>, errors array<string>, wall_time_s double, acceptance_preset string, config_name string, config_fingerprint string, harness_version string, finished_at string"
)


def test_paper_records_and_items(spark, rows):
    rest = ([], {"prompt_tokens": 5}, {}, [], 9.5, "prose", "cfg", "fp", "1", "2024-01-01")
    data = [
        ("a", "A", {}, 3, (False,), "final", 4, None, (True, 2), *rest),
        ("b", "B", None, None, None, None, None, "boom", (False, 1), *rest),
        ("c", "C", {}, 1, None, "error", 1, None, None, *rest),
        ("d", "D", {}, None, None, "max_steps", 1, None, (True, None), *rest),
    ]
    papers = R.paper_rows(spark.createDataFrame(data, PAPERS), rows)
    assert papers.columns == R.PAPER_FIELDS
    got = {r.paper_id: r for r in papers.collect()}
    a, b, c, d = (got[k] for k in "abcd")
    assert (a.accepted, a.final_accepted, a.n_rounds, a.n_eval_calls, a.agent_claimed_accepted_round, a.agent_claim_matches_harness, a.completed) == (True, False, 3, 5, 2, False, True)
    assert [r["index"] for r in a.rounds] == [1, 2, 3] and a.usage.main_agent == {"prompt_tokens": 5}
    assert (b.accepted, b.agent_stop_reason, b.completed, b.agent_claim_matches_harness, b.agent_result_json_present, b.agent_claimed_accepted_round) == (False, "crashed", False, None, False, None)
    assert (c.final_accepted, c.n_rounds, c.completed) == (True, 0, False) and (d.agent_claim_matches_harness, d.completed) == (True, True)
    reports = spark.createDataFrame([("a", 0.3, 0.8, 0.5, "report", "r1"), ("c", 0.0, 0.0, 0.0, "summary", None)], "paper string, weak_avg double, strong_avg double, gap double, scores_source string, scores_report string")
    items = {r.paper: r for r in S.accepted_items(papers, reports).collect()}
    assert (items["a"].weak_avg, items["a"].scores_source, items["a"].scores_report, items["a"].qv_bound, items["a"].n_rubric_items) == (0.3, "report", "r1", False, 1)
    assert (items["c"].weak_avg, items["c"].scores_source) == (None, "summary") and set(items) == {"a", "c"}
    assert {r.paper: r.weak_avg for r in S.accepted_items(papers).collect()} == {"a": 0.1, "c": None}


def test_report_with_and_without_new_columns(spark):
    runs = spark.createDataFrame([(1, True, True, "s", True, None, None, 1, 2, 0.2, 0.8, 0.6, 2, 30, 4, 3), (2, False, False, None, None, ["e"], ["g", "h"], 3, None, None, None, None, None, None, None, 1)], "paper long, accepted boolean, final_accepted boolean, stop_reason string, claim_matches boolean, errors array<string>, guardrails array<string>, prompt_tokens long, completion_tokens long, weak_avg double, strong_avg double, gap double, accepted_round int, question_chars int, n_rubric_items int, n_rounds int")
    rounds = spark.createDataFrame([(1, "TOO_EASY"), (1, "ACCEPTED")], "paper long, failure_mode string")
    old = {(r.section, r["name"]): r.value for r in S.agentic_report(runs, rounds).collect()}
    assert (old["backing", "report_backed"], old["backing", "summary_backed"], old["backing", "qv_unbound"], old["tokens", "subagents_prompt"], old["time", "wall_time_mean_s"]) == (0, 1, 0, 0, None)
    more = runs.withColumns({"qv_bound": F.lit(False), "scores_source": F.lit("report"), "subagent_prompt_tokens": F.lit(7), "subagent_completion_tokens": F.lit(1), "wall_time_s": F.col("paper") * 2.0})
    new = {(r.section, r["name"]): r.value for r in S.agentic_report(more, rounds).collect()}
    assert (new["backing", "report_backed"], new["backing", "qv_unbound"], new["tokens", "subagents_prompt"], new["time", "wall_time_mean_s"], new["accepted", "gap"], new["checks", "guardrail_events"]) == (1, 1, 14, 3.0, 0.6, 2)
