"""Rounds of the generate, verify, evaluate loop: failure modes, pairing of evaluations, refinement lists, elision windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.extract import unbound_parts


def failure_mode(accepted: Column, qv_passed: Column, weak_passed: Column, strong_all_passed: Column, n_evals: Column) -> Column:
    """Why a round ended. Only an explicit false counts; an unknown never does."""
    no = lambda c: c.eqNullSafe(False)
    return (
        F.when(F.coalesce(accepted, F.lit(False)), "ACCEPTED")
        .when(no(qv_passed), "FAILED_QV")
        .when(no(weak_passed), "TOO_EASY")
        .when(no(strong_all_passed), "FAILED_ON_STRONG")
        .when(qv_passed.isNull() & (n_evals == 0), "NO_QV")
        .otherwise("NO_EVAL")
    )


def until_accepted(rounds: DataFrame) -> DataFrame:
    """rounds: paper, round, passes -> the rounds up to the first that passes, with ``accepted``."""
    first = F.min(F.when(F.col("passes"), F.col("round"))).over(Window.partitionBy("paper"))
    rows = rounds.withColumn("accepted_round", first).where(F.col("accepted_round").isNull() | (F.col("round") <= F.col("accepted_round")))
    return rows.withColumn("accepted", F.col("round").eqNullSafe(F.col("accepted_round")))


def failure_shares(modes: DataFrame, order: list[Column]) -> DataFrame:
    """mode, n and share of the rounds that were not accepted, most frequent first by count then first appearance."""
    failed = modes.where("failure_mode <> 'ACCEPTED'").groupBy("failure_mode").agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    # A handful of modes: the total is summed over the grouped rows.
    whole = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return failed.withColumn("share", F.col("n") / F.sum("n").over(whole))


def paired_evaluations(evals: DataFrame) -> DataFrame:
    """evals: paper, round, seq, mode, question_hash, has_report -> per round the last strong evaluation and the weak one that goes with it.

    The weak one is the last of the same question; without one, the last weak one of the round. strong-only and weak-only
    evaluations come before combined ones of the same kind.
    """
    e = evals.where("has_report")
    pick = lambda cond, rank: F.max_by(F.struct("seq", "mode", "question_hash"), F.when(cond, rank))
    own = lambda mode: F.struct((F.col("mode") == mode).alias("own"), F.col("seq").alias("at"))
    strong = e.groupBy("paper", "round").agg(pick(F.col("mode").isin("strong-only", "both"), own("strong-only")).alias("strong"))
    weak = F.col("mode").isin("weak-only", "both")
    same = F.col("question_hash") == F.col("strong.question_hash")
    joined = e.join(strong, ["paper", "round"])
    return joined.groupBy("paper", "round").agg(
        F.first("strong").alias("strong"),
        F.coalesce(pick(weak & same, F.struct(F.lit(True).alias("own"), F.col("seq").alias("at"))), pick(weak, own("weak-only"))).alias("weak"),
    )


def acceptance_event(evals: DataFrame) -> DataFrame:
    """evals: paper, round, seq, verified, all_passed, qv_passed -> the first evaluation of a paper that accepts it."""
    fine = F.col("verified") & F.col("all_passed") & F.coalesce("qv_passed", F.lit(False))
    return evals.where(fine).groupBy("paper").agg(F.min_by(F.struct("round", "seq"), F.struct("round", "seq")).alias("x")).select("paper", "x.round", "x.seq")


def final_gate(overall: Column, completed: Column, context_ok: Column, rubric_ok: Column) -> Column:
    return F.coalesce(overall & completed & context_ok & rubric_ok, F.lit(False))


REFINEMENTS = {"TOO_EASY": "too_easy", "FAILED_ON_STRONG": "failed_strong", "FAILED_QV": "failed_qv"}


def refinement_lists(rounds: DataFrame) -> DataFrame:
    """rounds: paper, round, failure_mode, question -> per paper the failed questions by group, in round order; null for an empty group."""
    q = rounds.where(F.col("failure_mode").isin(*REFINEMENTS))
    listed = lambda mode: F.array_sort(F.collect_list(F.when(F.col("failure_mode") == mode, F.struct("round", "question"))))
    g = q.groupBy("paper").agg(*[listed(m).alias(n) for m, n in REFINEMENTS.items()])
    text = lambda n: F.nullif(F.array_join(F.transform(n, lambda x: F.concat(F.lit("- "), x["question"])), "\n"), F.lit(""))
    return g.select("paper", *[text(n).alias(n) for n in REFINEMENTS.values()])


def last_of_kind(events: DataFrame, value: str, kind: str) -> DataFrame:
    """The latest value of a kind that is not null, per paper and round."""
    return events.where((F.col("kind") == kind) & F.col(value).isNotNull()).groupBy("paper", "round").agg(F.max_by(value, "seq").alias(value))


def elided(messages: DataFrame, conv: str, order: str, role: str, chars: Column, keep: int, budget: int, eligible_role: str = "tool", replacement: int = 50) -> DataFrame:
    """Which old messages of a role are replaced so that a conversation fits its budget; the last ``keep`` of the role stay.

    Oldest first, until the running total is within the budget. Adds total_chars, elided and chars_after.
    """
    all_rows = Window.partitionBy(conv)
    rows = messages.withColumn("chars", chars).withColumn("total_chars", F.sum("chars").over(all_rows))
    own = F.col(role) == eligible_role
    newer = F.count_if(own).over(Window.partitionBy(conv).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("can", own & (newer > keep)).withColumn("saves", F.when(F.col("can"), F.greatest(F.col("chars") - replacement, F.lit(0))).otherwise(0))
    before = F.coalesce(F.sum("saves").over(Window.partitionBy(conv).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("elided", F.col("can") & (F.col("saves") > 0) & (F.col("total_chars") - before > budget))
    return rows.withColumn("chars_after", F.when(F.col("elided"), F.col("chars") - F.col("saves")).otherwise(F.col("chars"))).drop("can", "saves")


def prompt_estimate(messages: DataFrame, conv: str, order: str, chars: Column, billed: Column) -> DataFrame:
    """Estimated prompt size before each message: the last billed tokens plus a quarter of the characters added since."""
    w = Window.partitionBy(conv).orderBy(order)
    so_far = F.sum(chars).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = messages.withColumn("so_far", F.coalesce(so_far, F.lit(0))).withColumn("mark", F.when(billed.isNotNull(), F.struct(billed.alias("tokens"), F.col("so_far").alias("chars"))))
    last = F.last("mark", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("last", last)
    estimate = F.when(F.col("last").isNull(), F.col("so_far") / 4.0).otherwise(F.greatest(F.lit(0.0), F.col("last.tokens") + (F.col("so_far") - F.col("last.chars")) / 4.0))
    return rows.withColumn("prompt_tokens", estimate).drop("so_far", "mark", "last")


def agent_outcomes(turns: DataFrame, max_steps: int) -> DataFrame:
    """How recorded agents ended, replayed within a budget of steps: one row per agent with stop_reason, steps_used, final_text, tokens.

    turns: agent, step (from 1), n_calls, finish_reason, error, content, tokens. An agent ends at its first failed request ('error'),
    or its first answer without a tool call ('length' if that was cut off, else 'final'), or when its steps are used up ('max_steps').
    """
    ends = F.col("error").isNotNull() | (F.col("n_calls") == 0)
    last = F.min(F.when(ends, F.col("step"))).over(Window.partitionBy("agent"))
    rows = turns.where(F.col("step") <= max_steps).withColumn("end", last).where(F.col("end").isNull() | (F.col("step") <= F.col("end")))
    at = lambda c: F.max_by(c, "step")
    reason = F.when(at(F.col("error").isNotNull()), "error").when(at(F.col("n_calls")) > 0, "max_steps").when(at(F.coalesce(F.col("finish_reason") == "length", F.lit(False))), "length").otherwise("final")
    text = F.max_by(F.coalesce("content", F.lit("")), F.when(F.col("error").isNull(), F.col("step")))
    return rows.groupBy("agent").agg(reason.alias("stop_reason"), F.max("step").alias("steps_used"), F.coalesce(text, F.lit("")).alias("final_text"), F.sum(F.when(F.col("error").isNull(), F.coalesce("tokens", F.lit(0))).otherwise(0)).alias("tokens"))


# The fields of a round's record and of a paper's, in their order.
ROUND_FIELDS = (
    "index failure_mode qv_passed qv_bound qv_missing qv_contradiction n_qv_calls n_eval_calls eval_verified eval_problems eval_warnings weak_avg weak_scores strong_avg strong_scores gap "
    "weak_passed strong_passed gap_passed question_type reasoning_skills question context reference_answer rubric n_rubric_items question_chars challenger_parsed qv_feedback started_at"
).split()
PAPER_FIELDS = (
    "paper_id title meta accepted accepted_round final_qv final_accepted n_rounds rounds agent_stop_reason agent_steps_used agent_error agent_result_json_present agent_claimed_accepted_round "
    "agent_claim_matches_harness guardrail_events usage n_eval_calls errors completed wall_time_s acceptance_preset config_name config_fingerprint harness_version finished_at"
).split()
#: What of a question tells whether a reference answer belongs to it.
SAME_QUESTION = 120


def last_where(items: Column, cond) -> Column:
    """The last element that meets the condition, or null."""
    return F.try_element_at(F.filter(items, cond), F.lit(-1))


def round_rows(rounds: DataFrame) -> DataFrame:
    """One row per round with ROUND_FIELDS, folded within the round's own arrays; paper and ROUND_FIELDS.

    rounds: paper, index, started_at; challenger (struct question, context, rubric, reference_answer, question_type, reasoning_skills;
    null if it could not be parsed); qv_calls (array of struct prompt, overall, contradiction, feedback) and evals (array of struct
    mode, has_report, question_hash, verified, problems, warnings, candidate, verdict) in their order; accepted (struct index,
    candidate, reference_answer, verdict; null, or the same for all rounds of a paper). Rubrics are arrays of struct criterion,
    weight, category; verdicts structs of weak_avg, weak_scores, weak_passed, strong_avg, strong_scores, strong_passed, gap,
    gap_passed, all_passed. In the accepted round everything comes from what was frozen, never from a later evaluation.
    """
    kind = lambda mode: last_where(F.col("evals"), lambda e: e["has_report"] & (e["mode"] == mode))
    rows = rounds.withColumn("strong_ev", F.coalesce(kind("strong-only"), kind("both")))
    same = last_where(F.col("evals"), lambda e: e["has_report"] & e["mode"].isin("weak-only", "both") & e["question_hash"].eqNullSafe(F.col("strong_ev.question_hash")))
    rows = rows.withColumn("weak_ev", F.coalesce(F.when(F.col("strong_ev").isNotNull(), same), kind("weak-only"), kind("both")))
    won = F.col("accepted").isNotNull() & (F.col("accepted.index") == F.col("index"))
    evaluated = last_where(F.col("evals"), lambda e: e["candidate"].isNotNull())["candidate"]
    rows = rows.withColumns({
        "won": F.coalesce(won, F.lit(False)),
        "cand": F.when(won, F.col("accepted.candidate")).otherwise(evaluated),
        "weak": F.when(won, F.col("accepted.verdict")).otherwise(F.col("weak_ev.verdict")),
        "strong": F.when(won, F.col("accepted.verdict")).otherwise(F.col("strong_ev.verdict")),
        "any_ev": F.coalesce("strong_ev", "weak_ev"),
        "qv": F.try_element_at("qv_calls", F.lit(-1)),
        "none": F.array().cast("array<string>"),
    })
    either = lambda f: F.coalesce(F.nullif(F.col(f"cand.{f}"), F.lit("")), F.col(f"challenger.{f}"))
    start = lambda c: F.substring(T.squash(F.coalesce(F.col(c), F.lit(""))), 1, SAME_QUESTION)
    rubric = F.when(F.size(F.coalesce("cand.rubric", F.array())) > 0, F.col("cand.rubric")).otherwise(F.col("challenger.rubric"))
    rows = rows.withColumns({"question": either("question"), "context": either("context"), "rubric": rubric, "question_type": either("question_type")})
    answer = F.when(F.col("won"), F.col("accepted.reference_answer")).when(start("challenger.question") == start("cand.question"), F.col("challenger.reference_answer"))
    shown = F.to_json(F.struct("question", "context", "rubric"))
    rows = rows.withColumn("qv_missing", unbound_parts(F.coalesce("qv.prompt", F.lit("")), shown))
    calls = F.size(F.coalesce("evals", F.array()))
    # Only an explicit false counts; a strong stage that was never reached says nothing.
    mode = failure_mode(F.col("won"), F.col("qv.overall"), F.col("weak.weak_passed"), F.col("strong.all_passed"), calls)
    return rows.select(
        "paper",
        "index",
        mode.alias("failure_mode"),
        F.col("qv.overall").alias("qv_passed"),
        (F.col("qv").isNotNull() & (F.size("qv_missing") == 0)).alias("qv_bound"),
        "qv_missing",
        F.coalesce("qv.contradiction", F.lit(False)).alias("qv_contradiction"),
        F.size(F.coalesce("qv_calls", F.array())).alias("n_qv_calls"),
        calls.alias("n_eval_calls"),
        F.coalesce("any_ev.verified", F.lit(False)).alias("eval_verified"),
        F.coalesce("any_ev.problems", "none").alias("eval_problems"),
        F.coalesce("any_ev.warnings", "none").alias("eval_warnings"),
        *[F.col(f"weak.{c}").alias(c) for c in ("weak_avg", "weak_scores")],
        *[F.col(f"strong.{c}").alias(c) for c in ("strong_avg", "strong_scores", "gap")],
        F.col("weak.weak_passed").alias("weak_passed"),
        *[F.col(f"strong.{c}").alias(c) for c in ("strong_passed", "gap_passed")],
        "question_type",
        F.col("challenger.reasoning_skills").alias("reasoning_skills"),
        "question",
        "context",
        answer.alias("reference_answer"),
        "rubric",
        F.when(F.col("rubric").isNotNull(), F.size("rubric")).alias("n_rubric_items"),
        F.char_length("question").alias("question_chars"),
        F.col("challenger").isNotNull().alias("challenger_parsed"),
        F.col("qv.feedback").alias("qv_feedback"),
        "started_at",
    )


def paper_rows(papers: DataFrame, rounds: DataFrame) -> DataFrame:
    """One row per paper with PAPER_FIELDS: its rounds (of :func:`round_rows`) in order, the agent's end, its claim, usage.

    papers: paper, title, meta, accepted_round, final_qv (struct passed and more; null if there was none), stop_reason (null: it
    crashed), steps_used, agent_error, claim (struct present, round), guardrail_events, main_usage, subagent_usage (maps), errors,
    wall_time_s, acceptance_preset, config_name, config_fingerprint, harness_version, finished_at. A paper has a few rounds.
    """
    listed = rounds.groupBy(F.col("paper").alias("r_paper")).agg(F.array_sort(F.collect_list(F.struct(*ROUND_FIELDS))).alias("rounds"))
    rows = papers.join(listed, F.col("paper") == F.col("r_paper"), "left")
    present, accepted = F.coalesce("claim.present", F.lit(False)), F.col("accepted_round").isNotNull()
    end = F.coalesce("stop_reason", F.lit("crashed"))
    made = F.aggregate(F.coalesce(F.col("rounds")["n_eval_calls"], F.array().cast("array<int>")), F.lit(0).cast("long"), lambda a, n: a + n)
    return rows.select(
        F.col("paper").alias("paper_id"),
        "title",
        "meta",
        accepted.alias("accepted"),
        "accepted_round",
        "final_qv",
        (accepted & (F.col("final_qv").isNull() | F.coalesce("final_qv.passed", F.lit(False)))).alias("final_accepted"),
        F.size(F.coalesce("rounds", F.array())).alias("n_rounds"),
        "rounds",
        end.alias("agent_stop_reason"),
        F.col("steps_used").alias("agent_steps_used"),
        "agent_error",
        present.alias("agent_result_json_present"),
        F.when(present, F.col("claim.round")).alias("agent_claimed_accepted_round"),
        F.when(present, F.col("claim.round").eqNullSafe(F.col("accepted_round"))).alias("agent_claim_matches_harness"),
        "guardrail_events",
        F.struct(F.col("main_usage").alias("main_agent"), F.col("subagent_usage").alias("subagents")).alias("usage"),
        made.alias("n_eval_calls"),
        "errors",
        end.isin("final", "max_steps", "length").alias("completed"),
        "wall_time_s",
        "acceptance_preset",
        "config_name",
        "config_fingerprint",
        "harness_version",
        "finished_at",
    )
