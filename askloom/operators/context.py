"""Fitting recorded conversations into a model's context: which old parts go, in which order, until the rest fits.

messages: conv, at (orders a conversation), role, content (characters), think (characters of the reasoning, null where a message has
none), other (characters of tool calls). Both operators are greedy in a fixed order, which makes them prefix sums: a part goes if what
is left before it is still too much. So a conversation is no loop and no list: its parts are rows, ranked and summed by
``ordered.running``, and one conversation may be as long as the table.

Defined cases: a null conv is a conversation; negative or null sizes count as 0; a conversation that fits is left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running

# The notes that stand for a tool result; %d is its length.
SOFT_NOTE = "[tool result elided by the harness to fit the context window: %d chars; the full text is in the transcript]"
HARD_NOTE = "[tool result elided; full text in transcript]"
#: A quarter of a token a character; the least completion that a lowered allowance may leave.
CHARS_A_TOKEN, LEAST_COMPLETION = 4, 8192
#: The last messages of a conversation that the hard limit never touches.
TAIL = 2


def soft_note(chars: Column) -> Column:
    return F.replace(F.lit(SOFT_NOTE), F.lit("%d"), chars.cast("string"))


def ranked(messages: DataFrame, keep: int) -> DataFrame:
    """Adds i (place from 0), n, total and old: whether a tool result or a turn is not among the last ``keep`` of its kind."""
    size = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)).cast("long"), F.lit(0))
    rows = messages.select("conv", "at", "role", size("content").alias("content"), F.when(F.col("think").isNotNull(), size("think")).alias("think"), size("other").alias("other"))
    rows = rows.withColumn("chars", F.col("content") + F.coalesce("think", F.lit(0)) + F.col("other"))
    is_tool, is_turn = (F.col("role").eqNullSafe(r).cast("long") for r in ("tool", "assistant"))
    rows = running(rows, ["conv"], ["at"], {"i": ("sum", F.lit(1).cast("long")), "nth_tool": ("sum", is_tool), "nth_turn": ("sum", is_turn)})
    whole = rows.groupBy(F.col("conv").alias("w")).agg(F.max("i").alias("n"), F.sum("chars").alias("total"), F.max("nth_tool").alias("tools"), F.max("nth_turn").alias("turns"))
    met = rows.join(whole, F.col("conv").eqNullSafe(F.col("w"))).drop("w")
    old = F.when(is_tool == 1, F.col("nth_tool") <= F.col("tools") - keep).when(is_turn == 1, F.col("nth_turn") <= F.col("turns") - keep).otherwise(False)
    return met.withColumn("i", F.col("i") - 1).withColumn("old", old)


def tokens(total: Column, billed_tokens: Column | None, billed_chars: Column | None, schema_chars: int = 0) -> Column:
    """Prompt tokens: the last billed prompt and a quarter of what came since, or a quarter of all."""
    plain = (total + schema_chars) / CHARS_A_TOKEN
    if billed_tokens is None:
        return plain
    return F.when(billed_tokens.isNull(), plain).otherwise(F.greatest(F.lit(0.0), billed_tokens + (total - billed_chars) / CHARS_A_TOKEN))


def applied(messages: DataFrame, parts: DataFrame, goes: Column) -> DataFrame:
    """Every message with action, phase and chars_after, by the parts (conv, i, phase, action, saves) for which ``goes`` holds."""
    gone = parts.where(goes).select(F.col("conv").alias("g_conv"), F.col("i").alias("g_i"), "action", "phase", "saves")
    met = messages.join(gone, F.col("conv").eqNullSafe(F.col("g_conv")) & (F.col("i") == F.col("g_i")), "left")
    return met.select("conv", "at", "i", "role", "chars", "action", "phase", (F.col("chars") - F.coalesce("saves", F.lit(0))).alias("chars_after"))


def fitted(messages: DataFrame, keep: int, budget_chars: int | None = None, budget_tokens: int | None = None, billed: DataFrame | None = None) -> DataFrame:
    """The soft budget: reasoning of old turns goes first, oldest first, then old tool results, each replaced by a note of its own length.

    One row per message: conv, at, i, role, chars, action (drop_reasoning, elide_result or null), phase (of the action), chars_after. A short result grows by
    its note, as the note is set whenever the turn comes to it. billed: conv, billed_tokens, billed_chars (at most one row each).
    """
    rows = with_billed(ranked(messages, keep), billed)
    drop = (F.col("role") == "assistant") & F.col("old") & F.col("think").isNotNull()
    elide = (F.col("role") == "tool") & F.col("old")
    parts = rows.where(drop | elide).select("conv", "i", "total", "billed_tokens", "billed_chars", F.when(drop, 1).otherwise(2).alias("phase"), F.when(drop, "drop_reasoning").otherwise("elide_result").alias("action"), F.when(drop, F.col("think")).otherwise(F.col("content") - F.char_length(soft_note(F.col("content")))).alias("saves"))
    saved = running(parts, ["conv"], ["phase", "i"], {"saved": ("sum", F.col("saves"))}).withColumn("before", F.col("saved") - F.col("saves"))
    # Savings may be negative, so what is left is not monotone: once it fitted, nothing more goes.
    most = running(saved, ["conv"], ["phase", "i"], {"most": ("max", F.col("before"))})
    left = F.col("total") - F.col("most")
    goes = left > budget_chars if budget_tokens is None else tokens(left, F.col("billed_tokens"), F.col("billed_chars")) > budget_tokens
    return applied(rows, most, goes)


def with_billed(rows: DataFrame, billed: DataFrame | None) -> DataFrame:
    if billed is None:
        return rows.withColumns({"billed_tokens": F.lit(None).cast("long"), "billed_chars": F.lit(None).cast("long")})
    b = billed.select(F.col("conv").alias("b"), "billed_tokens", "billed_chars")
    return rows.join(b, F.col("conv").eqNullSafe(F.col("b")), "left").drop("b")


def preflight(messages: DataFrame, keep: int, max_model_len: int, max_tokens: int, budget_chars: int | None = None, budget_tokens: int | None = None, billed: DataFrame | None = None, schema_chars: int = 0, least: int = LEAST_COMPLETION) -> tuple[DataFrame, DataFrame]:
    """The hard limit, prompt and completion together: (messages as in :func:`fitted`, conversations).

    Old tool results go first (unless the note is no shorter), then reasoning of old turns, both until the limit and the soft budget
    hold; then the protected window shrinks from its old end, message by message, until the limit holds or the last two are reached.
    Conversations: conv, estimate (prompt tokens left), status (fits, lowered, exceeded) and max_tokens: what the completion may
    still have, if that is ``least`` or more.
    """
    rows = with_billed(ranked(messages, keep), billed)
    shorter = F.col("content") - len(HARD_NOTE)
    elide, drop = (F.col("role") == "tool") & (shorter > 0), (F.col("role") == "assistant") & F.col("think").isNotNull()
    inside = ~F.col("old") & (F.col("i") < F.col("n") - TAIL)
    phase = F.when(elide & F.col("old"), 1).when(drop & F.col("old"), 2).when((elide | drop) & inside, 3)
    parts = rows.withColumn("phase", phase).where("phase IS NOT NULL").select("conv", "i", "total", "billed_tokens", "billed_chars", "phase", F.when(elide, "elide_result").otherwise("drop_reasoning").alias("action"), F.when(elide, shorter).otherwise(F.col("think")).alias("saves"))
    saved = running(parts, ["conv"], ["phase", "i"], {"saved": ("sum", F.col("saves"))})

    def estimate(left: Column) -> Column:
        return tokens(left, F.col("billed_tokens"), F.col("billed_chars"), schema_chars)

    def fits(left: Column) -> Column:
        return estimate(left) + max_tokens <= max_model_len

    def soft(left: Column) -> Column:
        if budget_tokens is not None:
            return estimate(left) <= budget_tokens
        return F.lit(True) if budget_chars is None else left <= budget_chars

    left = F.col("total") - F.col("saved") + F.col("saves")
    goes = F.when(F.col("phase") < 3, ~(fits(left) & soft(left))).otherwise(~fits(left))
    done = applied(rows, saved, goes)
    ends = saved.where(goes).groupBy(F.col("conv").alias("g")).agg(F.sum("saves").alias("gone"))
    convs = rows.groupBy("conv").agg(*[F.first(c).alias(c) for c in ("total", "billed_tokens", "billed_chars")])
    rest = convs.join(ends, F.col("conv").eqNullSafe(F.col("g")), "left").withColumn("rest", F.col("total") - F.coalesce("gone", F.lit(0)))
    room = F.floor(max_model_len - estimate(F.col("rest")))
    status = F.when(fits(F.col("rest")), "fits").when(room >= least, "lowered").otherwise("exceeded")
    allowed = F.when(fits(F.col("rest")), F.lit(max_tokens)).when(room >= least, F.least(F.lit(max_tokens), room)).cast("long")
    return done, rest.select("conv", estimate(F.col("rest")).cast("double").alias("estimate"), status.alias("status"), allowed.alias("max_tokens"))
