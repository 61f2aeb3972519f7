"""One rate limit for all tasks of a job: calls in turn, none overlapping, a pause from the end of one to the start of the next.

Tasks run as one barrier stage and pass the turn among them by ``allGather``: each round every task says whether it has a request and
when it may try again, all choose the same task, that one waits out the pause, makes some calls, and tells all how long the next
pause is. A service's demand to wait is such a pause, so it holds for all tasks. No clock is shared: the pause runs after the round in
which the call's end was told, on the clock of the task that waits. A round takes about a second, so a turn is ``per_turn`` calls,
unless the task would only wait to try again while others have requests.

Use few tasks: the limit, not their number, bounds the rate. A barrier stage needs a slot for each task at the same time, and if one
task is lost the whole stage runs again, so calls are made at least once.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.lazy import ship
from .responder import delay

SCHEMA = "request_id string, attempt int, content string, finish_reason string, completion_tokens long, error string, is_final boolean, task int, slot long, started double, ended double, pause double"
#: A demand to wait is honoured up to so many seconds.
LONGEST_PAUSE = 900.0


class Busy(Exception):
    """A service asks all callers to wait."""

    def __init__(self, seconds: float):
        super().__init__(f"wait {seconds} s")
        self.seconds = seconds

    def __reduce__(self):
        return Busy, (self.seconds,)


def pause_of(error: Exception | None, spacing: float) -> float:
    """The pause after a call: the spacing, or what the service asked for, if that is longer."""
    return max(spacing, min(LONGEST_PAUSE, float(getattr(error, "seconds", 0.0) or 0.0)))


def choose(said: list[dict], last: int) -> int | None:
    """The task whose turn it is: the one that may call soonest, of equal ones the next after ``last``."""
    n = len(said)
    waiting = [(max(0.0, said[k]["due"]), (k - last - 1) % n, k) for k in range(n) if said[k]["left"]]
    return min(waiting)[2] if waiting else None


def limited_answers(requests: DataFrame, respond: Callable[[dict], dict], spacing: float, tasks: int = 4, retries: int = 3, first_pause: float = 0.0, backoff: Callable[[int], float] = delay, per_turn: int = 32) -> DataFrame:
    """requests: request_id and whatever ``respond`` reads (it also gets ``attempt``) -> all tries, with task, slot (the call's number),
    started, ended and the pause after it. A failed try is made again after ``backoff(attempt)`` seconds, while others may call."""
    if spacing < 0 or tasks < 1:
        raise ValueError("spacing must not be negative, and there must be a task")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        me, turn, slot, pause = context.partitionId(), -1, 0, first_pause
        queue = (r for b in batches for r in b.to_dict("records"))
        request, attempt, ready, out = next(queue, None), 1, 0.0, []

        def gather(**more) -> list[dict]:
            said = {"left": request is not None, "due": ready - time.monotonic(), **more}
            return [json.loads(x) for x in context.allGather(json.dumps(said))]

        said = gather()
        while (turn := choose(said, turn)) is not None:
            more, made = {}, 0
            others = any(x["left"] for k, x in enumerate(said) if k != me)
            while turn == me and request is not None and made < per_turn and (made == 0 or not others or ready <= time.monotonic() + pause):
                time.sleep(max(0.0, pause, ready - time.monotonic()))
                got, error, name, started = {}, None, None, time.time()
                try:
                    got = respond({**request, "attempt": attempt})
                    if not got.get("content") and got.get("finish_reason") != "length":
                        name = "empty answer"
                except Exception as e:  # a failed call is a row, not a failed job
                    error, name = e, type(e).__name__
                ended, pause = time.time(), pause_of(error, spacing)
                final = name is None or attempt == retries
                out.append((str(request["request_id"]), attempt, got.get("content"), got.get("finish_reason"), got.get("completion_tokens"), name, final, me, slot + made, started, ended, pause))
                made += 1
                if final:
                    request, attempt, ready = next(queue, None), 1, 0.0
                else:
                    ready, attempt = time.monotonic() + backoff(attempt), attempt + 1
                more = {"pause": pause, "made": made}
            said = gather(**more)
            pause, slot = said[turn]["pause"], slot + said[turn]["made"]
            if len(out) >= 1000:
                yield frame(out)
                out = []
        yield frame(out)

    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"completion_tokens": "Int64", "attempt": "int32", "task": "int32", "slot": "int64"})

    return requests.repartition(tasks).mapInPandas(run, SCHEMA, barrier=True)


def pause_left(calls: DataFrame, now: float | None = None) -> float:
    """Seconds until the next call, by the log of an earlier job: its last call's end and pause."""
    last = calls.agg(F.max(F.col("ended") + F.col("pause"))).first()[0]
    return 0.0 if last is None else max(0.0, last - (time.time() if now is None else now))


def spacing_kept(calls: DataFrame, slack: float = 0.0) -> DataFrame:
    """Every call but the first with ``gap``, the seconds since the call before it ended, and whether that is at least its pause."""
    before = calls.select((F.col("slot") + 1).alias("slot"), F.col("ended").alias("last"), F.col("pause").alias("asked"))
    met = calls.join(before, "slot").withColumn("gap", F.col("started") - F.col("last"))
    return met.withColumn("kept", F.col("gap") >= F.col("asked") - slack)


def slots(spark: SparkSession, most: int) -> int:
    """How many tasks of a barrier stage surely run at the same time, up to ``most``."""
    return max(1, min(most, spark.sparkContext.defaultParallelism))


ship(__name__)
