"""Live model answers as a partition function: bounded retries, every try a row. The engine hosts no model.

``respond(request) -> dict`` returns content, finish_reason, completion_tokens, or raises. An answer cut off by its length is a
result; an empty answer that stopped by itself is tried again. A recorded table of answers serves the same shape without calls.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "request_id string, attempt int, content string, finish_reason string, completion_tokens long, error string, is_final boolean"

from .functions.lazy import ship


def delay(attempt: int, cap: float = 60.0) -> float:
    return min(cap, 2.0**attempt)


def answers(requests: DataFrame, respond: Callable[[dict], dict], retries: int = 3, parallel: int | None = None, spacing: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """requests: request_id and whatever ``respond`` reads -> all tries. ``parallel`` bounds how many tasks call at once.

    A task keeps ``spacing`` seconds between the end of a call and the next one; with parallel=1 that holds for all calls.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for b in batches:
            out = []
            for request in b.to_dict("records"):
                for attempt in range(1, retries + 1):
                    if last is not None and spacing:
                        sleep(max(0.0, last + spacing - time.monotonic()))
                    got, error = {}, None
                    try:
                        got = respond(request)
                        if not got.get("content") and got.get("finish_reason") != "length":
                            error = "empty answer"
                    except Exception as e:  # a failed call is a row, not a failed job
                        error = type(e).__name__
                    last = time.monotonic()
                    final = error is None or attempt == retries
                    out.append((str(request["request_id"]), attempt, got.get("content"), got.get("finish_reason"), got.get("completion_tokens"), error, final))
                    if final:
                        break
                    sleep(delay(attempt))
            yield pd.DataFrame(out, columns=["request_id", "attempt", "content", "finish_reason", "completion_tokens", "error", "is_final"]).astype({"completion_tokens": "Int64"})

    return (requests.repartition(parallel) if parallel else requests).mapInPandas(run, SCHEMA)


def wait_ready(probes: dict[str, Callable[[], bool]], wait: float = 1800.0, every: float = 15.0, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> list[str]:
    """Wait until every service answers its probe; the names of those that still do not after ``wait`` seconds (then work goes on)."""
    end = clock() + wait
    while (lacking := [name for name, ready in probes.items() if not ready()]) and (left := end - clock()) > 0:
        sleep(min(every, left))
    return lacking


def recorded(requests: DataFrame, table: DataFrame) -> DataFrame:
    """The final answers of an earlier run for these requests; null where there is none."""
    return requests.select("request_id").join(table.where("is_final"), "request_id", "left")


ship(__name__)
