"""The per-paper loop as a state machine over ordered events, and incremental ingestion with durable progress."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lazy import ship

MAX_ROUNDS = 15
DECISIONS = "paper long, seq long, kind string, decision string, round int, accepted_round int"


class Loop:
    """One paper's state. ``step`` decides an event: what is done, refused, or answered from an earlier result."""

    def __init__(self, rounds: int = 0, accepted: int = 0, max_rounds: int = MAX_ROUNDS):
        self.rounds, self.accepted, self.max_rounds = rounds, accepted, max_rounds
        self.question: str | None = None
        self.qv: bool | None = None
        self.verified: set[str] = set()  # questions with a completed verification this round
        self.evaluated: dict[tuple[str, str], bool] = {}  # (question, mode) -> passed everything

    def saved(self) -> tuple:
        """The state as a row of KEPT: bounded by one round's questions."""
        done = sorted(self.evaluated.items())
        return self.rounds, self.accepted, self.question, self.qv, sorted(self.verified), [q for (q, _), _ in done], [k for (_, k), _ in done], [p for _, p in done]

    @classmethod
    def restored(cls, row: tuple) -> Loop:
        rounds, accepted, question, qv, verified, questions, kinds, passed = row
        loop = cls(rounds, accepted)
        loop.question, loop.qv, loop.verified = question, qv, set(verified)
        loop.evaluated = {(q, k): bool(p) for q, k, p in zip(questions, kinds, passed)}
        return loop

    def step(self, kind: str, question: str | None, passed: bool | None, complete: bool = True) -> str:
        if kind == "challenger":
            if self.accepted:
                return "refused: after acceptance"
            if self.rounds >= self.max_rounds:
                return "refused: round budget"
            self.rounds += 1
            self.question, self.qv, self.verified, self.evaluated = question, None, set(), {}
            return "round"
        if not self.rounds:
            self.rounds = 1
        if kind == "quality_verifier":
            if question in self.verified:
                return "refused: repeated verification"
            self.qv = bool(passed) and complete if passed is not None else (None if complete else False)
            if complete and question is not None:
                self.verified.add(question)
            return "verified"
        if self.accepted:
            return "refused: after acceptance"
        if question is None or question != self.question:
            return "refused: foreign question"
        if (question, kind) in self.evaluated:
            return "cached"
        if complete:
            self.evaluated[question, kind] = bool(passed)
        if complete and passed:
            if not self.qv:
                return "refused: no passing verification"
            self.accepted = self.rounds
            return "accepted"
        return "evaluated"


KEPT = "rounds int, accepted int, question string, qv boolean, verified array<string>, questions array<string>, kinds array<string>, passed array<boolean>"


def stepped(loop: Loop, paper, seq, kind, question, passed) -> tuple:
    decision = loop.step(kind, None if pd.isna(question) else question, None if pd.isna(passed) else bool(passed))
    return paper, seq, kind, decision, loop.rounds, loop.accepted or None


COLUMNS = ["paper", "seq", "kind", "question", "passed"]


def decided(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["paper", "seq", "kind", "decision", "round", "accepted_round"]).astype({"round": "Int32", "accepted_round": "Int32"})


def replay(events: DataFrame) -> DataFrame:
    """events: paper, seq, kind, question, passed -> a decision for each, paper by paper in the order of seq.

    Events pass in order and one paper's state is held at a time; a paper has at most a few dozen events (its round budget bounds them).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loop, now = Loop(), None
        for b in batches:
            out = []
            for row in zip(*(b[c].tolist() for c in COLUMNS)):
                if row[0] != now:
                    loop, now = Loop(), row[0]
                out.append(stepped(loop, *row))
            yield decided(out)

    return events.select(*COLUMNS).repartition("paper").sortWithinPartitions("paper", "seq").mapInPandas(run, DECISIONS)


EXPIRED = "refused: expired"


def replay_stream(events: DataFrame, deadline: float | None = None, late: str = "10 minutes", first_seq: int = 1) -> DataFrame:
    """The same over a stream; a paper's state is the loop's own, and events are decided in the order of seq within each batch.

    With a ``deadline`` (seconds of event time in a column ``ts``; see ``functions.text.evaluator_deadline``) state has an end: what
    has not moved for that long is dropped, accepted or not. A paper's events begin with ``first_seq``, so one that finds no state
    and is not the first comes after that end: its decision is 'refused: expired', whatever it asks for. Events that are ``late``
    beyond the watermark never get there; the query's progress counts them (numRowsDroppedByWatermark).
    """

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        new = pd.concat(list(batches), ignore_index=True).sort_values("seq")
        rows = list(zip(*(new[c].tolist() for c in COLUMNS)))
        if deadline is not None and not state.exists and rows[0][1] > first_seq:
            # Nothing is kept for such a paper, so nothing has to end; its first event, if it comes at last, begins it.
            yield decided([(paper, seq, kind, EXPIRED, None, None) for paper, seq, kind, *_ in rows])
            return
        loop = Loop.restored(state.get) if state.exists else Loop()
        out = decided([stepped(loop, *row) for row in rows])
        state.update(loop.saved())
        if deadline is not None:
            end = int(new["ts"].max().timestamp() * 1000 + deadline * 1000)
            state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield out

    if deadline is None:
        return events.groupBy("paper").applyInPandasWithState(run, DECISIONS, KEPT, "append", "NoTimeout")
    return events.withWatermark("ts", late).groupBy("paper").applyInPandasWithState(run, DECISIONS, KEPT, "append", "EventTimeTimeout")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def once(stream: DataFrame, key: str, within: tuple[str, str] | None) -> DataFrame:
    """Each key's first row of the whole stream; keys are kept in the query's state, no earlier batch is read again.

    ``within`` = (time column, duration) bounds that state: a key is then remembered for that long after its row.
    """
    if within is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(*within).dropDuplicatesWithinWatermark([key])


def ingest(spark: SparkSession, source: str, schema, target: str, checkpoint: str, key: str | None = None, within: tuple[str, str] | None = None) -> None:
    """Process the files that are new since the last call and add them to ``target``, a folder for each batch.

    Rows whose key came before, in this batch or an earlier one, are left out (see :func:`once`); a batch that is tried again
    replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    stream = spark.readStream.schema(schema).parquet(source)
    stream = stream if key is None else once(stream, key, within)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_papers(spark: SparkSession, queue: str, schema, work, target: str, checkpoint: str, drain: str, resume: DataFrame | None = None) -> None:
    """A resumable driver over a queue of papers (column ``paper``): each new paper gets one row in ``target``.

    ``work(papers) -> DataFrame`` runs them and returns paper and its result columns; papers of ``resume`` are done and left out.
    While the file ``drain`` exists, papers that are queued get a row with skipped = 'drained' and are not run; batches that were
    committed stay, a batch that failed is tried again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        papers = batch if resume is None else batch.join(resume.select("paper"), "paper", "left_anti")
        drained = exists(spark, drain)
        rows = papers.withColumn("skipped", F.lit("drained")) if drained else work(papers).withColumn("skipped", F.lit(None).cast("string"))
        rows.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(queue).select("paper")
    once(stream, "paper", None).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def progress(events: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events and their values by type and time window; batch or stream (then with a watermark)."""
    e = events.withColumn("at", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("at", late)
    g = e.groupBy(F.window("at", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("user_sum"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "user_sum")


ship(__name__)
