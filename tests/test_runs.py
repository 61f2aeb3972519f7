import datetime
import json
import shutil

import pytest
from pyspark.sql import functions as F

from askloom import responder
from askloom.operators import bench as B
from askloom.operators import rounds as R
from askloom.operators import runs as N
from askloom.sources import files
from askloom.streaming import loop as L


def test_newest_and_cohort(spark):
    rows = spark.createDataFrame([("p", "2024-01-01T00:00:00", "a"), ("p", "1704067200", "b"), ("p", "bad", "z"), ("q", None, "c")], "paper string, finished string, path string")
    assert {r.paper: r.path for r in N.newest(rows, "paper", F.col("finished"), "path", F.col("finished").rlike("^[0-9]+$")).collect()} == {"p": "b", "q": "c"}
    assert {r.paper: r.path for r in N.newest(rows, "paper", F.col("finished"), "path").collect()} == {"p": "a", "q": "c"}  # text that looks like a number is no time
    runs = spark.createDataFrame([("p", True, True), ("q", False, False), ("x", True, True)], "paper string, completed boolean, accepted boolean")
    want = spark.createDataFrame([("p",), ("q",), ("r",), ("s",)], "paper string")
    c = N.cohort(runs, want).first()
    assert (c.n_requested, c.n_completed, c.n_incomplete, c.n_pending, c.acceptance_rate, c.acceptance_rate_completed, c.acceptance_rate_cohort) == (4, 1, 1, 2, 0.5, 1.0, 0.25)


def test_failure_modes(spark):
    rows = [(True, True, True, True, 1), (False, False, None, None, 0), (False, True, False, None, 1), (False, True, True, False, 1), (False, None, None, None, 0), (False, True, None, None, 0)]
    df = spark.createDataFrame(rows, "a boolean, q boolean, w boolean, s boolean, n int")
    got = [r.m for r in df.select(R.failure_mode(df.a, df.q, df.w, df.s, df.n).alias("m")).collect()]
    assert got == ["ACCEPTED", "FAILED_QV", "TOO_EASY", "FAILED_ON_STRONG", "NO_QV", "NO_EVAL"]


def test_paired_evaluations(spark):
    rows = [("p", 1, 1, "weak-only", "a", True), ("p", 1, 2, "weak-only", "b", True), ("p", 1, 3, "strong-only", "a", True), ("p", 1, 4, "both", "c", False)]
    r = R.paired_evaluations(spark.createDataFrame(rows, "paper string, round int, seq int, mode string, question_hash string, has_report boolean")).first()
    assert (r.strong.seq, r.weak.seq) == (3, 1)


def test_resume_predicates(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    b, none = F.lit, F.lit(None)
    empty = F.array().cast("array<string>")
    assert one(N.agentic_done(b(True), b(True), b(False), empty, b("error"))) and not one(N.agentic_done(b(False), none, b(True), empty, b("crashed")))
    assert one(N.needs_final_qv(b(True), b(False), none)) and not one(N.needs_final_qv(b(True), b(True), b(True)))
    assert one(N.claim_matches(b(False), none, b(1))) is None and one(N.claim_matches(b(True), none, none.cast("int")))


def test_withdrawn(spark):
    rows = [("p", 1, True, True, True, True, ["x"], False), ("q", 1, True, True, True, True, [], False), ("r", 1, True, True, True, True, ["x"], False), ("r", 2, False, None, None, None, [], False)]
    df = spark.createDataFrame(rows, "paper string, round int, qv_passed boolean, weak_passed boolean, strong_passed boolean, gap_passed boolean, problems array<string>, binding boolean")
    assert [(r.paper, r.reason) for r in N.qualifying_rounds(df, ["x"]).collect()] == [("p", "withdrawn_report_checks:x")]


def test_scrape_and_deltas(spark):
    lines = ["# HELP", 'v:a_total{e="0"} 1', 'v:a_total{e="1"} 2.5', "v:a_created 9", 'v:p_total{position="1"} 4', "v:h_sum 10", "v:h_count 4", "v:bad x", "w:z_total 1"]
    after = B.scrape(spark.createDataFrame([(x,) for x in lines], "value string"), "v:")
    got = {r.metric: r.value for r in after.collect()}
    assert got == {"v:a_total": 3.5, "v:p_total/position=1": 4.0, "v:h_sum": 10.0, "v:h_count": 4.0}
    before = spark.createDataFrame([("v:a_total", 3.5)], "metric string, value double")
    d = B.deltas(before, after)
    assert {r.metric for r in d.collect()} == {"v:p_total/position=1", "v:h_sum", "v:h_count"} and B.means(d).first()["mean"] == 2.5


def test_run_directories(spark, tmp_path):
    for name, text in (("a", '{"paper_id": "p", "completed": null}'), ("_x", '{"paper_id": "q"}'), ("b.old.1", '{"paper_id": "q"}'), ("c", "{broken"), ("d", '{"paper_id": 3}'), ("e", '{"paper_id": "r"}')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "s.json").write_text(text)
    rows = files.run_summaries(spark, str(tmp_path), "s.json")
    got = {r.paper_id: r.done for r in rows.select("paper_id", files.flag(F.col("summary"), "$.completed", True).alias("done")).collect()}
    assert got == {"p": False, "r": True}  # a null is false, a missing key has the default


def test_torn_tail(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text('{"id": 1}\n\n{"id": 2}\n{"id": 3')
    assert sorted(r.id for r in files.keys_of(spark, str(p), "id").collect()) == [1, 2]
    p.write_text('{"id": 1}\n{"x\n{"id": 3}\n')
    with pytest.raises(Exception, match="malformed"):
        files.keys_of(spark, str(p), "id").collect()


def test_shards(spark, tmp_path):
    import gzip

    for name, lines in (("b.gz", ['{"corpusid": 1}', "", "{bad", "[1]"]), ("a.gz", ['{"corpusid": 2}'])):
        with gzip.open(tmp_path / name, "wt") as f:
            f.write("\n".join(lines) + "\n")
    rows = files.shard_records(spark, [f"{tmp_path}/b.gz", f"{tmp_path}/a.gz"]).orderBy("shard", "line").collect()
    assert [(r.shard, r.record is None) for r in rows] == [(0, False), (1, False), (1, True), (1, True)]
    assert files.parse_shards("0,2-4,3") == [0, 2, 3, 4] and files.choose_shards(9, count=3, seed=1) == files.choose_shards(9, count=3, seed=1)


def test_lookup_and_responder(spark):
    keys = spark.createDataFrame([(1,), (2,), (2,), (3,)], "id long")
    cache = spark.createDataFrame([(3, None)], "id long, value string")
    every, fresh = files.cached_lookup(keys, cache, "id", lambda ids: [json.dumps({"n": i}) if i == 1 else None for i in ids], batch=2)
    assert {r.id: r.value for r in every.collect()} == {1: '{"n": 1}', 2: None, 3: None} and fresh.count() == 2

    def respond(r):
        if r["request_id"] == "b":
            raise TimeoutError
        return {"content": "" if r["request_id"] == "c" else "ok", "finish_reason": "length" if r["request_id"] == "c" else "stop"}

    got = responder.answers(spark.createDataFrame([("a",), ("b",), ("c",)], "request_id string"), respond, retries=2, sleep=lambda s: None).collect()
    assert sorted((r.request_id, r.attempt, r.error, r.is_final) for r in got) == [("a", 1, None, True), ("b", 1, "TimeoutError", False), ("b", 2, "TimeoutError", True), ("c", 1, None, True)]


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = [(1, 1, "challenger", "q", None), (1, 2, "quality_verifier", "q", True), (1, 3, "both", "q", True), (2, 1, "both", "x", True), (1, 4, "challenger", "r", None)]
    df = spark.createDataFrame(rows, "paper long, seq long, kind string, question string, passed boolean")
    batch = {(r.paper, r.seq): r.decision for r in L.replay(df).collect()}
    assert batch[1, 3] == "accepted" and batch[1, 4] == "refused: after acceptance" and batch[2, 1] == "refused: foreign question"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for lo in (0, 3):
        part = spark.createDataFrame(rows[lo : lo + 3], df.schema).coalesce(1)
        part.write.mode("append").parquet(src)
    stream = L.replay_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert {(r.paper, r.seq): r.decision for r in spark.read.parquet(out).collect()} == batch


def test_ingest_twice(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    one.write.parquet(src)
    L.ingest(spark, src, one.schema, out, cp, "id")
    L.ingest(spark, src, one.schema, out, cp, "id")
    spark.createDataFrame([(2, "c"), (3, "d")], one.schema).write.mode("append").parquet(src)
    L.ingest(spark, src, one.schema, out, cp, "id")
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_progress_stream_agrees_with_batch(spark, tmp_path):
    rows = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id % 5, id, 0) as ts, concat('t', id % 3) as event_type, id as user_id from range(60)")
    rows.write.parquet(str(tmp_path / "events"))
    src = str(tmp_path / "events")
    stream = L.progress(spark.readStream.schema(rows.schema).parquet(src))
    stream.writeStream.outputMode("complete").format("memory").queryName("progress").trigger(availableNow=True).start().awaitTermination()
    want = {tuple(r) for r in L.progress(spark.read.parquet(src)).collect()}
    assert {tuple(r) for r in spark.table("progress").collect()} == want and len(want) > 10


def test_stream_state_has_an_end(spark, tmp_path):
    """State goes when a paper has not moved for the deadline; what comes after has a decision of its own; others go on as in a batch."""
    schema = "paper long, seq long, kind string, question string, passed boolean, ts timestamp"
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    deliveries = [
        [(1, 1, "challenger", "q", None, at(0)), (2, 1, "challenger", "x", None, at(1)), (3, 1, "challenger", "z", None, at(1))],
        [(1, 2, "quality_verifier", "q", True, at(2)), (1, 3, "both", "q", True, at(3)), (2, 2, "quality_verifier", "x", True, at(3))],
        [(2, 3, "weak-only", "x", False, at(25)), (4, 1, "challenger", "n", None, at(60))],  # moves the watermark beyond all ends but that of 4
        [(5, 1, "challenger", "m", None, at(61))],
        [(1, 4, "challenger", "r", None, at(62)), (2, 4, "both", "x", True, at(62)), (4, 2, "quality_verifier", "n", True, at(62)), (3, 1, "challenger", "again", None, at(62))],
    ]
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for rows in deliveries:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = L.replay_stream(spark.readStream.schema(schema).parquet(src), deadline=30 * 60, late="1 minute")
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
        query.awaitTermination()
    got = {(r.paper, r.seq): r.decision for r in spark.read.parquet(out).collect()}
    whole = spark.createDataFrame([r for rows in deliveries for r in rows if (r[0], r[1]) not in ((1, 4), (2, 4)) and r[3] != "again"], schema)
    want = {(r.paper, r.seq): r.decision for r in L.replay(whole).collect()}
    assert {k: v for k, v in got.items() if k in want and k != (3, 1)} == {k: v for k, v in want.items() if k != (3, 1)}
    assert got[1, 4] == got[2, 4] == L.EXPIRED and got[3, 1] == "round"  # a first event begins anew
    kept = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert kept == 3  # 3, 4 and 5


def test_ingest_reads_no_earlier_batch(spark, tmp_path):
    """Keys of earlier batches are known from the query's state: their files may be gone."""
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema = "id long, t string"
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "b")], schema).write.parquet(src)
    L.ingest(spark, src, schema, out, cp, "id")
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2]
    shutil.rmtree(out)
    spark.createDataFrame([(2, "c"), (3, "d")], schema).write.mode("append").parquet(src)
    L.ingest(spark, src, schema, out, cp, "id")
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [3]


def test_ingest_within_a_bound(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema = "id long, ts timestamp"
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    for rows in ([(1, at(0)), (1, at(0))], [(1, at(1)), (2, at(5))], [(3, at(9))], [(1, at(10)), (2, at(10))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        L.ingest(spark, src, schema, out, cp, "id", within=("ts", "2 hours"))
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 1, 2, 2, 3]
