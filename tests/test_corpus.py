from pyspark.sql import functions as F

from askloom.functions import text as T
from askloom.operators import corpus as C

F_ = C.Filters(min_year=2022, field="cs", min_body=5, max_body=10, min_abstract=3)
# shard, line, corpus_id, body_chars
RECORDS = [
    (0, 0, 1, 6), (0, 1, None, 6), (0, 2, 2, 3), (0, 3, 2, 7), (0, 4, 1, 8), (0, 5, 3, 11), (0, 6, 4, 6), (0, 7, 5, 6), (0, 8, 6, 6), (0, 9, 7, 6), (0, 10, 8, 6),
    (1, 0, 9, 6), (1, 1, 9, 6), (1, 2, 10, 6),
]
META = [(1, 2023, ["cs"], "abstract"), (2, 2023, ["cs"], "abstract"), (4, 2020, ["cs"], "abstract"), (5, 2023, ["math"], "abstract"), (6, 2023, ["cs"], " ab "), (7, None, ["cs"], "abstract"), (9, 2022, ["x", "cs"], "abc"), (10, 2024, ["cs"], "abcd")]


def outcomes(spark, existing=None):
    r = spark.createDataFrame(RECORDS, "shard int, line int, corpus_id long, body_chars int")
    m = spark.createDataFrame(META, "corpus_id long, year int, fields array<string>, abstract string")
    e = None if existing is None else spark.createDataFrame([(x,) for x in existing], "corpus_id long")
    return C.look_up(C.classify(r, F_, e), m, F_)


def test_outcomes(spark):
    got = {(r.shard, r.line): r.outcome for r in outcomes(spark).collect()}
    want = ["kept", "bad_record", "body_too_short", "kept", "duplicate", "body_too_long", "year_too_old", "not_in_field", "no_abstract", "year_missing", "not_found"]
    assert [got[0, i] for i in range(11)] == want
    assert [got[1, i] for i in range(3)] == ["kept", "duplicate", "kept"]


def test_cut_is_a_prefix(spark):
    kept = lambda n, e=None, a=0: [r.corpus_id for r in C.cut_at(outcomes(spark, e), n, a).where("outcome = 'kept'").orderBy("shard", "line").collect()]
    assert kept(4) == [1, 2, 9, 10] and kept(3) == [1, 2, 9] and kept(9) == [1, 2, 9, 10] and kept(0) == []
    assert kept(4, [1, 2], 2) == [9, 10]
    assert C.cut_at(outcomes(spark), 2).count() == 4  # scanning stops at the second kept record


def test_tally(spark):
    t = {r.shard: r for r in C.tally(outcomes(spark)).collect()}
    assert t[0].scanned == 11 and t[0].kept == 2 and t[0].repeated == 2 and t[1].duplicate == 1
    assert {r.shard: r.kept for r in C.totals(outcomes(spark)).collect()} == {0: 2, 1: 2, None: 4}


def test_select_papers(spark):
    rows = spark.createDataFrame([(0, "a/b", "x" * 9), (1, "a_b", "x" * 9), (2, "c", "x"), (3, "..", "x" * 9), (4, "d", "x" * 9)], "i long, id string, t string")
    got = C.select_papers(rows, "i", F.col("id"), F.col("t"), offset=1, min_chars=5).orderBy("i").collect()
    assert [r.paper_id for r in got] == ["paper", "d"]
    wanted = spark.createDataFrame([("a/b",), ("d",)], "paper_id string")
    assert [r.paper_id for r in C.select_papers(rows, "i", F.col("id"), F.col("t"), wanted=wanted).orderBy("i").collect()] == ["a_b", "d"]


def test_containment_matches_nested_loop(spark):
    texts = ["The quick  brown fox jumps over it", "xquick brown fox jumpsy", "", None, "a b", "brown\nfox"]
    items = ["quick brown fox jumps", "Brown Fox", "a", "zzz yyy xxx www vvv uuu", "over it"]
    t = spark.createDataFrame(list(enumerate(texts)), "d long, text string")
    i = spark.createDataFrame(list(enumerate(items)), "n long, item string")
    norm = lambda s: " ".join((s or "").lower().split())
    want = {(d, n) for d, x in enumerate(texts) for n, y in enumerate(items) if norm(y) in norm(x)}
    assert {(r.d, r.n) for r in C.containment(t, i).collect()} == want


def test_authors_and_ids(spark):
    raw = '["Ann  Lee", {"name": "Bo"}, {"first": "C", "middle": ["D"], "last": "E"}, 5, {"name": ""}]'
    df = spark.createDataFrame([(raw,)], "r string").select(F.parse_json("r").alias("v"))
    assert df.select(C.author_names(F.col("v")).alias("a")).first().a == ["Ann Lee", "Bo", "C D E"]
    ids = spark.createDataFrame([("7",), ('"8"',), ("true",), ("null",), ('"x"',)], "r string")
    assert [r.i for r in ids.select(C.parse_id(F.parse_json("r")).alias("i")).collect()] == [7, 8, None, None, None]


def test_text(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.strip_reasoning(F.lit("a<think x>b</THINK>c<think>d"))) == "ac"
    assert one(T.url_basename(F.lit("https://h/a/b.gz?x=/y"))) == "b.gz" and one(T.url_basename(F.lit("https://h"))) == ""
    assert one(T.safe_id(F.lit("../a b"))) == "a_b" and one(T.truncated(F.lit("abcdef"), 2)) == "ab\n[truncated 4 chars]"
    assert one(T.starts_lowercase(F.lit("  é"))) and not one(T.starts_lowercase(F.lit("É")))
    grams = ["w%d" % (i % 9) for i in range(40)]
    want = len({tuple(grams[i : i + 4]) for i in range(37)}) / 37
    assert abs(one(T.distinct_ngram_ratio(F.lit(" ".join(grams)))) - want) < 1e-12 and one(T.distinct_ngram_ratio(F.lit("a b"))) is None
    assert one(T.epoch_seconds(F.lit("nope"))) == float("-inf") and one(T.epoch_seconds(F.lit("1970-01-01T00:01:00"))) == 60.0
