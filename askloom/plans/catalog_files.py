"""Queries of sources and sinks: tables are written as the files that a run leaves, and read back."""

from __future__ import annotations

import json
import random
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import responder
from ..functions import text as T
from ..operators import manifest as J
from ..operators import runs as N
from ..session import work_dir
from ..sources import files, sinks
from ..sources.leases import Leases
from ..streaming import loop as L
from . import views as V
from .catalog import docs, query


def scratch(spark, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------------------------------------ records and keys
BAD_LINE = "CASE WHEN doc_id % 10 = 3 THEN 'broken' WHEN doc_id % 10 = 7 THEN 'list' ELSE 'fine' END"


@query("shard_scan", f"SELECT CAST(doc_id % 4 AS INT) AS shard, row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id) AS nth, CASE WHEN {BAD_LINE} = 'fine' THEN doc_id END AS corpus_id, CASE WHEN {BAD_LINE} = 'fine' THEN length(coalesce(text, '')) END AS body_chars FROM documents")
def shard_scan(spark, d):
    """Documents as four gzipped shards with broken, blank and list lines; order within a shard and its place in the listing hold."""
    base, t = scratch(spark, "shards"), docs(spark, d)
    good = F.to_json(F.struct(F.col("doc_id").alias("corpusid"), F.struct(F.coalesce("text", F.lit("")).alias("text")).alias("body")))
    line = F.when(F.col("doc_id") % 10 == 3, F.lit('{"corpusid": ')).when(F.col("doc_id") % 10 == 7, F.lit("[1]")).otherwise(good)
    blank = F.when(F.col("doc_id") % 5 == 0, F.array(line, F.lit("  "))).otherwise(F.array(line))
    rows = t.select("doc_id", F.explode(blank).alias("value"))
    paths = [f"{base}/{('d', 'a', 'c', 'b')[k]}{k}.jsonl.gz" for k in (2, 0, 3, 1)]
    for p in paths:
        sinks.one_file(rows.where(F.col("doc_id") % 4 == {"a": 0, "b": 1, "c": 2, "d": 3}[p.rsplit("/", 1)[-1][0]]), ["doc_id"], p)
    got = files.shard_records(spark, paths)
    nth = F.row_number().over(Window.partitionBy("shard").orderBy("line")).cast("long")
    body = F.try_variant_get("record", "$.body.text", "string")
    return got.select("shard", nth.alias("nth"), F.try_variant_get("record", "$.corpusid", "bigint").alias("corpus_id"), F.when(F.col("record").isNotNull(), F.char_length(body).cast("long")).alias("body_chars"))


@query("strict_scan", "SELECT doc_id, lang, length(coalesce(text, '')) AS chars FROM documents")
def strict_scan(spark, d):
    path = scratch(spark, "strict")
    docs(spark, d).select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text")).write.json(path)
    return files.strict_lines(spark, path, "doc_id long, lang string, text string").select("doc_id", "lang", F.char_length("text").cast("long").alias("chars"))


@query("existing_keys", "SELECT doc_id AS paper FROM documents WHERE doc_id < (SELECT max(doc_id) FROM documents)")
def existing_keys(spark, d):
    """An append-only file whose last line was cut off while it was written."""
    path = f"{scratch(spark, 'keys')}.jsonl"
    t = docs(spark, d).select("doc_id")
    whole = F.format_string('{"paper": %d}\n', "doc_id")
    last = F.col("doc_id") == F.lit(t.agg(F.max("doc_id")).first()[0])
    sinks.one_file(t.select("doc_id", F.when(last, F.substring(whole, 1, 7)).otherwise(whole).alias("value")), ["doc_id"], path, end=" ")
    return files.keys_of(spark, path, "paper")


@query("metadata_cache", "SELECT user_id, max_by({'v': CASE WHEN event_type = 'error' THEN NULL ELSE event_type END}, event_id).v AS value FROM events GROUP BY user_id")
def metadata_cache(spark, d):
    """A key-value log in JSON lines, some broken: the last write counts, a stored null stays."""
    path = scratch(spark, "cache")
    e = V.table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("value"))
    line = F.to_json(F.struct("event_id", "user_id", "value"))
    broken = F.when(F.col("event_id") % 9 == 0, F.array(line, F.substring(line, 1, 9))).otherwise(F.array(line))
    e.select(F.explode(broken).alias("value")).write.text(path)
    rows = spark.read.schema("event_id long, user_id long, value string, _corrupt string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt").where("_corrupt IS NULL")
    return files.latest_by_key(rows, "user_id", "value", "event_id")


@query("dataset_listing", "SELECT source || '.gz' AS file, CAST(row_number() OVER (ORDER BY source || '.gz') - 1 AS INT) AS shard FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)")
def dataset_listing(spark, d):
    """The files of a release by name, whatever host and signature their addresses have."""
    s = docs(spark, d).where("source IS NOT NULL").select("source").distinct()
    url = F.concat(F.lit("https://h"), F.pmod(F.xxhash64("source"), F.lit(7)), F.lit(".example.org/r/"), F.col("source"), F.lit(".gz?sig=a/b"))
    return files.listing(s.select(url.alias("url"))).select("file", "shard")


@query("batch_lookup", "SELECT DISTINCT user_id, CASE WHEN user_id % 3 <> 0 THEN 'meta ' || user_id END AS value FROM events")
def batch_lookup(spark, d):
    """Users looked up fifty at a time from a service that does not know every third."""
    return files.batch_lookup(V.table(spark, d, "events"), "user_id", lambda ids: [f"meta {i}" if i % 3 else None for i in ids], batch=50)


@query("cached_lookup", "SELECT DISTINCT user_id, CASE WHEN user_id % 2 = 0 THEN CASE WHEN user_id % 4 = 0 THEN NULL ELSE 'cached' END WHEN user_id % 3 <> 0 THEN 'meta ' || user_id END AS value, user_id % 2 <> 0 AS asked FROM events")
def cached_lookup(spark, d):
    """What the cache knows, unknowns too, is not asked again."""
    e = V.table(spark, d, "events")
    cache = e.where("user_id % 2 = 0").select("user_id", F.when(F.col("user_id") % 4 != 0, "cached").alias("value")).distinct()
    every, fresh = files.cached_lookup(e, cache, "user_id", lambda ids: [f"meta {i}" if i % 3 else None for i in ids], batch=50)
    asked = fresh.select(F.col("user_id").alias("u"), F.lit(True).alias("asked"))
    return every.join(asked, F.col("user_id") == F.col("u"), "left").select("user_id", "value", F.coalesce("asked", F.lit(False)).alias("asked"))


# ------------------------------------------------------------------------------------------------ run directories
def nations(spark, d):
    """One run directory per nation, so that the files are few whatever the number of customers."""
    c = V.table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).withColumnRenamed("c_nationkey", "k")
    n = V.table(spark, d, "nation")
    return sorted(tuple(r) for r in n.join(c, F.col("k") == F.col("n_nationkey"), "left").select("n_nationkey", "n_name", F.coalesce("n", F.lit(0))).collect())


NATIONS = "n AS (SELECT n_nationkey AS k, n_name AS name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM nation)"


@query("run_summaries", f"WITH {NATIONS} SELECT CASE k % 7 WHEN 4 THEN 'x_' ELSE '' END || name AS directory, name AS paper, n AS customers, k % 2 = 0 AS completed FROM n WHERE k % 7 NOT IN (0, 1, 2, 3)")
def run_summaries(spark, d):
    """Archived and private directories, broken files and empty ids are skipped; a missing key has its default, a null is false."""
    root = scratch(spark, "runs")
    for k, name, n in nations(spark, d):
        directory = {0: f"_{name}", 1: f"{name}.old.1", 4: f"x_{name}"}.get(k % 7, name)
        paper = "" if k % 7 == 3 else name
        done = {} if k % 2 == 0 else {"completed": None}
        text = "{broken" if k % 7 == 2 else json.dumps({"paper_id": paper, "customers": n} | done)
        sinks.put_text(spark, text, f"{root}/{directory}/summary.json")
    got = files.run_summaries(spark, root, "summary.json")
    return got.select("directory", F.col("paper_id").alias("paper"), F.variant_get("summary", "$.customers", "bigint").alias("customers"), files.flag(F.col("summary"), "$.completed", True).alias("completed"))


@query("directory_filter", "SELECT name FROM (SELECT CASE page_id % 5 WHEN 0 THEN '_' WHEN 1 THEN 'a_' ELSE '' END || page_id || CASE page_id % 3 WHEN 0 THEN '.old.' ELSE '.old' END AS name, page_id FROM pages) WHERE page_id % 5 <> 0 AND page_id % 3 <> 0")
def directory_filter(spark, d):
    name = F.concat(F.when(F.col("page_id") % 5 == 0, "_").when(F.col("page_id") % 5 == 1, "a_").otherwise(""), "page_id", F.when(F.col("page_id") % 3 == 0, ".old.").otherwise(".old"))
    return V.table(spark, d, "pages").select(name.alias("name")).where(N.usable_directory(F.col("name")))


@query("report_scan", f"WITH {NATIONS} SELECT name AS directory, 'run_00' || r AS run, n + r AS total FROM n, (SELECT unnest([1, 2]) AS r) WHERE NOT (k % 5 = 0 AND r = 2)")
def report_scan(spark, d):
    root = scratch(spark, "reports")
    for k, name, n in nations(spark, d):
        for r in (1, 2):
            text = ("[1]" if k % 2 else "{") if k % 5 == 0 and r == 2 else json.dumps({"total": n + r})
            sinks.put_text(spark, text, f"{root}/{name}/eval_attempts/run_00{r}/report.json")
    return files.reports(spark, root).select("directory", "run", F.variant_get("report", "$.total", "bigint").alias("total"))


@query("transcript_scan", "SELECT conv_id AS step, length(coalesce(text, '')) AS chars, role AS kind FROM conversations WHERE role = 'assistant'")
def transcript_scan(spark, d):
    """Transcript lines of one kind; lines that were cut off are skipped."""
    path = scratch(spark, "transcript")
    line = F.to_json(F.struct(F.lit("event").alias("type"), F.lit("main").alias("agent"), F.col("conv_id").alias("step"), F.col("role").alias("kind"), F.coalesce("text", F.lit("")).alias("data")))
    rows = V.table(spark, d, "conversations").select(F.explode(F.when(F.col("turn") % 2 == 0, F.array(line, F.lit('{"type": "ev'))).otherwise(F.array(line))).alias("value"))
    rows.write.text(path)
    return files.transcript(spark, path, ["assistant"]).select(F.col("step").cast("long").alias("step"), F.char_length("data").cast("long").alias("chars"), "kind")


# ------------------------------------------------------------------------------------------------ shards and configuration
@query("shard_choice", "SELECT doc_id, CAST(substr(source, 4, 10) AS INT) AS shard FROM documents WHERE CAST(substr(source, 4, 10) AS INT) IN (0, 2, 3, 4, 9)")
def shard_choice(spark, d):
    t = docs(spark, d).select("doc_id", F.substring("source", 4, 10).cast("int").alias("shard"))
    return t.where(F.col("shard").isin(files.parse_shards(" 0, 2-4,3 , 9")))


SAMPLE = random.Random(5).sample(range(12), 4)


@query("shard_sample", f"SELECT doc_id FROM documents WHERE CAST(substr(source, 4, 10) AS INT) IN ({', '.join(map(str, SAMPLE))})")
def shard_sample(spark, d):
    """Four of twelve shards by a seed: the sampling is the feature."""
    return docs(spark, d).where(F.substring("source", 4, 10).cast("int").isin(files.choose_shards(12, count=4, seed=5))).select("doc_id")


@query(
    "config_roles",
    """SELECT s_suppkey AS role, 'model-' || r_regionkey AS model, CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey AS VARCHAR) ELSE CAST(r_regionkey * 10 AS VARCHAR) END AS timeout, 'https://' || lower(r_name) || '.example/v1' AS url, CASE WHEN s_suppkey % 3 = 0 THEN 4 ELSE 3 END AS n_options
FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""",
)
def config_roles(spark, d):
    """Every supplier a role of its region's endpoint; some override the timeout; the address names a variable."""
    region, nation, supplier = (V.table(spark, d, t) for t in ("region", "nation", "supplier"))
    options = F.create_map(F.lit("model"), F.concat(F.lit("model-"), F.col("r_regionkey").cast("string")), F.lit("timeout"), (F.col("r_regionkey") * 10).cast("string"), F.lit("url"), F.concat(F.lit("$SCHEME://${HOST_"), F.col("r_regionkey").cast("string"), F.lit("}/v1")))
    hosts = region.agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("HOST_"), F.col("r_regionkey").cast("string")), F.concat(F.lower("r_name"), F.lit(".example"))))).alias("hosts"))  # a handful of regions
    roles = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("role"), F.col("n_regionkey").alias("endpoint"), F.when(F.col("s_suppkey") % 3 == 0, F.create_map(F.lit("timeout"), F.col("s_suppkey").cast("string"), F.lit("note"), F.lit("own"))).alias("overrides"))
    got = J.resolved_roles(roles, region.select(F.col("r_regionkey").alias("endpoint"), options.alias("options"))).crossJoin(F.broadcast(hosts))  # one row
    variables = F.map_concat(F.create_map(F.lit("SCHEME"), F.lit("https")), "hosts")
    return got.select("role", *[J.expanded(F.col("options")[k], variables).alias(k) for k in ("model", "timeout", "url")], F.size("options").alias("n_options"))


PAPERS = """s AS (SELECT c_nationkey AS root, c_custkey AS paper FROM customer WHERE c_custkey % 2 = 0 AND c_nationkey % 5 <> 0), n AS (SELECT c_nationkey AS root, c_custkey AS paper FROM customer WHERE c_custkey % 3 = 0),
b AS (SELECT root, paper, min(k) AS k FROM (SELECT *, 0 AS k FROM s UNION ALL SELECT *, 1 FROM n) GROUP BY root, paper)"""


@query("cohort_papers", f"WITH {PAPERS} SELECT root, paper, row_number() OVER (PARTITION BY root ORDER BY k, CASE WHEN k = 0 THEN -paper ELSE paper END) AS place FROM b")
def cohort_papers(spark, d):
    """Papers of each cohort in the order they were first asked for: the stored ones (backwards), then those that are new."""
    c = V.table(spark, d, "customer").select(F.col("c_nationkey").alias("root"), F.col("c_custkey").alias("paper"))
    stored = c.where("paper % 2 = 0 AND root % 5 <> 0").withColumn("place", -F.col("paper"))
    return J.merged_papers(stored, c.where("paper % 3 = 0").withColumn("place", F.col("paper")))


@query("cohort_manifest", "SELECT c_custkey AS root, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat_ws(',', CASE WHEN c_custkey % 3 = 0 THEN 'recipe' END, CASE WHEN c_custkey % 4 = 0 THEN 'rounds' END) END AS changed, CAST(CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_custkey % 2 + CASE WHEN c_custkey % 3 = 0 OR c_custkey % 4 = 0 THEN 1 ELSE 0 END END AS INT) AS n_history FROM customer")
def cohort_manifest(spark, d):
    """Runs that are asked for again with the same or with other settings, and such that have no manifest yet."""
    c, key = V.table(spark, d, "customer"), F.col("c_custkey")
    new = c.select(key.alias("root"), F.col("c_mktsegment").alias("recipe"), (key % 7).alias("rounds"))
    stored = c.where("c_custkey % 5 <> 0").select(key.alias("root"), F.when(key % 3 == 0, "other").otherwise(F.col("c_mktsegment")).alias("recipe"), F.when(key % 4 == 0, None).otherwise(key % 7).alias("rounds"), (key % 2).cast("int").alias("n_history"))
    return J.merged_manifests(stored, new, ["recipe", "rounds"]).select("root", F.array_join("changed", ",").alias("changed"), F.col("n_history").cast("int").alias("n_history"))


@query("lookup_counters", "WITH a AS (SELECT DISTINCT event_id % 4 AS shard, user_id AS k FROM events), o AS (SELECT *, k % 2 <> 0 AND shard = min(shard) OVER (PARTITION BY k) AS own FROM a) SELECT shard, count(*) FILTER (NOT own) AS from_cache, count(*) FILTER (own) AS from_service, CAST(ceil(count(*) FILTER (own) / 16) AS BIGINT) AS calls, count(*) FILTER (own AND k % 3 <> 0 AND k % 11 = 0) AS mismatches FROM o GROUP BY shard")
def lookup_counters(spark, d):
    """Users that four shards ask for: half of them cached, some unknown, some answered under another id."""
    e = V.table(spark, d, "events").select((F.col("event_id") % 4).alias("shard"), F.col("user_id").alias("key"))
    cache = e.where("key % 2 = 0").select("key", F.lit("{}").alias("value")).distinct()
    fetch = lambda ids: [f'{{"corpusId": {i + (i % 11 == 0)}}}' if i % 3 else None for i in ids]
    return files.counted_lookup(e, cache, fetch, batch=16)[2]


# ------------------------------------------------------------------------------------------------ sinks
@query("ordered_append", "SELECT doc_id, lang, source FROM documents")
def ordered_append(spark, d):
    """Two appends; the order of the rows is theirs, in a column."""
    path, t = scratch(spark, "corpus"), docs(spark, d).select("doc_id", "lang", "source")
    for k in (0, 1):
        sinks.append_ordered(t.where(F.col("doc_id") % 2 == k), path, ["source", "doc_id"])
    got = spark.read.parquet(path)
    return got.select(F.col("ord.doc_id").alias("doc_id"), "lang", F.col("ord.source").alias("source"))


@query("log_append", "SELECT event_id, event_type, user_id FROM events")
def log_append(spark, d):
    path, e = scratch(spark, "log"), V.table(spark, d, "events").select("event_id", "event_type", "user_id")
    sinks.append_log(e.where("event_id % 2 = 0"), path)
    sinks.append_log(e.where("event_id % 2 = 1"), path)
    return spark.read.schema("event_id long, event_type string, user_id long, logged_at timestamp").json(path).where("logged_at IS NOT NULL").drop("logged_at")


@query("json_sink", f"WITH {NATIONS} SELECT name, n FROM n")
def json_sink(spark, d):
    """A small JSON file, written twice: the second replaces the first as a whole."""
    path = f"{scratch(spark, 'stats')}.json"
    rows = nations(spark, d)
    sinks.write_json({"nations": []}, path, spark)
    sinks.write_json({"nations": [{"name": name, "n": n} for _, name, n in rows]}, path, spark)
    read = spark.read.schema("nations array<struct<name:string,n:long>>").json(path, multiLine=True)
    return read.select(F.explode("nations").alias("x")).select("x.name", "x.n")


@query("current_versions", "SELECT o_custkey AS paper, o_orderkey AS attempt, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS is_current FROM orders")
def current_versions(spark, d):
    """Reruns as versions: the last attempt is current, the others are the archive."""
    o = V.table(spark, d, "orders").select(F.col("o_custkey").alias("paper"), F.col("o_orderkey").alias("attempt"))
    return sinks.current_versions(o, "paper", "attempt")


@query("report_lines", f"WITH {V.verdict_sql(V.H.PROSE)} SELECT candidate, 'weak: avg % ' || CASE WHEN weak_passed THEN 'PASSED' ELSE 'FAILED' END || chr(10) || 'strong: avg % ' || CASE WHEN strong_passed THEN 'PASSED' ELSE 'FAILED' END || chr(10) || 'gap: ' || CASE WHEN gap_passed THEN 'PASSED' ELSE 'FAILED' END || chr(10) || 'overall: ' || CASE WHEN all_passed THEN 'ACCEPTED' ELSE 'REJECTED' END AS head FROM verdicts")
def report_lines(spark, d):
    """The report's lines; the numbers before percent signs, which engines round differently, are cut out, as are the reasons."""
    lines = F.split(F.regexp_replace("report", "[0-9.]+%", "%"), "\n")
    return sinks.report_lines(V.verdicts(spark, d)).select("candidate", F.array_join(F.slice(lines, 1, 4), "\n").alias("head"))


@query("report_table", "SELECT 1 AS line, '| metric | value |' AS shown UNION ALL SELECT 2, '|---|---|' UNION ALL SELECT 3, '| customers | ' || count(*) || ' |' FROM customer UNION ALL SELECT 4, '| nations | ' || count(DISTINCT c_nationkey) || ' |' FROM customer UNION ALL SELECT 5, '| missing | - |'")
def report_table(spark, d):
    row = V.table(spark, d, "customer").agg(F.count("*").alias("customers"), F.count_distinct("c_nationkey").alias("nations"), F.lit(None).cast("double").alias("missing")).first()
    return spark.createDataFrame(list(enumerate(sinks.markdown_table(row.asDict()).split("\n"), 1)), "line int, shown string")


@query("workspace_texts", "SELECT doc_id, CASE WHEN length(t) <= 500 THEN t ELSE substr(t, 1, 500) || chr(10) || '[truncated ' || (length(t) - 500) || ' chars]' END AS paper_text, substr(sha1(coalesce(source, '')), 1, 16) AS config FROM (SELECT *, coalesce(text, '') AS t FROM documents)")
def workspace_texts(spark, d):
    """What a paper's workspace holds: its text, cut with a note, and the recipe's fingerprint; the cut is the feature."""
    text = F.coalesce("text", F.lit(""))
    return docs(spark, d).select("doc_id", T.truncated(text, 500).alias("paper_text"), T.fingerprint(F.coalesce("source", F.lit(""))).alias("config"))


# ------------------------------------------------------------------------------------------------ running
@query("responder_tries", "WITH n AS (SELECT n_nationkey AS k, unnest(CASE WHEN n_nationkey % 4 = 0 THEN [1, 2, 3] WHEN n_nationkey % 4 = 1 THEN [1, 2] ELSE [1] END) AS attempt FROM nation) SELECT 'r' || k AS request, CAST(attempt AS INT) AS attempt, CASE WHEN k % 4 = 0 THEN 'TimeoutError' WHEN k % 4 = 1 AND attempt = 1 THEN 'empty answer' END AS error, attempt = CASE k % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS is_final FROM n")
def responder_tries(spark, d):
    """Every try is a row: failures and empty answers are tried again, an answer cut off by its length is one."""
    asked: dict[str, int] = {}

    def respond(r):
        k = int(r["k"])
        asked[r["request_id"]] = asked.get(r["request_id"], 0) + 1
        if k % 4 == 0:
            raise TimeoutError
        empty = (k % 4 == 1 and asked[r["request_id"]] == 1) or k % 4 == 2
        return {"content": "" if empty else "ok", "finish_reason": "length" if k % 4 == 2 else "stop", "completion_tokens": k}

    n = V.table(spark, d, "nation").select(F.concat(F.lit("r"), "n_nationkey").alias("request_id"), F.col("n_nationkey").alias("k"))
    return responder.answers(n, respond, retries=3, sleep=lambda s: None).select(F.col("request_id").alias("request"), "attempt", "error", "is_final")


PLAN = "CASE WHEN c_custkey % 11 = 0 THEN 'locked' WHEN n IS NOT NULL AND n % 5 = 0 THEN 'repair' WHEN n % 2 = 0 THEN 'resume' WHEN n IS NOT NULL THEN 'rerun' ELSE 'run' END"


@query("run_plan", f"WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT c_custkey AS paper, {PLAN} AS action FROM customer LEFT JOIN o ON o_custkey = c_custkey")
def run_plan(spark, d):
    c = V.table(spark, d, "customer").select(F.col("c_custkey").alias("paper"))
    s = V.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("paper")).agg(F.count("*").alias("n"))
    return N.run_plan(c, s, F.col("n") % 2 == 0, F.col("n") % 5 == 0, c.where("paper % 11 = 0"))


@query("resumed_run", "SELECT c_custkey AS paper, CASE WHEN c_custkey % 2 = 1 THEN 'drained' END AS skipped, CASE WHEN c_custkey % 2 = 0 THEN 'done ' || c_custkey END AS result FROM customer WHERE c_custkey % 7 <> 0")
def resumed_run(spark, d):
    """A queue in two deliveries; the second comes while the run is to be drained; papers that are done are left out."""
    base = scratch(spark, "queue")
    queue, target, checkpoint, drain = f"{base}/queue", f"{base}/target", f"{base}/checkpoint", f"{base}/DRAIN"
    c = V.table(spark, d, "customer").select(F.col("c_custkey").alias("paper"))
    work = lambda papers: papers.withColumn("result", F.concat(F.lit("done "), "paper"))
    done = c.where("paper % 7 = 0")
    c.where("paper % 2 = 0").coalesce(1).write.parquet(queue)
    L.run_papers(spark, queue, c.schema, work, target, checkpoint, drain, done)
    sinks.put_text(spark, "", drain)
    c.where("paper % 2 = 1").coalesce(1).write.mode("append").parquet(queue)
    L.run_papers(spark, queue, c.schema, work, target, checkpoint, drain, done)
    return spark.read.schema("paper long, result string, skipped string").parquet(target).select("paper", "skipped", "result")


@query("ingested", "SELECT DISTINCT o_custkey AS paper FROM orders")
def ingested(spark, d):
    """Two deliveries that repeat keys within and between them: each key arrives once."""
    base = scratch(spark, "ingest")
    o = V.table(spark, d, "orders").select(F.col("o_custkey").alias("paper"), "o_orderkey")
    for k in (0, 1):
        o.where(F.col("o_orderkey") % 2 == k).write.mode("append").parquet(f"{base}/in")
        L.ingest(spark, f"{base}/in", o.schema, f"{base}/out", f"{base}/checkpoint", "paper")
    return spark.read.parquet(f"{base}/out").select("paper")


@query("new_run_directories", "SELECT o_custkey AS paper, o_orderkey AS run FROM orders WHERE o_orderkey % 3 = 0")
def new_run_directories(spark, d):
    o = V.table(spark, d, "orders").select(F.col("o_custkey").alias("paper"), F.col("o_orderkey").alias("run"))
    return N.new_runs(o, o.where("run % 3 <> 0"), ["paper", "run"])


@query("exclusive_locks", "SELECT CAST(c_custkey AS VARCHAR) AS key, true AS first, false AS second, c_custkey % 2 = 0 AS after_release FROM customer")
def exclusive_locks(spark, d):
    """A second holder is refused until the first lets go."""
    c = V.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    leases = Leases(spark, scratch(spark, "locks"), "result int")
    got = lambda holder, now, name: leases.acquire(c, holder, 60, now).select("key", F.lit(True).alias(name))
    first, second = got("one", 0, "first"), got("two", 1, "second")
    leases.release("one", 2, c.where(F.col("key").cast("long") % 2 == 0))
    third = got("two", 3, "after_release")
    met = c.join(first, "key", "left").join(second, "key", "left").join(third, "key", "left")
    return met.select("key", *[F.coalesce(n, F.lit(False)).alias(n) for n in ("first", "second", "after_release")])


@query("ready_services", """WITH e AS (SELECT user_id, event_type <> 'error' AND event_id % 3 = 0 AS ready, epoch_us(ts) / 1e6 - min(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id) AS waited FROM events), t AS (SELECT * FROM e WHERE waited <= 200000),
f AS (SELECT *, min(CASE WHEN ready THEN waited END) OVER (PARTITION BY user_id) AS first FROM t) SELECT user_id AS service, count(*) AS probes, any_value(first) IS NOT NULL AS ready, CAST(round(coalesce(any_value(first), 200000), 3) AS DOUBLE) AS waited FROM f WHERE first IS NULL OR waited <= first GROUP BY user_id""")
def ready_services(spark, d):
    """Services by their probes: some answer at once, some after a while, some not within the wait."""
    e = V.table(spark, d, "events").select(F.col("user_id").alias("service"), F.col("ts").cast("timestamp").alias("at"), ((F.col("event_type") != "error") & (F.col("event_id") % 3 == 0)).alias("ready"))
    return J.readiness(e, 200_000).withColumn("waited", F.round("waited", 3))
