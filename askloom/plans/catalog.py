"""The query catalogue: every operator over the driver's tables, with SQL for engines to agree with."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import text as T
from ..operators import bench as B
from ..operators import corpus as C
from ..operators import messages as M
from ..operators import rounds as R
from ..operators import rubric as H
from ..operators import runs as N
from ..operators import stats as S
from ..streaming import loop as L
from . import views as V

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def docs(spark, d):
    return V.table(spark, d, "documents")


# ------------------------------------------------------------------------------------------------ scoring and acceptance
@query("rubric_score", f"WITH {V.ATTEMPTS} SELECT * FROM attempts")
def rubric_score(spark, d):
    return V.attempts(spark, d)


STAGE_COLUMNS = "candidate, max_positive, weak_n, weak_total, weak_top, weak_least, strong_n, strong_total, strong_top, strong_least"


@query("solver_stage_summary", f"WITH {V.STAGES} SELECT {STAGE_COLUMNS} FROM stages")
def solver_stage_summary(spark, d):
    return H.stages(V.attempts(spark, d)).select(*STAGE_COLUMNS.split(", "))


VERDICTS = ["candidate", "weak_passed", "strong_passed", "gap_passed", "all_passed"]


@query("acceptance_prose", f"WITH {V.verdict_sql(H.PROSE)} SELECT {', '.join(VERDICTS)} FROM verdicts")
def acceptance_prose(spark, d):
    return V.verdicts(spark, d, H.PROSE).select(*VERDICTS)


@query("acceptance_deployed", f"WITH {V.verdict_sql(H.DEPLOYED)} SELECT {', '.join(VERDICTS)} FROM verdicts")
def acceptance_deployed(spark, d):
    return V.verdicts(spark, d, H.DEPLOYED).select(*VERDICTS)


@query(
    "acceptance_reasons",
    f"""WITH {V.verdict_sql(H.DEPLOYED)} SELECT candidate, len(list_filter([
 10000 * weak_total > 6500 * weak_n * max_positive, 10000 * weak_top > 7500 * max_positive, weak_least = 0,
 10000 * strong_total < 6000 * strong_n * max_positive, 10000 * strong_total >= 9500 * strong_n * max_positive, strong_least = 0, NOT gap_passed], lambda x: x)) AS n_reasons,
 concat_ws(',', CASE WHEN 10000 * weak_total > 6500 * weak_n * max_positive THEN 'weak: TOO EASY' END, CASE WHEN 10000 * weak_top > 7500 * max_positive THEN 'weak: max_weak' END,
 CASE WHEN weak_least = 0 THEN 'weak: zero' END, CASE WHEN 10000 * strong_total < 6000 * strong_n * max_positive THEN 'failed on strong: strong_avg' END,
 CASE WHEN 10000 * strong_total >= 9500 * strong_n * max_positive THEN 'failed on strong: strong_avg' END, CASE WHEN strong_least = 0 THEN 'failed on strong: zero' END,
 CASE WHEN NOT gap_passed THEN 'gap' END) AS reasons FROM verdicts""",
)
def acceptance_reasons(spark, d):
    """Reasons in their fixed order; the percentages, which engines round differently, are cut off."""
    kind = lambda r: F.regexp_extract(r, r"^((?:weak: |failed on strong: )?(?:TOO EASY|max_weak|zero|strong_avg|gap))", 1)
    return V.verdicts(spark, d, H.DEPLOYED).select("candidate", F.size("failure_reasons").cast("long").alias("n_reasons"), F.array_join(F.transform("failure_reasons", kind), ",").alias("reasons"))


@query(
    "final_filter",
    f"""WITH {V.RUBRIC}, g AS (SELECT candidate, count(*) AS n_items, count(*) FILTER (weight > 0) AS n_positive, count(*) FILTER (weight < 0) AS n_negative,
 bool_and(abs(weight) BETWEEN 1 AND 10) AS weights_in_spec, CAST(max(part) AS BIGINT) AS context_chars FROM rubric GROUP BY candidate)
 SELECT *, n_items BETWEEN 4 AND 20 AND n_positive >= 2 AND n_negative >= 1 AS rubric_ok, context_chars >= 200 AS context_ok FROM g""",
)
def final_filter(spark, d):
    """Orders have at most seven lines, so the bounds on items are lower than an actual rubric's."""
    return H.final_filter(V.rubric(spark, d), F.col("part").cast("long"), items=(4, 20), min_positive=2, min_negative=1)


@query("weak_first_stage", f"WITH {V.verdict_sql(H.PROSE)} SELECT a.candidate, a.role, a.attempt, a.points FROM attempts a LEFT JOIN verdicts v USING (candidate) WHERE a.role = 'weak' OR v.weak_passed")
def weak_first_stage(spark, d):
    return H.weak_first(V.attempts(spark, d), H.PROSE).select("candidate", "role", "attempt", "points")


@query(
    "baseline_gap_repair",
    f"""WITH {V.STAGES} SELECT candidate, strong_total * weak_n - weak_total * strong_n AS gap_num, weak_n * strong_n * max_positive AS gap_den,
 10000 * (strong_total * weak_n - weak_total * strong_n) >= 2000 * weak_n * strong_n * max_positive AS gap_passed FROM stages""",
)
def baseline_gap_repair(spark, d):
    """The exact gap of a retained strong report and a new weak one, as a fraction."""
    v = V.verdicts(spark, d)
    gap = F.col("strong_total") * F.col("weak_n") - F.col("weak_total") * F.col("strong_n")
    return v.select("candidate", gap.alias("gap_num"), (F.col("weak_n") * F.col("strong_n") * F.col("max_positive")).alias("gap_den"), "gap_passed")


@query(
    "pairwise_agreement",
    f"""WITH {V.MARKS}, t AS (SELECT candidate, pos, count(*) FILTER (satisfied) AS t, count(*) FILTER (NOT satisfied) AS f FROM marks WHERE role = 'weak' GROUP BY ALL)
SELECT candidate, CAST(sum(t * (t - 1) + f * (f - 1)) AS BIGINT) AS agreeing, CAST(sum((t + f) * (t + f - 1)) AS BIGINT) AS pairs, sum(t * (t - 1) + f * (f - 1)) / sum((t + f) * (t + f - 1)) AS agreement FROM t GROUP BY candidate""",
)
def pairwise_agreement(spark, d):
    return B.pairwise_agreement(V.marks(spark, d).where("role = 'weak'"), "candidate", "attempt", "pos", "satisfied")


# ------------------------------------------------------------------------------------------------ rounds and statistics
@query("round_failure_mode", f"WITH {V.ROUNDS} SELECT paper, round, candidate, failure_mode FROM rounds")
def round_failure_mode(spark, d):
    return V.rounds(spark, d).select("paper", "round", "candidate", "failure_mode")


@query("failure_mode_share", f"WITH {V.ROUNDS} SELECT failure_mode, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM rounds WHERE failure_mode <> 'ACCEPTED' GROUP BY failure_mode")
def failure_mode_share(spark, d):
    return R.failure_shares(V.rounds(spark, d), [F.col("paper"), F.col("round")]).drop("first")


TABLE1_ITEMS = "round AS accepted_round, CAST(weak_total AS DOUBLE) / (weak_n * max_positive) AS weak_avg, CAST(strong_total AS DOUBLE) / (strong_n * max_positive) AS strong_avg"


@query("table1_stats", f"WITH {V.ROUNDS} SELECT count(*) AS n, avg(round) AS rounds_mean, median(round) AS rounds_median, max(round) AS rounds_max, CAST(sum(weak_total) AS BIGINT) AS weak_points, CAST(sum(strong_total) AS BIGINT) AS strong_points, avg(max_positive) AS rubric_items FROM rounds WHERE failure_mode = 'ACCEPTED'")
def table1_stats(spark, d):
    a = V.rounds(spark, d).where("accepted").withColumns({"weak_avg": F.col("weak_total").cast("double"), "strong_avg": F.col("strong_total").cast("double"), "gap": F.lit(None).cast("double"), "question_chars": F.lit(None).cast("int"), "n_rubric_items": F.col("max_positive")})
    t = S.table1(a)
    points = lambda c: F.round(F.col(c) * F.col("n")).cast("long")
    return t.select("n", "rounds_mean", "rounds_median", "rounds_max", points("weak_solver_avg").alias("weak_points"), points("strong_solver_avg").alias("strong_points"), "rubric_items")


RUNS = f"{V.ROUNDS}, runs AS (SELECT paper, bool_or(failure_mode = 'ACCEPTED') AS accepted, count(*) % 7 <> 0 AS completed, CAST(count(*) AS BIGINT) AS n_rounds FROM rounds GROUP BY paper)"


def runs(spark, d):
    r = V.rounds(spark, d).groupBy("paper").agg(F.bool_or("accepted").alias("accepted"), F.count("*").alias("n_rounds"))
    return r.withColumn("completed", F.col("n_rounds") % 7 != 0)


@query(
    "cohort_rates",
    f"""WITH {RUNS}, m AS (SELECT c_custkey AS paper, r.accepted, r.completed, r.paper IS NOT NULL AS present FROM customer c LEFT JOIN runs r ON r.paper = c.c_custkey)
SELECT count(*) AS n_requested, count(*) FILTER (completed) AS n_completed, count(*) FILTER (present AND NOT completed) AS n_incomplete, count(*) FILTER (NOT present) AS n_pending,
 count(*) FILTER (accepted) / nullif(count(*) FILTER (present), 0) AS acceptance_rate, count(*) FILTER (accepted AND completed) / nullif(count(*) FILTER (completed), 0) AS acceptance_rate_completed,
 count(*) FILTER (accepted) / nullif(count(*), 0) AS acceptance_rate_cohort FROM m""",
)
def cohort_rates(spark, d):
    return N.cohort(runs(spark, d), V.table(spark, d, "customer").select(F.col("c_custkey").alias("paper")))


@query(
    "cohort_pending",
    f"""WITH {RUNS}, d AS (SELECT CASE c_custkey % 10 WHEN 0 THEN '_' WHEN 1 THEN '.' ELSE '' END || 'p' || c_custkey || CASE WHEN c_custkey % 10 = 2 THEN '.old.1' ELSE '' END AS name, r.paper IS NOT NULL AS has FROM customer c LEFT JOIN runs r ON r.paper = c.c_custkey),
p AS (SELECT count(*) AS n FROM d WHERE NOT has AND name[1] NOT IN ('_', '.') AND NOT contains(name, '.old.'))
SELECT count(*) + any_value(n) AS n_requested, count(*) FILTER (completed) AS n_completed, count(*) FILTER (NOT completed) AS n_incomplete, any_value(n) AS n_pending, count(*) FILTER (accepted) / nullif(count(*) + any_value(n), 0) AS acceptance_rate_cohort FROM runs, p""",
)
def cohort_pending(spark, d):
    """Without a manifest: workspaces that were begun and have no summary are pending."""
    r = runs(spark, d)
    c = V.table(spark, d, "customer").join(r.select(F.col("paper").alias("c_custkey"), F.lit(True).alias("has_summary")), "c_custkey", "left")
    k = F.col("c_custkey") % 10
    name = F.concat(F.when(k == 0, "_").when(k == 1, ".").otherwise(""), F.lit("p"), F.col("c_custkey").cast("string"), F.when(k == 2, ".old.1").otherwise(""))
    return N.cohort(r, None, c.select(name.alias("directory"), "has_summary")).select("n_requested", "n_completed", "n_incomplete", "n_pending", "acceptance_rate_cohort")


@query("newest_summary", "SELECT o_custkey AS paper, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS newest FROM orders GROUP BY o_custkey")
def newest_summary(spark, d):
    o = V.table(spark, d, "orders").select(F.col("o_custkey").alias("paper"), F.col("o_orderkey").alias("newest"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("finished_at"))
    return N.newest(o, "paper", F.col("finished_at"), "newest").select("paper", "newest")


@query(
    "latest_log_skips",
    """WITH l AS (SELECT user_id AS paper, max_by(event_type, event_id) AS last FROM events GROUP BY user_id)
SELECT paper FROM l WHERE last = 'error' UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'""",
)
def latest_log_skips(spark, d):
    mark = lambda c, v: F.when(F.col(c) == v, "locked").otherwise(F.col(c)).alias("skipped")
    log = V.table(spark, d, "events").select(F.col("user_id").alias("paper"), F.col("event_id").alias("line"), mark("event_type", "error"))
    return N.skipped_locked(log, V.table(spark, d, "customer").select(F.col("c_custkey").alias("paper"), mark("c_mktsegment", "BUILDING")))


def report_rows(spark, d):
    """Every order is a report on its customer's question; its identity is the order's day within 30."""
    o = V.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    v = V.verdicts(spark, d).select("candidate", "all_passed", "weak_total", "strong_total")
    return o.join(v, o.o_orderkey == v.candidate).withColumn("day", F.dayofmonth("o_orderdate") % 3)


REPORTS = f"{V.verdict_sql(H.PROSE)}, reports AS (SELECT o.*, v.all_passed, v.weak_total, v.strong_total, day(o_orderdate) % 3 AS day FROM orders o JOIN verdicts v ON v.candidate = o.o_orderkey)"


@query(
    "accepted_report_pick",
    f"""WITH {REPORTS}, w AS (SELECT c_custkey AS paper, c_custkey % 3 AS h, c_nationkey % 3 AS l FROM customer),
p AS (SELECT paper, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM w JOIN reports ON o_custkey = paper AND (day = h OR day = l) WHERE all_passed GROUP BY paper)
SELECT w.paper, CASE WHEN k IS NULL THEN 'summary' ELSE 'report' END AS scores_source, k AS scores_report, r.weak_total AS weak_points, r.strong_total AS strong_points
FROM w LEFT JOIN p USING (paper) LEFT JOIN reports r ON r.o_orderkey = k""",
)
def accepted_report_pick(spark, d):
    none = F.lit(None).cast("double")
    r = report_rows(spark, d).select(F.col("o_custkey").alias("paper"), F.col("day").cast("long").alias("question_hash"), "all_passed", F.col("o_orderdate").alias("started"), F.col("o_orderkey").alias("path"), F.col("weak_total").alias("weak_avg"), F.col("strong_total").alias("strong_avg"), none.alias("gap"))
    w = V.table(spark, d, "customer").select(F.col("c_custkey").alias("paper"), (F.col("c_custkey") % 3).cast("long").alias("hash"), (F.col("c_nationkey") % 3).cast("long").alias("legacy_hash"), F.lit(None).cast("long").alias("weak_avg"), F.lit(None).cast("long").alias("strong_avg"), none.alias("gap"))
    return N.accepted_report(w, r).select("paper", "scores_source", "scores_report", F.col("weak_avg").alias("weak_points"), F.col("strong_avg").alias("strong_points"))


@query(
    "reusable_weak_pick",
    f"""WITH {REPORTS} SELECT c_custkey AS paper, max(o_orderkey) AS run_no FROM customer JOIN reports ON o_custkey = c_custkey AND (day = c_custkey % 3 OR day = c_nationkey % 3)
WHERE o_orderstatus <> 'P' AND o_orderkey % 2 = c_custkey % 2 GROUP BY c_custkey""",
)
def reusable_weak_pick(spark, d):
    fixed = {c: F.lit("same") for c in N.PROVENANCE if c != "config_sha1"}
    r = report_rows(spark, d).select(F.col("o_custkey").alias("paper"), F.col("o_orderkey").alias("run_no"), F.lit("both").alias("mode"), F.col("day").cast("long").alias("question_hash"), F.lit(None).cast("long").alias("question_hash_canonical"), F.lit(3).alias("n_weak"), F.when(F.col("o_orderstatus") == "P", "SOLVER_ERROR").alias("weak_error"), (F.col("o_orderkey") % 2).cast("string").alias("config_sha1")).withColumns(fixed)
    w = V.table(spark, d, "customer").select(F.col("c_custkey").alias("paper"), (F.col("c_custkey") % 3).cast("long").alias("question_hash"), (F.col("c_nationkey") % 3).cast("long").alias("legacy_hash"), (F.col("c_custkey") % 2).cast("string").alias("config_sha1")).withColumns(fixed)
    return N.reusable_weak(w, r)


@query("token_totals", "SELECT CAST(coalesce(sum(coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0)), 0) AS BIGINT) AS k, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS errors FROM events")
def token_totals(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return S.tokens(V.table(spark, d, "events"), {"k": k, "errors": (F.col("event_type") == "error").cast("long")})


@query("usage_by_user", "SELECT user_id, event_type AS counter, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS n FROM events GROUP BY ALL")
def usage_by_user(spark, d):
    u = F.create_map("event_type", F.get_json_object("props", "$.k").cast("long"))
    return S.usage_totals(V.table(spark, d, "events").withColumn("usage", u), "user_id", "usage")


@query("refinement_groups", f"WITH {V.ROUNDS} SELECT paper, string_agg('- ' || candidate, chr(10) ORDER BY round) FILTER (failure_mode = 'TOO_EASY') AS too_easy, string_agg('- ' || candidate, chr(10) ORDER BY round) FILTER (failure_mode = 'FAILED_ON_STRONG') AS failed_strong, string_agg('- ' || candidate, chr(10) ORDER BY round) FILTER (failure_mode = 'FAILED_QV') AS failed_qv FROM rounds WHERE failure_mode IN ('TOO_EASY', 'FAILED_ON_STRONG', 'FAILED_QV') GROUP BY paper")
def refinement_groups(spark, d):
    return R.refinement_lists(V.rounds(spark, d).withColumn("question", F.col("candidate").cast("string")))


@query("stop_reasons", f"WITH {V.ROUNDS} SELECT last, count(*) AS n FROM (SELECT paper, max_by(failure_mode, round) AS last FROM rounds GROUP BY paper) GROUP BY last")
def stop_reasons(spark, d):
    last = V.rounds(spark, d).groupBy("paper").agg(F.max_by("failure_mode", "round").alias("last"))
    return last.groupBy("last").agg(F.count("*").alias("n"))


@query("baseline_blocks", f"WITH {V.verdict_sql(H.PROSE)}, b AS (SELECT all_passed, unnest(['all_evaluated'] || CASE WHEN o_orderstatus <> 'P' THEN ['qv_passed'] ELSE [] END || CASE WHEN o_custkey % 2 = 0 THEN ['final_filter_passed'] ELSE [] END) AS block FROM orders JOIN verdicts ON candidate = o_orderkey) SELECT block, count(*) AS n, avg(CAST(all_passed AS INT)) AS would_pass_solver_criteria FROM b GROUP BY block")
def baseline_blocks(spark, d):
    o = V.table(spark, d, "orders").join(V.verdicts(spark, d), F.col("candidate") == F.col("o_orderkey"))
    r = o.select(F.col("weak_total").alias("weak_avg"), F.col("strong_total").alias("strong_avg"), F.lit(0).alias("gap"), F.array().cast("array<string>").alias("errors"), (F.col("o_orderstatus") != "P").alias("qv_passed"), (F.col("o_custkey") % 2 == 0).alias("final_filter_passed"), F.lit(0).alias("question_chars"), F.lit(0).alias("n_rubric_items"), F.col("all_passed").alias("criteria_passed"))
    return S.nested_blocks(r).select("block", "n", "would_pass_solver_criteria")


# ------------------------------------------------------------------------------------------------ corpus
FILTERS = C.Filters(min_year=2000, field="en", min_body=400, max_body=8000, min_abstract=1)


def records(spark, d):
    """Documents as a release: a source is a shard, an id the number of the text's hash."""
    t = docs(spark, d)
    key = F.conv(F.substring(F.sha1(F.coalesce("text", F.lit(""))), 1, 12), 16, 10).cast("long")
    return t.select("doc_id", F.substring("source", 4, 10).cast("int").alias("shard"), F.col("doc_id").alias("line"), key.alias("corpus_id"), F.col("n_chars").alias("body_chars"), "lang")


def outcomes(spark, d):
    """Metadata: labelled documents by their text's hash; label quality stands for the year, language for the field."""
    r = records(spark, d)
    meta = r.join(V.table(spark, d, "labels"), "doc_id").groupBy("corpus_id").agg(F.min("doc_id").alias("k"), F.min_by(F.struct("lang", "quality", "toxic"), "doc_id").alias("m"))
    meta = meta.select("corpus_id", (F.lit(1999) + F.col("m.quality")).alias("year"), F.array("m.lang").alias("fields"), F.when(F.col("m.toxic") == 0, "abstract").otherwise(" ").alias("abstract"))
    return C.look_up(C.classify(r, FILTERS), meta, FILTERS)


OUTCOMES = """r AS (SELECT doc_id, CAST(substr(source, 4, 10) AS INT) AS shard, doc_id AS line, sha1(coalesce(text, '')) AS cid, n_chars, lang FROM documents),
body AS (SELECT *, CASE WHEN n_chars < 400 THEN 'body_too_short' WHEN n_chars > 8000 THEN 'body_too_long' END AS body FROM r),
claim AS (SELECT *, min(CASE WHEN body IS NULL THEN (shard, line) END) OVER (PARTITION BY cid) AS claimed, min((shard, line)) OVER (PARTITION BY cid) AS first FROM body),
local AS (SELECT *, CASE WHEN (shard, line) > claimed THEN 'duplicate' ELSE body END AS o, (shard, line) > first AS repeated FROM claim),
meta AS (SELECT cid, arg_min(lang, doc_id) AS m_lang, arg_min(quality, doc_id) AS m_quality, arg_min(toxic, doc_id) AS m_toxic FROM r JOIN labels USING (doc_id) GROUP BY cid),
outcomes AS (SELECT l.*, l.o IS NULL AS looked_up, m.cid IS NOT NULL AS found, m_lang, m_quality, m_toxic,
 coalesce(l.o, CASE WHEN m.cid IS NULL THEN 'not_found' WHEN m_quality < 1 THEN 'year_too_old' WHEN m_lang <> 'en' THEN 'not_in_field' WHEN m_toxic <> 0 THEN 'no_abstract' END, 'kept') AS outcome
 FROM local l LEFT JOIN meta m ON m.cid = l.cid AND l.o IS NULL)"""
COUNTS = ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in C.OUTCOMES)


@query("corpus_outcomes", f"WITH {OUTCOMES} SELECT shard, count(*) AS scanned, count(*) FILTER (looked_up) AS looked_up, count(*) FILTER (repeated) AS repeated, {COUNTS} FROM outcomes GROUP BY shard")
def corpus_outcomes(spark, d):
    return C.tally(outcomes(spark, d))


@query("corpus_totals", f"WITH {OUTCOMES} SELECT shard, count(*) AS scanned, {COUNTS} FROM outcomes GROUP BY ROLLUP (shard)")
def corpus_totals(spark, d):
    return C.totals(outcomes(spark, d))


@query("corpus_build_topn", f"WITH {OUTCOMES} SELECT doc_id, shard FROM outcomes WHERE outcome = 'kept' ORDER BY shard, line LIMIT 60")
def corpus_build_topn(spark, d):
    """The first sixty kept records in release order: stopping at N is the feature."""
    return C.cut_at(outcomes(spark, d), 60).where("outcome = 'kept'").select("doc_id", "shard")


@query(
    "corpus_marginals",
    f"""WITH {OUTCOMES} SELECT shard, count(*) AS n_looked_up, count(*) FILTER (found) AS meta_found, count(*) FILTER (found AND m_quality >= 1) AS meta_year_ok, count(*) FILTER (found AND m_lang = 'en') AS meta_in_field,
 count(*) FILTER (found AND m_quality >= 1 AND m_lang = 'en') AS meta_year_ok_and_in_field, count(*) FILTER (found AND m_toxic = 0) AS meta_has_abstract FROM outcomes WHERE looked_up GROUP BY shard""",
)
def corpus_marginals(spark, d):
    return C.marginals(outcomes(spark, d), FILTERS)


@query("length_percentiles", "SELECT lang, " + ", ".join(f"quantile_cont(n_chars, {q}) AS {n}" for q, n in ((0.0, "min"), (0.1, "p10"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.9, "p90"), (1.0, "max"))) + ", avg(n_chars) AS mean FROM documents GROUP BY lang")
def length_percentiles(spark, d):
    return C.percentiles(docs(spark, d), F.col("n_chars"), ["lang"])


@query("lang_histogram", "SELECT lang, count(*) AS n, min(doc_id) AS first_pos FROM documents GROUP BY lang")
def lang_histogram(spark, d):
    return C.histogram(docs(spark, d), F.col("lang"), F.col("doc_id"), "lang")


@query("top_sources", "SELECT source, count(*) AS n, min(doc_id) AS first_pos FROM documents GROUP BY source ORDER BY n DESC, first_pos LIMIT 15")
def top_sources(spark, d):
    return C.top_values(docs(spark, d), F.col("source"), F.col("doc_id"), 15, "source")


@query("multi_value_histogram", "SELECT value, count(*) AS n, min(conv_id) AS first_pos FROM (SELECT conv_id, unnest(list_distinct(list(role))) AS value FROM conversations GROUP BY conv_id) GROUP BY value")
def multi_value_histogram(spark, d):
    roles = V.table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return C.histogram(roles.select("conv_id", F.explode("roles").alias("role")), F.col("role"), F.col("conv_id"))


@query("only_field", "SELECT count(*) FILTER (roles = ['user']) AS only_user, count(*) AS n FROM (SELECT list_sort(list_distinct(list(role))) AS roles FROM conversations GROUP BY conv_id)")
def only_field(spark, d):
    roles = V.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    return roles.agg(F.count_if(F.col("roles") == F.array(F.lit("user"))).alias("only_user"), F.count("*").alias("n"))


TITLE = r"trim(regexp_replace(lower(split_part(coalesce(text, ''), chr(10), 1)), '[^a-z0-9]+', ' ', 'g'))"


@query("duplicate_titles", f"SELECT {TITLE} AS title, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1 AND {TITLE} <> ''")
def duplicate_titles(spark, d):
    return C.duplicate_titles(docs(spark, d), F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)))


def word_list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


WORDS = rf"""w AS (SELECT doc_id, text, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_\p{{M}}]+'), lambda x: NOT regexp_full_match(x, '\p{{Nd}}+')) AS words FROM documents),
hits AS (SELECT doc_id, text, CAST(len(words) AS INT) AS n_words, CAST(len(list_filter(words, lambda x: list_contains({word_list(T.ENGLISH_WORDS)}, x))) AS INT) AS n_english, CAST(len(list_filter(words, lambda x: list_contains({word_list(T.OTHER_WORDS)}, x))) AS INT) AS n_other FROM w)"""


@query("function_word_ratio", f"WITH {WORDS} SELECT doc_id, n_words, n_english, n_other FROM hits")
def function_word_ratio(spark, d):
    w = docs(spark, d).select("doc_id", T.words(F.coalesce("text", F.lit(""))).alias("w"))
    return w.select("doc_id", F.size("w").alias("n_words"), T.word_hits(F.col("w"), T.ENGLISH_WORDS).alias("n_english"), T.word_hits(F.col("w"), T.OTHER_WORDS).alias("n_other"))


LETTERS = r"length(regexp_replace(coalesce(text, ''), '[^\p{L}]', '', 'g'))"
ASCII = "length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'))"


@query("non_english", f"WITH {WORDS} SELECT doc_id, n_other > n_english OR n_words = 0 OR n_english / n_words < 0.12 OR {LETTERS} = 0 OR {ASCII} / {LETTERS} < 0.9 AS non_english FROM hits")
def non_english(spark, d):
    return C.quality_flags(docs(spark, d).select("doc_id", "text"), F.coalesce("text", F.lit("")), most=None, start=None).select("doc_id", "non_english")


@query("alpha_share", f"SELECT doc_id, CAST({LETTERS} AS INT) AS letters, CASE WHEN length(coalesce(text, '')) = 0 THEN 0.0 ELSE {LETTERS} / length(text) END AS alpha_share FROM documents")
def alpha_share(spark, d):
    t = F.coalesce("text", F.lit(""))
    return docs(spark, d).select("doc_id", T.letters(t).alias("letters"), T.alpha_share(t).alias("alpha_share"))


@query("ascii_letter_share", f"SELECT doc_id, CASE WHEN {LETTERS} = 0 THEN 0.0 ELSE {ASCII} / {LETTERS} END AS ascii_letter_share FROM documents")
def ascii_letter_share(spark, d):
    return docs(spark, d).select("doc_id", T.ascii_letter_share(F.coalesce("text", F.lit(""))).alias("ascii_letter_share"))


@query("lowercase_start", r"SELECT doc_id FROM documents WHERE regexp_matches(coalesce(text, ''), '^\s*\p{Ll}')")
def lowercase_start(spark, d):
    return docs(spark, d).where(T.starts_lowercase(F.coalesce("text", F.lit("")))).select("doc_id")


SQUASH = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"


@query("abstract_repeat", f"WITH t AS (SELECT doc_id, substr({SQUASH.format(chr(39) * 0 + 'split_part(coalesce(text, ' + chr(39) * 2 + '), chr(10), 1)')}, 1, 150) AS a, {SQUASH.format('substr(coalesce(text, ' + chr(39) * 2 + '), 1 + length(split_part(coalesce(text, ' + chr(39) * 2 + '), chr(10), 1)))')} AS b FROM documents) SELECT doc_id FROM t WHERE length(a) >= 50 AND contains(b, a)")
def abstract_repeat(spark, d):
    """The first line stands for the abstract, the rest for the body."""
    t = F.coalesce("text", F.lit(""))
    first = F.split_part(t, F.lit("\n"), F.lit(1))
    rest = F.substr(t, F.char_length(first) + 1)
    return docs(spark, d).where(C.abstract_repeated(first, rest, window=None)).select("doc_id")


@query("containment_probe", f"SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains({SQUASH.format('d.text')}, {SQUASH.format('b.text')})")
def containment_probe(spark, d):
    items = V.table(spark, d, "benchmark").select("item_id", F.col("text").alias("item"))
    return C.containment(docs(spark, d).select("doc_id", "text"), items).select("doc_id", "item_id")


@query("distinct_4gram", r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents), g AS (SELECT doc_id, CASE WHEN len(w) >= 23 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END AS g FROM w) SELECT doc_id, len(list_distinct(g)) / len(g) AS distinct_share FROM g")
def distinct_4gram(spark, d):
    return docs(spark, d).select("doc_id", T.distinct_ngram_ratio(F.coalesce("text", F.lit(""))).alias("distinct_share"))


@query(
    "select_papers",
    """WITH t AS (SELECT doc_id, source || '/' || lang AS raw, length(concat('Title: ', source, chr(10), chr(10), 'Abstract: ', lang, chr(10), chr(10), coalesce(text, ''))) AS text_chars FROM documents),
p AS (SELECT *, replace(raw, '/', '_') AS paper_id, row_number() OVER (PARTITION BY replace(raw, '/', '_') ORDER BY doc_id) AS nth FROM t) SELECT doc_id, paper_id, CAST(text_chars AS INT) AS text_chars FROM p WHERE nth = 1 AND doc_id >= 5 AND text_chars >= 300 ORDER BY doc_id LIMIT 40""",
)
def select_papers(spark, d):
    """One paper per source and language, from the fifth record on, forty at most: offset and limit are the feature."""
    raw = F.concat_ws("/", "source", "lang")
    out = C.select_papers(docs(spark, d), "doc_id", raw, C.paper_text(F.col("source"), F.col("lang"), F.col("text")), offset=5, limit=40, min_chars=300)
    return out.select("doc_id", "paper_id", "text_chars")


# ------------------------------------------------------------------------------------------------ transcripts, URLs, events
@query("transcript_pairs", "WITH w AS (SELECT conv_id, turn, role, text, lag(role) OVER w AS before, lag(text) OVER w AS asked FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, length(asked) AS asked_chars, length(text) AS answer_chars FROM w WHERE role = 'assistant' AND before = 'user'")
def transcript_pairs(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = V.table(spark, d, "conversations").withColumn("before", F.lag("role").over(w)).withColumn("asked", F.lag("text").over(w))
    return c.where("role = 'assistant' AND before = 'user'").select("conv_id", "turn", F.char_length("asked").cast("long").alias("asked_chars"), F.char_length("text").cast("long").alias("answer_chars"))


@query(
    "context_elision",
    """WITH c AS (SELECT conv_id, turn, role, length(coalesce(text, '')) AS chars FROM conversations), t AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id) AS total,
 count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS newer FROM c),
s AS (SELECT *, CASE WHEN role = 'assistant' AND newer > 1 THEN greatest(chars - 50, 0) ELSE 0 END AS saves FROM t),
b AS (SELECT *, coalesce(sum(saves) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT conv_id, turn, saves > 0 AND total - before > 600 AS elided FROM b""",
)
def context_elision(spark, d):
    c = V.table(spark, d, "conversations")
    return R.elided(c, "conv_id", "turn", "role", F.char_length(F.coalesce("text", F.lit(""))), keep=1, budget=600, eligible_role="assistant").select("conv_id", "turn", "elided")


@query("prompt_estimate", "WITH c AS (SELECT conv_id, turn, length(coalesce(text, '')) AS chars FROM conversations) SELECT conv_id, turn, coalesce(sum(chars) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 4.0 AS prompt_tokens FROM c")
def prompt_estimate(spark, d):
    c = V.table(spark, d, "conversations")
    return R.prompt_estimate(c, "conv_id", "turn", F.char_length(F.coalesce("text", F.lit(""))), F.lit(None).cast("long")).select("conv_id", "turn", F.col("prompt_tokens").cast("double").alias("prompt_tokens"))


@query("url_basename", r"SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*(?:/.*)?/([^/]*)$|^', 1) AS basename FROM pages")
def url_basename(spark, d):
    return V.table(spark, d, "pages").select("page_id", T.url_basename(F.col("url")).alias("basename"))


@query("metric_delta", "WITH s AS (SELECT event_type AS metric, sum(user_id) FILTER (event_id % 2 = 0) AS b, sum(user_id) AS a FROM events GROUP BY event_type) SELECT metric || '_total' AS metric, CAST(a - coalesce(b, 0) AS DOUBLE) AS delta FROM s WHERE a <> coalesce(b, 0)")
def metric_delta(spark, d):
    """Counters after all events, and after those with even numbers, through the text exposition format."""
    e = V.table(spark, d, "events")
    lines = lambda rows: rows.select(F.format_string('app:%s_total{user="u"} %d', "event_type", "user_id").alias("value"))
    change = B.deltas(B.scrape(lines(e.where("event_id % 2 = 0")), "app:"), B.scrape(lines(e), "app:"))
    return change.select(F.regexp_replace("metric", "^app:", "").alias("metric"), "delta")


@query("value_distribution", "SELECT event_type, quantile_cont(user_id, 0.5) AS p50, quantile_cont(user_id, 0.95) AS p95, avg(user_id) AS mean, CAST(min(user_id) AS BIGINT) AS min, CAST(max(user_id) AS BIGINT) AS max FROM events GROUP BY event_type")
def value_distribution(spark, d):
    return B.distribution(V.table(spark, d, "events"), F.col("user_id"), ["event_type"])


@query("event_progress", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS user_sum FROM events GROUP BY ALL")
def event_progress(spark, d):
    return L.progress(V.table(spark, d, "events"))


# ------------------------------------------------------------------------------------------------ records out of model text
def candidate_json(spark, d):
    """A candidate per order as JSON, with its rubric in line order."""
    item = F.struct("pos", "weight", F.struct(F.concat(F.lit("criterion "), "pos").alias("criterion"), "weight"))
    g = V.rubric(spark, d).groupBy("candidate").agg(F.array_sort(F.collect_list(item.alias("i"))).alias("r"))
    return g.select("candidate", F.to_json(F.struct(F.concat(F.lit("context "), "candidate").alias("context"), F.concat(F.lit("question "), "candidate").alias("question"), F.transform("r", lambda x: x["col3"]).alias("rubric"))).alias("json"))


@query("json_extract", "SELECT DISTINCT l_orderkey AS candidate, 'question ' || l_orderkey AS question, count(*) OVER (PARTITION BY l_orderkey) AS n_items FROM lineitem")
def json_extract(spark, d):
    """Candidates out of chatty text: an earlier object, a fence, braces in strings."""
    chat = F.concat(F.lit('Draft: {"question": "old {"}\nFinal:\n```json\n'), "json", F.lit("\n```\nDone."))
    got = candidate_json(spark, d).select("candidate", X.parse_candidate(chat).alias("c"))
    return got.select("candidate", "c.candidate.question", F.size(F.from_json("c.rubric", "array<struct<criterion:string,weight:int>>")).cast("long").alias("n_items"))


@query("rubric_parse", f"WITH {V.RUBRIC} SELECT candidate, CASE WHEN max(weight) > 0 THEN count(*) END AS n_items, CASE WHEN max(weight) > 0 THEN CAST(sum(weight) AS BIGINT) END AS total, max(weight) <= 0 AS failed FROM rubric GROUP BY candidate")
def rubric_parse(spark, d):
    p = candidate_json(spark, d).select("candidate", H.parse_rubric(F.get_json_object("json", "$.rubric")).alias("p"))
    total = F.aggregate("p.items", F.lit(0).cast("long"), lambda a, i: a + i["weight"])
    return p.select("candidate", F.when(F.col("p.items").isNotNull(), F.size("p.items").cast("long")).alias("n_items"), total.alias("total"), F.col("p.error").isNotNull().alias("failed"))


@query("judgment_parse", f"WITH {V.MARKS} SELECT candidate, role, attempt, string_agg(CAST(satisfied AS VARCHAR), ',' ORDER BY pos, weight, satisfied) AS marks FROM marks GROUP BY ALL")
def judgment_parse(spark, d):
    """Judgments as a judge writes them, entries in any order, read back in criterion order."""
    m = V.marks(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("candidate", "role", "attempt").orderBy("pos", "weight", "satisfied")))
    entry = F.struct(F.col("i").alias("index"), "satisfied", F.lit("seen").alias("evidence"))
    g = m.groupBy("candidate", "role", "attempt").agg(F.collect_list(entry).alias("criteria"), F.count("*").alias("n"))
    said = F.concat(F.lit("Verdict follows.\n"), F.to_json(F.struct("criteria")))
    return g.select("candidate", "role", "attempt", X.parse_judgments(said, F.col("n")).alias("p")).select("candidate", "role", "attempt", F.array_join(F.transform("p.satisfied", lambda s: s.cast("string")), ",").alias("marks"))


@query("qv_parse", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 > 1 THEN o_orderstatus <> 'P' AND o_custkey % 3 <> 0 END AS overall, o_orderkey % 10 > 1 AND o_orderstatus <> 'P' AND o_custkey % 3 = 0 AS contradiction, 0 AS n_missing FROM orders")
def qv_parse(spark, d):
    lines = F.concat(
        F.lit("- **CHECK_1_VERDICT:** NO_LEAKAGE\nCHECK_2_VERDICT: GOOD\n3. CHECK_3_VERDICT: "),
        F.when(F.col("o_custkey") % 3 == 0, "FAIL").otherwise("PASS"),
        F.lit("\nCHECK_4_VERDICT: CONSISTENT\nOVERALL: PASS | FAIL\nOVERALL: "),
        F.when(F.col("o_orderstatus") == "P", "FAIL").otherwise("PASS"),
        F.lit("\nFEEDBACK: none"),
    )
    said = F.when(F.col("o_orderkey") % 10 > 1, lines).when(F.col("o_orderkey") % 10 == 1, "")  # some say nothing
    v = V.table(spark, d, "orders").select("o_orderkey", X.qv_lines(said).alias("l")).select("o_orderkey", X.qv_verdict(F.col("l")).alias("v"))
    return v.select("o_orderkey", "v.overall", "v.contradiction", F.size("v.missing_checks").alias("n_missing"))


@query("strip_reasoning", "SELECT conv_id, turn, trim(coalesce(text, '')) AS answer, CAST(1 AS INT) AS n_blocks FROM conversations")
def strip_reasoning(spark, d):
    said = F.concat(F.lit("<think>first { thoughts"), "turn", F.lit("</think>"), F.coalesce("text", F.lit("")))
    return V.table(spark, d, "conversations").select("conv_id", "turn", F.trim(T.strip_reasoning(said)).alias("answer"), F.size(T.reasoning_blocks(said)).alias("n_blocks"))


CANONICAL = """'{"context":"context ' || candidate || '","question":"question ' || candidate || '","rubric":[' || string_agg('{"category":"' || CASE WHEN weight > 0 THEN 'positive' ELSE 'negative' END || '","criterion":"criterion ' || pos || '","weight":' || weight || '}', ',' ORDER BY pos, weight) || ']}'"""


@query("question_hash", f"WITH {V.RUBRIC} SELECT candidate, CASE WHEN max(weight) > 0 THEN sha1({CANONICAL}) END AS question_hash FROM rubric GROUP BY candidate")
def question_hash(spark, d):
    """A rubric without a positive weight cannot be scored, so its candidate has no canonical identity."""
    return candidate_json(spark, d).select("candidate", X.question_hash("json").alias("question_hash"))


@query("attempt_seed", f"WITH {V.MARKS} SELECT DISTINCT candidate, role, attempt, CAST(('0x' || substr(sha1('17|' || sha1(CAST(candidate AS VARCHAR)) || '|' || role || '|' || attempt), 1, 8)) AS BIGINT) & 2147483647 AS seed FROM marks")
def attempt_seed(spark, d):
    a = V.attempts(spark, d)
    return a.select("candidate", "role", "attempt", T.attempt_seed(F.lit(17), F.sha1(F.col("candidate").cast("string")), F.col("role"), F.col("attempt")).alias("seed"))


@query("judge_prompt", f"WITH {V.RUBRIC}, o AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY pos, weight) AS i FROM rubric) SELECT candidate, string_agg(i || '. [' || CASE WHEN weight > 0 THEN '+' ELSE '' END || weight || CASE WHEN weight > 0 THEN ' positive' ELSE ' negative' END || '] criterion ' || pos, chr(10) ORDER BY i) AS prompt FROM o GROUP BY candidate")
def judge_prompt(spark, d):
    c = F.struct("pos", "weight", F.concat(F.lit("criterion "), "pos").alias("criterion"), F.when(F.col("weight") > 0, "positive").otherwise("negative").alias("category"))
    g = V.rubric(spark, d).groupBy("candidate").agg(F.array_sort(F.collect_list(c)).alias("r"))
    return g.select("candidate", M.criteria_lines(F.col("r")).alias("prompt"))


@query("completion_parse", "SELECT event_id, event_type AS content, CAST(json_extract(props, '$.k') AS BIGINT) AS tokens, event_type = 'click' AS has_call FROM events")
def completion_parse(spark, d):
    """Chat completions written and flattened again."""
    call = F.when(F.col("event_type") == "click", F.array(F.struct(F.lit("c1").alias("id"), F.struct(F.lit("read").alias("name"), F.lit("{bad").alias("arguments")).alias("function"))))
    message = F.struct(F.col("event_type").alias("content"), call.alias("tool_calls"))
    said = F.to_json(F.struct(F.array(F.struct(message.alias("message"), F.lit("stop").alias("finish_reason"))).alias("choices"), F.struct(F.get_json_object("props", "$.k").cast("long").alias("completion_tokens")).alias("usage")))
    e = V.table(spark, d, "events").select("event_id", M.flattened(said).alias("f"))
    return e.select("event_id", "f.content", F.col("f.usage")["completion_tokens"].alias("tokens"), (F.size("f.tool_calls") > 0).alias("has_call"))


@query("paper_summary", f"WITH {V.ROUNDS} SELECT paper, count(*) AS n_rounds, min(CASE WHEN failure_mode = 'ACCEPTED' THEN round END) AS accepted_round, string_agg(failure_mode, ',' ORDER BY round) AS modes, bool_or(failure_mode = 'ACCEPTED') AS accepted FROM rounds GROUP BY paper")
def paper_summary(spark, d):
    s = M.paper_summaries(V.rounds(spark, d))
    return s.select("paper", "n_rounds", "accepted_round", F.array_join("rounds.failure_mode", ",").alias("modes"), "accepted")


@query("lookup_batches", f"WITH {OUTCOMES} SELECT doc_id, CAST(floor((greatest(sum(CASE WHEN looked_up THEN 1 ELSE 0 END) OVER (PARTITION BY shard ORDER BY line), 1) - 1) / 10) AS BIGINT) AS batch FROM outcomes")
def lookup_batches(spark, d):
    return M.micro_batches(outcomes(spark, d), "shard", ["line"], F.col("looked_up"), 10).select("doc_id", "batch")


@query("resume_violations", "WITH v AS (SELECT doc_id, unnest((CASE WHEN lang <> 'en' THEN ['not_in_field'] ELSE [] END) || (CASE WHEN length(coalesce(text, '')) < 400 THEN ['body_too_short'] WHEN length(coalesce(text, '')) > 8000 THEN ['body_too_long'] ELSE [] END) || (CASE WHEN CAST(substr(source, 4, 10) AS INT) >= 10 THEN ['shard'] ELSE [] END)) AS reason FROM documents) SELECT reason, count(*) AS n, list_min(list(doc_id)) AS first_id FROM v GROUP BY reason")
def resume_violations(spark, d):
    stored = docs(spark, d).select(F.col("doc_id").alias("paper_id"), F.col("text").alias("body_text"), F.lit(2020).alias("year"), F.array("lang").alias("s2_fields"), F.lit("abstract").alias("abstract"), F.lit("r1").alias("release_id"), F.substring("source", 4, 10).cast("int").alias("shard"))
    bad = C.resume_violations(stored, FILTERS, "r1", list(range(10)))
    return bad.select("reason", "n", F.get("examples", 0).alias("first_id"))


@query("changed_texts", "SELECT doc_id AS paper, sha1(coalesce(text, '')) AS text_sha1 FROM documents WHERE doc_id % 3 = 0 OR lang = 'fr'")
def changed_texts(spark, d):
    """Against a stored state in which French texts differ and every third paper is missing."""
    now = docs(spark, d).select(F.col("doc_id").alias("paper"), F.coalesce("text", F.lit("")).alias("text"), "lang")
    stored = now.where("paper % 3 <> 0").select("paper", F.when(F.col("lang") == "fr", "old").otherwise(F.sha1("text")).alias("text_sha1"))
    return N.changed_texts(now, stored)


@query("provenance_problems", "SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus <> 'F' THEN 'o_orderstatus' END, CASE WHEN o_custkey % 5 <> 0 THEN 'm' END) AS problems FROM orders")
def provenance_problems(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_custkey") % 5).cast("long").alias("m"))
    expected = o.select("o_orderkey", F.lit("F").alias("o_orderstatus"), F.lit(0).cast("long").alias("m"))
    return N.report_problems(o, expected, "o_orderkey", ["o_orderstatus", "m"]).select("o_orderkey", F.array_join("problems", ",").alias("problems"))


@query("next_run", "SELECT o_custkey AS paper, count(*) + 1 AS next_run FROM orders GROUP BY o_custkey")
def next_run(spark, d):
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    runs_so_far = V.table(spark, d, "orders").select(F.col("o_custkey").alias("paper"), nth.cast("long").alias("run_no"))
    return N.next_run(runs_so_far, "paper").select("paper", "next_run")


@query("evaluation_pairs", f"WITH {V.ROUNDS}, e AS (SELECT paper, max(round) AS last, max(round) FILTER (qv_passed) AS last_passed FROM rounds GROUP BY paper) SELECT paper, last AS strong_seq, last AS weak_seq FROM e")
def evaluation_pairs(spark, d):
    """Every round's combined evaluation within one list per paper: the last is both the strong and the weak one."""
    e = V.rounds(spark, d).select("paper", F.lit(1).alias("round"), F.col("round").alias("seq"), F.lit("both").alias("mode"), F.col("candidate").alias("question_hash"), F.lit(True).alias("has_report"))
    return R.paired_evaluations(e).select("paper", F.col("strong.seq").alias("strong_seq"), F.col("weak.seq").alias("weak_seq"))


@query("resume_done", f"WITH {RUNS} SELECT paper, (accepted AND n_rounds % 2 = 0) OR (completed AND n_rounds % 3 <> 0) AS done FROM runs")
def resume_done(spark, d):
    r = runs(spark, d)
    errors = F.array().cast("array<string>")
    stop = F.when(F.col("n_rounds") % 3 == 0, "crashed").otherwise("final")
    return r.select("paper", N.agentic_done(F.col("accepted"), F.col("n_rounds") % 2 == 0, F.col("completed"), errors, stop).alias("done"))
