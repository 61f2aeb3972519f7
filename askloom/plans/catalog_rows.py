"""Queries of row-level functions, predicates, joins and entry points that the main catalogue does not run."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import api
from ..functions import extract as X
from ..functions import paths as P
from ..functions import text as T
from ..operators import bench as B
from ..operators import corpus as C
from ..operators import manifest as J
from ..operators import messages as M
from ..operators import rounds as R
from ..operators import rubric as H
from ..operators import runs as N
from ..operators import stats as S
from ..streaming import loop as L
from . import views as V
from .catalog import FILTERS, OUTCOMES, docs, outcomes, query, records, runs

TEXT = "coalesce(text, '')"
one_line = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def orders(spark, d):
    return V.table(spark, d, "orders")


# ------------------------------------------------------------------------------------------------ records
@query("record_build", f"SELECT doc_id, CASE WHEN lang = 'en' THEN 'Api ' || source ELSE 'shard ' || lang END AS title, 'abs ' || lang AS abstract, CAST(2000 + doc_id % 20 AS INT) AS year, CASE WHEN doc_id % 3 = 0 THEN 'doi=a' || doc_id ELSE 'arxiv=b' END AS ids, length({TEXT}) AS n_body_chars FROM documents")
def record_build(spark, d):
    t = docs(spark, d)
    api_title = F.when(F.col("lang") == "en", F.concat(F.lit("  Api\n"), "source")).when(F.col("doc_id") % 2 == 0, " \t")
    api_ids = F.create_map(F.lit("doi"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("a"), "doc_id")), F.lit("mag"), F.lit(""))
    shard_ids = F.create_map(F.lit("arxiv"), F.lit("b"), F.lit("pmid"), F.lit(None).cast("string"))
    r = C.build_record(api_title, F.concat(F.lit("shard  "), "lang"), F.concat(F.lit("\n abs "), "lang", F.lit(" ")), 2000 + F.col("doc_id") % 20, F.col("text"), api_ids, shard_ids)
    ids = F.array_join(F.transform(F.map_entries("r.external_ids"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return t.select("doc_id", r.alias("r")).select("doc_id", "r.title", "r.abstract", "r.year", ids.alias("ids"), F.col("r.n_body_chars").cast("long").alias("n_body_chars"))


@query("slim_records", "SELECT event_id, CAST(event_id AS VARCHAR) AS corpusid, '\"' || event_type || '\"' AS title, '{\"doi\":\"' || user_id || '\"}' AS externalids, CAST(NULL AS VARCHAR) AS authors FROM events")
def slim_records(spark, d):
    e = V.table(spark, d, "events")
    record = F.to_json(F.struct(F.col("event_id").alias("corpusid"), F.col("event_type").alias("title"), F.struct(F.struct(F.col("user_id").cast("string").alias("doi")).alias("externalids"), F.lit(1).alias("dropped")).alias("openaccessinfo"), F.col("props").alias("more")))
    return e.select("event_id", C.slim(F.parse_json(record)).alias("s")).select("event_id", "s.corpusid", "s.title", "s.externalids", "s.authors")


@query("author_names", "SELECT c_custkey, 'A ' || c_name || '; N' || c_nationkey || '; F M X ' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '; Solo' ELSE '' END AS names FROM customer")
def author_names(spark, d):
    """Strings and objects in one array; numbers, blanks and nulls are no names."""
    text = F.format_string('["  A \\n%s ", {"name": "N%d", "first": "no"}, {"first": "F", "middle": ["M", "X"], "last": "%s"}, 3, "", {"name": ""}, null%s]', "c_name", "c_nationkey", "c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, ', {"last": " Solo"}').otherwise(""))
    return V.table(spark, d, "customer").select("c_custkey", F.array_join(C.author_names(F.parse_json(F.regexp_replace(text, "\n", "\\\\n"))), "; ").alias("names"))


@query("field_categories", "SELECT conv_id, string_agg(role, ',' ORDER BY first) AS categories FROM (SELECT conv_id, role, min(turn) AS first FROM conversations WHERE role <> '' GROUP BY ALL) GROUP BY conv_id")
def field_categories(spark, d):
    """Distinct categories in the order they first appear."""
    c = V.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("category")))).alias("f"))
    return c.select("conv_id", F.array_join(C.field_categories(F.concat(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("").alias("category"))), "f")), ",").alias("categories"))


@query("external_ids", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'api' ELSE 'shard' END AS origin, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS n FROM events")
def external_ids(spark, d):
    even = F.col("event_id") % 2 == 0
    ids = C.external_ids(F.create_map(F.lit("a"), F.when(even, "api").otherwise(""), F.lit("b"), F.lit(None).cast("string")), F.create_map(F.lit("c"), F.lit("shard"), F.lit("d"), F.lit("x"), F.lit("e"), F.lit("")))
    e = V.table(spark, d, "events").select("event_id", ids.alias("i"))
    return e.select("event_id", F.get(F.map_values("i"), 0).alias("origin"), F.size("i").alias("n"))


KINDS = ["%d", '"%d"', '" %d "', "true", "null", '"x%d"', "1.5", "[%d]"]


@query("id_cast", "SELECT event_id, CASE WHEN event_id % 8 IN (0, 1, 2) THEN event_id WHEN event_id % 8 = 6 THEN 1 END AS id FROM events")
def id_cast(spark, d):
    """Numbers (cut to integers) and strings of an integer are ids; booleans, nulls, other strings and lists are none."""
    raw = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("event_id") % 8 + 1).cast("int"))
    return V.table(spark, d, "events").select("event_id", C.parse_id(F.parse_json(F.replace(raw, F.lit("%d"), F.col("event_id").cast("string")))).alias("id"))


@query("weights_in_spec", f"WITH {V.RUBRIC} SELECT candidate, bool_and(abs(weight * 2 - 5) BETWEEN 1 AND 10) AS fine FROM rubric GROUP BY candidate UNION ALL SELECT -1, false")
def weights_in_spec(spark, d):
    g = V.rubric(spark, d).groupBy("candidate").agg(F.collect_list(F.col("weight") * 2 - 5).alias("w"))
    g = g.unionByName(spark.createDataFrame([(-1, [])], "candidate long, w array<int>"))
    return g.select("candidate", H.weights_in_bounds(F.col("w")).alias("fine"))


CLAIM = OUTCOMES[: OUTCOMES.index("local AS")].rstrip().rstrip(",")


@query("already_built", f"WITH {CLAIM}, known AS (SELECT DISTINCT cid FROM r WHERE doc_id % 4 = 0) SELECT doc_id, CASE WHEN cid IN (SELECT cid FROM known) THEN 'already_in_output' WHEN (shard, line) > claimed THEN 'duplicate' ELSE body END AS outcome FROM claim")
def already_built(spark, d):
    """Records whose id an earlier output has are told apart before anything else."""
    r = records(spark, d)
    return C.classify(r, FILTERS, r.where("doc_id % 4 = 0").select("corpus_id")).select("doc_id", "outcome")


@query("wanted_papers", "SELECT o_orderkey, replace(o_orderpriority, ' ', '_') || '_' || o_orderkey AS paper_id FROM orders WHERE o_orderkey % 5 IN (0, 1)")
def wanted_papers(spark, d):
    """Ids asked for in their clean or in their raw form."""
    raw = F.concat_ws("/", F.col("o_orderpriority"), F.col("o_orderkey"))
    clean = T.safe_id(raw)
    o = orders(spark, d)
    wanted = o.where("o_orderkey % 5 = 0").select(clean.alias("paper_id")).union(o.where("o_orderkey % 5 = 1").select(raw.alias("paper_id"))).union(o.where("o_orderkey % 10 = 5").select(raw.alias("paper_id")))
    return C.select_papers(o, "o_orderkey", raw, F.lit("text"), wanted=wanted).select("o_orderkey", "paper_id")


@query("corpus_prefix", f"WITH {OUTCOMES} SELECT doc_id FROM outcomes WHERE outcome = 'kept' ORDER BY shard, line LIMIT 25")
def corpus_prefix(spark, d):
    """A smaller corpus is the beginning of a larger one: of the first sixty records those that the first twenty-five hold."""
    o = outcomes(spark, d)
    small, large = (C.cut_at(o, n).where("outcome = 'kept'").select("doc_id") for n in (25, 60))
    return large.join(small, "doc_id", "left_semi").unionByName(small.join(large, "doc_id", "left_anti"))


@query("corpus_entry", f"WITH {OUTCOMES}, k AS (SELECT doc_id, shard, line FROM outcomes WHERE outcome = 'kept' ORDER BY shard, line LIMIT 40) SELECT shard, count(*) AS n, min(doc_id) AS first FROM k GROUP BY shard")
def corpus_entry(spark, d):
    r = records(spark, d)
    meta = r.join(V.table(spark, d, "labels"), "doc_id").groupBy("corpus_id").agg(F.min_by(F.struct("lang", "quality", "toxic"), "doc_id").alias("m"))
    meta = meta.select("corpus_id", (F.lit(1999) + F.col("m.quality")).alias("year"), F.array("m.lang").alias("fields"), F.when(F.col("m.toxic") == 0, "abstract").otherwise(" ").alias("abstract"))
    kept, _ = api.build_corpus(r, meta, FILTERS, 40)
    return kept.groupBy("shard").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


P_FLAGS = ["non_english", "non_english_start", "low_alpha", "lowercase_start", "abstract_repeated"]
P_TOKENS = r"list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_\p{{M}}]+'), lambda x: NOT regexp_full_match(x, '\p{{Nd}}+'))"
P_SHARE = "CASE WHEN len({0}) = 0 THEN 0 ELSE len(list_filter({0}, lambda x: list_contains({1}, x))) / len({0}) END"
P_LETTERS, P_ASCII = r"length(regexp_replace(body, '[^\p{L}]', '', 'g'))", "length(regexp_replace(body, '[^A-Za-z]', '', 'g'))"
# Written out here, so that the lists are compared and not only used twice.
P_EN = "['the','of','and','to','is','for','that','with','on','are','by','this','be','from','which','we','our','these','was','were','has','have','been','it','its','an','or','can']"
P_OTHER = "['de','la','le','les','des','el','los','las','en','que','del','da','das','dos','para','um','uma','não','une','est','dans','pour','sur','und','ist','mit','zu','nicht','het','een','il','di','che','della']"
P_MARKS = [
    ("'count'", "'records'", "true"), ("'count'", "'only_field'", "coalesce(fields = ['en'], false)"), ("'count'", "'empty_venue'", "coalesce(source, '') = ''"), ("'count'", "'missing_date'", "doc_id % 4 = 0"), ("'count'", "'no_authors'", "doc_id % 5 = 0"),
    ("'year'", "CAST(2000 + doc_id % 7 AS VARCHAR)", "true"), ("'shard'", "coalesce(substr(source, 4, 10), '<none>')", "true"), ("'release'", "'r' || doc_id % 3", "true"),
    ("'external_id'", "CASE WHEN doc_id % 2 = 0 THEN 'doi' ELSE 'mag' END", "true"), *[("'flag'", f"'{x}'", x) for x in P_FLAGS],
]
PROFILE = f"""t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, split_part(coalesce(text, ''), chr(10), 1) AS abstract FROM documents),
b AS (SELECT *, substr(text, 1 + length(abstract)) AS body, list_filter([lang, CASE WHEN doc_id % 6 = 1 THEN 'text' END], lambda x: x IS NOT NULL) AS fields, CASE WHEN doc_id % 50 = 1 THEN doc_id - 1 ELSE doc_id END AS corpus_id,
  trim(regexp_replace(lower(coalesce(lang, '') || ' ' || length(coalesce(text, '')) % 97), '[^a-z0-9]+', ' ', 'g')) AS title FROM t),
w AS (SELECT *, {P_TOKENS.format('body')} AS w, {P_TOKENS.format('substr(body, 1, 2000)')} AS s FROM b),
h AS (SELECT *, {P_SHARE.format('w', P_EN)} AS w_en, {P_SHARE.format('w', P_OTHER)} AS w_other, {P_SHARE.format('s', P_EN)} AS s_en, {P_SHARE.format('s', P_OTHER)} AS s_other, {P_LETTERS} AS letters, {P_ASCII} AS ascii FROM w),
g AS (SELECT *, w_other > w_en OR w_en < 0.12 OR letters = 0 OR ascii / letters < 0.9 AS non_english, CASE WHEN length(body) = 0 THEN true ELSE letters / length(body) < 0.6 END AS low_alpha, regexp_matches(body, '^\\s*\\p{{Ll}}') AS lowercase_start,
  length(substr(lower(trim(regexp_replace(abstract, '\\s+', ' ', 'g'))), 1, 150)) >= 50 AND contains(lower(trim(regexp_replace(body, '\\s+', ' ', 'g'))), substr(lower(trim(regexp_replace(abstract, '\\s+', ' ', 'g'))), 1, 150)) AS abstract_repeated FROM h),
p AS (SELECT *, NOT non_english AND s_other > s_en AS non_english_start, length(body) AS n_body_chars, 21 + length(coalesce(lang, '') || ' ' || length(text) % 97) + length(abstract) + length(body) AS paper_text_chars, length(abstract) AS abstract_chars, doc_id % 5 AS n_authors FROM g),
m AS ({' UNION ALL '.join(f"SELECT {a} AS section, {b} AS value, doc_id FROM p WHERE {c}" for a, b, c in P_MARKS)} UNION ALL SELECT 'field', unnest(fields), doc_id FROM p),
e AS (SELECT section, value, array_to_string(list_sort(list(doc_id)), ',') AS examples FROM (SELECT *, row_number() OVER (PARTITION BY value ORDER BY doc_id) AS nth FROM m WHERE section = 'flag') WHERE nth <= 10 GROUP BY section, value)
SELECT section, value, count(*) AS n, CAST(NULL AS DOUBLE) AS number, min(doc_id) AS first, any_value(examples) AS examples FROM m LEFT JOIN e USING (section, value) GROUP BY section, value
UNION ALL SELECT * FROM (SELECT 'venue', coalesce(nullif(source, ''), '<empty>') AS v, count(*) AS c, NULL, min(doc_id) AS f, NULL FROM p GROUP BY v ORDER BY c DESC, f LIMIT 15)
UNION ALL SELECT 'count', 'unique_ids', count(DISTINCT corpus_id), NULL, NULL, NULL FROM p
UNION ALL SELECT 'count', 'duplicate_ids', count(*), NULL, NULL, array_to_string(list_sort(list(corpus_id))[1:10], ',') FROM (SELECT corpus_id FROM p GROUP BY corpus_id HAVING count(*) > 1)
UNION ALL SELECT 'count', 'duplicate_titles', count(*), NULL, NULL, array_to_string(list_sort(list(title))[1:10], ',') FROM (SELECT title FROM p WHERE title <> '' GROUP BY title HAVING count(*) > 1)
{' '.join(f"UNION ALL SELECT '{x}', '{n}', count(*), {'avg(' + x + ')' if q is None else f'quantile_cont({x}, {q})'}, NULL, NULL FROM p" for x in ('n_body_chars', 'paper_text_chars', 'abstract_chars', 'n_authors') for n, q in (('mean', None), ('min', 0.0), ('p10', 0.1), ('p25', 0.25), ('p50', 0.5), ('p75', 0.75), ('p90', 0.9), ('max', 1.0)))}"""


@query("corpus_profile", f"WITH {PROFILE}")
def corpus_profile(spark, d):
    """A stored corpus in one table: counts, histograms, percentiles, quality flags of whole bodies with examples."""
    text, key = F.coalesce("text", F.lit("")), F.col("doc_id")
    head = F.split_part(text, F.lit("\n"), F.lit(1))
    rows = docs(spark, d).select(
        key.alias("place"), key.alias("paper_id"), F.when(key % 50 == 1, key - 1).otherwise(key).alias("corpus_id"), F.concat(F.coalesce("lang", F.lit("")), F.lit(" "), (F.char_length(text) % 97).cast("string")).alias("title"),
        head.alias("abstract"), F.substr(text, F.char_length(head) + 1).alias("body"), (key % 7 + 2000).alias("year"), F.substring("source", 4, 10).alias("shard"), F.concat(F.lit("r"), (key % 3).cast("string")).alias("release_id"),
        F.array_compact(F.array("lang", F.when(key % 6 == 1, "text"))).alias("fields"), F.when(key % 2 == 0, F.create_map(F.lit("doi"), F.lit("x"))).otherwise(F.create_map(F.lit("mag"), F.lit("y"))).alias("external_ids"),
        F.col("source").alias("venue"), F.when(key % 4 != 0, "2024-01-01").alias("publication_date"), F.array_repeat(F.lit("a"), (key % 5).cast("int")).alias("authors"),
    )
    found = C.profile(rows, C.Filters(field="en"), most=None, window=None)
    return found.withColumn("examples", F.array_join("examples", ","))


@query("sorted_outputs", "SELECT lang, array_to_string(list_sort(list(doc_id)), ',') AS ids FROM (SELECT * FROM documents WHERE n_chars > 3000) GROUP BY lang")
def sorted_outputs(spark, d):
    """The ids of long documents, in order, by language."""
    return docs(spark, d).where("n_chars > 3000").groupBy("lang").agg(F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("ids"))


# ------------------------------------------------------------------------------------------------ text
@query("alnum_norm", rf"SELECT doc_id, regexp_replace(lower({TEXT}), '[^a-z0-9]', '', 'g') AS alnum, lower({one_line.format(TEXT)}) AS squashed FROM documents")
def alnum_norm(spark, d):
    text = F.coalesce("text", F.lit(""))
    return docs(spark, d).select("doc_id", T.alnum(text).alias("alnum"), T.squash(text).alias("squashed"))


@query("text_norm", f"SELECT doc_id, {one_line.format(f'nfc_normalize({TEXT})')} AS norm FROM documents")
def text_norm(spark, d):
    """Documents with decomposed accents and other line ends come out as they were, on one line."""
    return docs(spark, d).select("doc_id", X.text_norm(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\r\n"))).alias("norm"))


@query("bind_norm", rf"SELECT doc_id, trim(regexp_replace(lower(nfc_normalize({TEXT})), '[^a-z0-9-]+', ' ', 'g')) AS plain FROM documents")
def bind_norm(spark, d):
    """Texts escaped as in JSON, in a prompt, read as the texts themselves."""
    text = F.coalesce("text", F.lit(""))
    escaped = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("é"), F.lit("\\u00e9"))
    both = docs(spark, d).select("doc_id", X.bind_norm(text, F.lit(False)).alias("plain"), X.bind_norm(escaped, F.lit(True)).alias("read"))
    return both.select("doc_id", F.when(F.col("plain") == F.col("read"), F.col("plain")).alias("plain"))


@query("escape_repair", r"SELECT event_id, '\\alpha ' || event_type || ' \n \\\\ ' || event_id || ' \\x \\' AS repaired FROM events")
def escape_repair(spark, d):
    raw = F.concat(F.lit(r"\alpha "), "event_type", F.lit(r" \n \\\\ "), "event_id", F.lit(" \\x \\"))
    return V.table(spark, d, "events").select("event_id", X.repair_escapes(raw).alias("repaired"))


LEGACY = """'{"context": "c ' || o_orderkey || '", "question": "q\\u00e9", "rubric": [{"weight": ' || o_custkey || ', "criterion": "' || o_orderstatus || '"}]}'"""


@query("legacy_hash", f"SELECT o_orderkey, sha1({LEGACY}) AS hash FROM orders")
def legacy_hash(spark, d):
    """The older identity: keys as they came, spaces and escapes as a default rendering has them."""
    raw = F.format_string('{"rubric":[{"weight":%d,"criterion":"%s"}],"question":"qé","context":"c %d","more":1}', "o_custkey", "o_orderstatus", "o_orderkey")
    return orders(spark, d).select("o_orderkey", X.legacy_question_hash(raw).alias("hash"))


@query("fingerprints", "SELECT page_id, substr(sha1(url), 1, 16) AS config, sha1(html) AS file FROM pages")
def fingerprints(spark, d):
    return V.table(spark, d, "pages").select("page_id", T.fingerprint(F.col("url")).alias("config"), F.sha1("html").alias("file"))


@query("percent_text", "SELECT l_orderkey, l_linenumber, l_partkey, printf('%.1f%%', l_partkey / 9973.0 * 100) AS shown FROM lineitem")
def percent_text(spark, d):
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.percent(F.col("l_partkey") / 9973.0).alias("shown"))


@query("message_chars", f"SELECT conv_id, turn, length({TEXT}) + CASE WHEN turn % 2 = 0 THEN 0 ELSE length(role) END + CASE WHEN turn % 3 = 0 THEN 0 ELSE 4 END AS chars FROM conversations")
def message_chars(spark, d):
    """Content, reasoning unless it repeats the content, and tool arguments."""
    text = F.coalesce("text", F.lit(""))
    reasoning = F.when(F.col("turn") % 2 == 0, text).otherwise(F.col("role"))
    return V.table(spark, d, "conversations").select("conv_id", "turn", T.message_chars(text, reasoning, F.when(F.col("turn") % 3 != 0, '{"a}')).cast("long").alias("chars"))


@query("effort_ladder", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'low' WHEN 3 THEN 'high' ELSE 'high' END AS lower FROM events")
def effort_ladder(spark, d):
    now = F.element_at(F.array(*map(F.lit, ["Max", "high", "LOW", "other", None])), (F.col("event_id") % 5 + 1).cast("int"))
    return V.table(spark, d, "events").select("event_id", T.lower_effort(now).alias("lower"))


WAITS = "(event_id % 8) / 8.0"


@query("backoff_schedule", f"""SELECT event_id, CAST(least(60.0, pow(2, least(user_id % 9, 6)) + {WAITS}) AS DOUBLE) AS model_wait,
 CAST(greatest([5, 10, 20, 40, 80, 160][CAST(least(user_id % 9 + 1, 6) AS INT)] * (1 + 0.2 * {WAITS}), CASE WHEN event_id % 3 = 0 THEN least(user_id, 160) ELSE 0 END) AS DOUBLE) AS service_wait FROM events""")
def backoff_schedule(spark, d):
    """Waits after failed tries, with the jitter given; what the service asks for counts where it is longer."""
    jitter = (F.col("event_id") % 8) / 8.0
    asked = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), "user_id")).when(F.col("event_id") % 3 == 1, "soon")
    return V.table(spark, d, "events").select("event_id", T.backoff(F.col("user_id") % 9, jitter).cast("double").alias("model_wait"), T.service_delay(F.col("user_id") % 9 + 1, jitter, asked).cast("double").alias("service_wait"))


@query("evaluator_deadline", "SELECT o_orderkey, CAST((o_custkey * (1 + o_orderkey % 3) + 60 * 3) * CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END + 300 AS DOUBLE) AS seconds FROM orders")
def evaluator_deadline(spark, d):
    mode = F.when(F.col("o_orderstatus") == "P", "both").otherwise("weak-only")
    return orders(spark, d).select("o_orderkey", T.evaluator_deadline(mode, F.col("o_custkey"), F.col("o_orderkey") % 3, F.lit(60), F.lit(2)).cast("double").alias("seconds"))


@query("error_texts", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'API request failed (HTTP ' || (400 + user_id % 200) || ')' WHEN 1 THEN 'API request failed (APITimeoutError)' ELSE 'invalid API response (KeyError)' END AS shown FROM events")
def error_texts(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ["APIStatusError", "APITimeoutError", "KeyError"])), (F.col("event_id") % 3 + 1).cast("int"))
    status = F.when(F.col("event_id") % 3 == 0, 400 + F.col("user_id") % 200)
    return V.table(spark, d, "events").select("event_id", T.error_text(kind, status).alias("shown"))


PATHS = ["/workspace/project/notes.md", "./a/../b//{n}.txt", "..//{n}", "output/{n}.py", "/etc/{n}", "/workspace/project", "eval_attempts/x/{n}", "a/./{n}/", "subagent_view", "a\\\\..\\\\.x{n}", " a/b/../../../c", "paper.txt", "output/{n}.json"]
INSIDE = ["'notes.md'", "concat('b/', user_id, '.txt')", "NULL", "concat('output/', user_id, '.py')", "NULL", "NULL", "concat('eval_attempts/x/', user_id)", "concat('a/', user_id)", "'subagent_view'", "concat('.x', user_id)", "NULL", "'paper.txt'", "concat('output/', user_id, '.json')"]


@query("agent_paths", "SELECT event_id, CASE event_id % 13 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(INSIDE)) + " END AS inside, event_id % 13 IN (0, 1, 7, 12) AS writable FROM events")
def agent_paths(spark, d):
    """Paths as agents name them: their shortest form, and whether they may be written."""
    raw = F.element_at(F.array(*map(F.lit, PATHS)), (F.col("event_id") % 13 + 1).cast("int"))
    path = F.replace(raw, F.lit("{n}"), F.col("user_id").cast("string"))
    return V.table(spark, d, "events").select("event_id", P.within(path).alias("inside"), P.writable(path).alias("writable"))


@query("retry_flags", "SELECT event_id, coalesce(event_id % 4 = 0 OR s IN (408, 409, 429) OR s >= 500, false) AS retry FROM (SELECT event_id, CASE WHEN user_id % 6 = 0 THEN NULL ELSE 400 + (user_id % 6) * 20 + event_id % 11 END AS s FROM events)")
def retry_flags(spark, d):
    status = F.when(F.col("user_id") % 6 != 0, 400 + (F.col("user_id") % 6) * 20 + F.col("event_id") % 11)
    return V.table(spark, d, "events").select("event_id", T.retryable(status, F.when(F.col("event_id") % 4 == 0, True)).alias("retry"))


# ------------------------------------------------------------------------------------------------ prompts
@query("prompt_fill", "SELECT o_orderkey, 'Question ' || o_orderkey || ' for {role} {}: ' || o_orderstatus || o_orderstatus || '.' AS prompt FROM orders")
def prompt_fill(spark, d):
    template = "Question {key} for {role} {}: {status}{status}.{none}"
    return orders(spark, d).select("o_orderkey", M.filled(template, {"key": F.col("o_orderkey").cast("string"), "role": F.lit("{role}"), "status": F.col("o_orderstatus"), "none": F.lit(None).cast("string")}).alias("prompt"))


@query(
    "criteria_texts",
    """SELECT p_partkey, 'weak_avg ' || CASE WHEN p_partkey % 2 = 0 THEN '≤' ELSE '<' END || ' ' || p_size || '%' || CASE WHEN p_partkey % 3 = 0 THEN ', max_weak ≤ ' || (p_size + 10) || '%' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN ', no zeros' ELSE '' END AS weak,
 'strong_avg ≥ ' || (p_size + 20) || '%' || CASE WHEN p_partkey % 4 = 0 THEN ' AND strong_avg < 95%' ELSE '' END AS strong, 'Gap (strong_avg - weak_avg) ≥ 20%' AS gap FROM part""",
)
def criteria_texts(spark, d):
    """Thresholds of each part as a prompt says them."""
    k, size = F.col("p_partkey"), F.col("p_size")
    weak, strong, gap = J.criteria(size, k % 2 == 0, F.when(k % 3 == 0, size + 10), k % 5 == 0, size + 20, F.when(k % 4 == 0, F.lit(95)), F.lit(20))
    return V.table(spark, d, "part").select("p_partkey", weak.alias("weak"), strong.alias("strong"), gap.alias("gap"))


@query("solver_messages", "SELECT o_orderkey, 'Context:' || chr(10) || 'c' || o_custkey || chr(10) || chr(10) || 'Question:' || chr(10) || 'q' || o_orderkey AS prompt FROM orders")
def solver_messages(spark, d):
    return orders(spark, d).select("o_orderkey", M.solver_prompt(F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("q"), "o_orderkey")).alias("prompt"))


@query("request_options", "SELECT event_id, '0.5' AS temperature, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE '2' END AS seed, '9' AS top, CASE WHEN event_id % 3 = 0 THEN 'off' ELSE 'on' END AS thinking, 'x' AS keep FROM events")
def request_options(spark, d):
    """The call's seed wins over extra options, these over the endpoint's, the nested map key by key."""
    endpoint = F.create_map(F.lit("temperature"), F.lit("1"), F.lit("seed"), F.lit("1"), F.lit("top"), F.lit("9"))
    extra = F.create_map(F.lit("temperature"), F.lit("0.5"), F.lit("seed"), F.lit("2"))
    nested = F.create_map(F.lit("thinking"), F.lit("on"), F.lit("keep"), F.lit("x"))
    more = F.create_map(F.lit("thinking"), F.when(F.col("event_id") % 3 == 0, "off"))
    r = M.request_options(endpoint, extra, nested, more, F.when(F.col("event_id") % 2 == 0, F.col("user_id")))
    e = V.table(spark, d, "events").select("event_id", r.alias("r"))
    return e.select("event_id", *[F.col("r.options")[k].alias(k) for k in ("temperature", "seed", "top")], *[F.col("r.nested")[k].alias(k) for k in ("thinking", "keep")])


@query("history_message", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END AS content, CASE WHEN event_id % 3 = 0 THEN 'why' END AS reasoning, CAST(CASE WHEN event_type = 'click' THEN 1 END AS INT) AS n_calls FROM events")
def history_message(spark, d):
    """The row that a completion adds to a history, content never null, calls only where there are some."""
    call = F.when(F.col("event_type") == "click", F.array(F.struct(F.lit("c1").alias("id"), F.struct(F.lit("read").alias("name"), F.lit("{}").alias("arguments")).alias("function"))))
    message = F.struct(F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("content"), F.when(F.col("event_id") % 3 == 0, "why").alias("reasoning_content"), call.alias("tool_calls"))
    said = F.to_json(F.struct(F.array(F.struct(message.alias("message"))).alias("choices")))
    e = V.table(spark, d, "events").select("event_id", M.history_row(M.flattened(said)).alias("h"))
    return e.select("event_id", "h.content", "h.reasoning", F.when(F.col("h.tool_calls").isNotNull(), F.size("h.tool_calls")).alias("n_calls"))


# ------------------------------------------------------------------------------------------------ runs
@query("repair_flags", "SELECT o_orderkey, o_orderstatus = 'F' AND (CASE WHEN o_custkey % 2 = 0 THEN o_custkey % 4 = 0 ELSE true END) AS last_check, o_orderkey % 2 = 0 AND (o_custkey % 3 = 0 OR o_custkey % 5 = 0 OR o_custkey % 7 = 0) AS baseline FROM orders")
def repair_flags(spark, d):
    m = lambda n: F.col("o_custkey") % n == 0
    qv = F.when(m(2), ~m(4))
    return orders(spark, d).select("o_orderkey", N.needs_final_qv(F.col("o_orderstatus") == "F", m(2), qv).alias("last_check"), N.baseline_needs_repair(F.col("o_orderkey") % 2 == 0, m(3), m(5), m(7)).alias("baseline"))


@query("previous_summaries", f"WITH {V.ROUNDS}, r AS (SELECT paper, bool_or(failure_mode = 'ACCEPTED') AS done FROM rounds GROUP BY paper) SELECT c_custkey AS paper, coalesce(done, false) AS usable, coalesce(done, false) AS done FROM customer LEFT JOIN r ON paper = c_custkey")
def previous_summaries(spark, d):
    c = V.table(spark, d, "customer").select(F.col("c_custkey").alias("paper"))
    return N.usable_previous(c, runs(spark, d), F.col("accepted"), retry_errors=True)


def refused(spark, d):
    """Every round's problems: those of the checks a and b, by its candidate's number."""
    problems = F.array_compact(F.array(F.when(F.col("candidate") % 2 == 0, "a"), F.when(F.col("candidate") % 7 == 0, "b")))
    return V.rounds(spark, d).select("paper", "round", "candidate", "qv_passed", "weak_passed", "strong_passed", "gap_passed", problems.alias("problems"), (F.col("candidate") % 5 == 0).alias("binding"))


REFUSED = f"""{V.ROUNDS}, t AS (SELECT *, max(round) OVER (PARTITION BY paper) AS last, qv_passed AND all_passed AND candidate % 7 <> 0 AND (candidate % 2 = 0 OR candidate % 5 = 0) AS q FROM rounds),
found AS (SELECT paper, round, candidate, CASE WHEN candidate % 5 = 0 THEN 'qv_binding_withdrawn' ELSE 'withdrawn_report_checks:a' END AS reason FROM t WHERE q AND round = last AND round = (SELECT min(u.round) FROM t u WHERE u.paper = t.paper AND u.q))"""


@query("withdrawn_checks", f"WITH {REFUSED} SELECT paper, round, reason FROM found")
def withdrawn_checks(spark, d):
    """Last rounds that only the withdrawn check a, or binding, refused."""
    return N.qualifying_rounds(refused(spark, d), ["a"])


@query("readjudicated", f"WITH {REFUSED}, s AS (SELECT paper, bool_or(candidate % 3 = 0) AS accepted, max(round) AS claimed FROM rounds GROUP BY paper) SELECT s.paper, s.accepted OR f.candidate % 4 <> 0 AND f.paper IS NOT NULL AS accepted, CASE WHEN NOT s.accepted AND f.candidate % 4 <> 0 THEN f.reason END AS reason, CASE WHEN NOT s.accepted AND f.candidate % 4 <> 0 THEN f.round = claimed END AS claim_matches FROM s LEFT JOIN found f ON f.paper = s.paper")
def readjudicated(spark, d):
    """Summaries after that: a report without an error about the round's candidate must bear the acceptance."""
    r = refused(spark, d)
    s = r.groupBy("paper").agg(F.bool_or(F.col("candidate") % 3 == 0).alias("accepted"), F.max("round").alias("claimed_round")).withColumn("accepted_round", F.lit(None).cast("int"))
    reports = r.select("paper", F.explode(F.array(F.lit(1), F.lit(2))).alias("run"), "candidate", F.lit(True).alias("all_passed"), F.when(F.col("candidate") % 4 == 0, "JUDGE_ERROR").alias("error"))
    return api.readjudicate(r, s, reports, ["a"]).select("paper", "accepted", "reason", "claim_matches")


@query("frozen_match", "SELECT o_orderkey, o_custkey % 3 <> 0 AND o_orderkey % 4 <> 0 AS same FROM orders")
def frozen_match(spark, d):
    """Candidates are the same if context, question and rubric are, nulls included."""
    item = lambda w: F.array(F.struct(F.lit("c").alias("criterion"), w.alias("weight")))
    one = lambda question, w: F.struct(F.lit(None).cast("string").alias("context"), question.alias("question"), item(w).alias("rubric"))
    key = F.col("o_custkey")
    o = orders(spark, d).withColumns({"a": one(key, F.lit(1)), "b": one(F.when(key % 3 != 0, key), F.when(F.col("o_orderkey") % 4 == 0, 2).otherwise(1))})
    return o.select("o_orderkey", N.same_candidate("a", "b").alias("same"))


@query("import_registry", "SELECT o_custkey % 20 AS fingerprint, count(DISTINCT o_orderkey % 50) AS n, CAST(min(o_orderkey % 50) AS BIGINT) AS least FROM orders GROUP BY 1")
def import_registry(spark, d):
    """Imports of one recipe are joined, their papers unique."""
    o = orders(spark, d).select((F.col("o_custkey") % 20).alias("fingerprint"), (F.col("o_orderkey") % 50).alias("p"), "o_orderstatus")
    listed = lambda t: t.groupBy("fingerprint").agg(F.collect_set("p").alias("paper_ids"))
    return N.upsert(listed(o.where("o_orderstatus = 'F'")), listed(o.where("o_orderstatus <> 'F'"))).select("fingerprint", F.size("paper_ids").cast("long").alias("n"), F.array_min("paper_ids").alias("least"))


TURNS = "t AS (SELECT conv_id AS agent, turn + 1 AS step, length(coalesce(text, '')) AS n, role FROM conversations), e AS (SELECT *, n % 3 <> 0 AS calls, n % 11 = 0 AS failed FROM t WHERE step <= 4), w AS (SELECT *, min(CASE WHEN failed OR NOT calls THEN step END) OVER (PARTITION BY agent) AS stop FROM e), k AS (SELECT * FROM w WHERE stop IS NULL OR step <= stop)"


@query("agent_outcomes", f"WITH {TURNS} SELECT agent, CASE WHEN bool_or(failed) THEN 'error' WHEN bool_and(calls) THEN 'max_steps' WHEN bool_or(NOT calls AND n % 2 = 0) THEN 'length' ELSE 'final' END AS stop_reason, max(step) AS steps_used, coalesce(max_by(role, step) FILTER (NOT failed), '') AS final_text, CAST(sum(CASE WHEN failed THEN 0 ELSE n END) AS BIGINT) AS tokens FROM k GROUP BY agent")
def agent_outcomes(spark, d):
    """Conversations as recorded agents with four steps: which end by themselves, by their length, by a failure or by the budget."""
    n = F.char_length(F.coalesce("text", F.lit("")))
    turns = V.table(spark, d, "conversations").select(F.col("conv_id").alias("agent"), (F.col("turn") + 1).alias("step"), (n % 3).alias("n_calls"), F.when(n % 2 == 0, "length").otherwise("stop").alias("finish_reason"), F.when(n % 11 == 0, "TimeoutError").alias("error"), F.col("role").alias("content"), n.cast("long").alias("tokens"))
    return R.agent_outcomes(turns, 4)


@query("claim_match", f"WITH {V.ROUNDS}, r AS (SELECT paper, min(CASE WHEN failure_mode = 'ACCEPTED' THEN round END) AS accepted, max(round) AS last FROM rounds GROUP BY paper) SELECT paper, CASE WHEN paper % 3 <> 0 THEN last IS NOT DISTINCT FROM accepted END AS matches FROM r")
def claim_match(spark, d):
    s = M.paper_summaries(V.rounds(spark, d))
    return s.select("paper", N.claim_matches(F.col("paper") % 3 != 0, F.col("n_rounds").cast("int"), F.col("accepted_round")).alias("matches"))


@query("id_union", "SELECT o_orderkey, concat_ws(',', o_custkey, CASE WHEN o_orderkey <> o_custkey THEN o_orderkey END, CASE WHEN o_orderkey + 1 <> o_custkey THEN o_orderkey + 1 END) AS ids FROM orders")
def id_union(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return orders(spark, d).select("o_orderkey", F.array_join(N.merged_ids(F.array(c, k), F.array(k, k + 1, c)), ",").alias("ids"))


@query("run_throughput", "SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS tokens, sum(user_id) / (max(event_id) + 1.0) AS tokens_per_s, count(*) FILTER (event_id % 3 = 0) AS n_stop, count(*) FILTER (event_id % 3 = 1) AS n_length, array_to_string(list_sort(list(DISTINCT CASE WHEN event_id % 3 = 2 THEN 'e' || user_id % 7 END))[:5], ',') AS errors FROM events GROUP BY event_type")
def run_throughput(spark, d):
    r = V.table(spark, d, "events").select("event_type", F.col("user_id").alias("tokens"), (F.max("event_id").over(V.Window.partitionBy("event_type")) + 1.0).alias("wall_s"), F.element_at(F.array(F.lit("stop"), F.lit("length"), F.lit("error")), (F.col("event_id") % 3 + 1).cast("int")).alias("finish_reason"), F.when(F.col("event_id") % 3 == 2, F.concat(F.lit("e"), F.col("user_id") % 7)).alias("error"))
    return B.throughput(r, ["event_type"]).withColumn("errors", F.array_join("errors", ","))


@query("boolean_counts", "SELECT count(*) FILTER (o_custkey % 3 = 1) AS agent_claim_mismatches, count(*) FILTER (o_orderkey % 4 = 0) AS papers_with_errors, CAST(sum(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey % 5 END) AS BIGINT) AS guardrail_events FROM orders")
def boolean_counts(spark, d):
    """Only an explicit false is a mismatch; missing lists are empty."""
    claim = F.when(F.col("o_custkey") % 3 == 0, True).when(F.col("o_custkey") % 3 == 1, False)
    errors = F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit("x"))).when(F.col("o_orderkey") % 4 == 1, F.array().cast("array<string>"))
    events = F.when(F.col("o_orderkey") % 5 != 0, F.array_repeat(F.lit("g"), (F.col("o_orderkey") % 5).cast("int")))
    return S.boolean_counts(orders(spark, d), claim, errors, events)


@query("acceptance_events", f"WITH {V.verdict_sql(H.PROSE)}, e AS (SELECT o_custkey AS paper, o_orderkey AS seq, o_orderkey // 100 AS round FROM orders JOIN verdicts ON candidate = o_orderkey WHERE all_passed AND o_orderstatus <> 'P' AND o_orderkey % 3 <> 0) SELECT paper, min((round, seq))[1] AS round, min((round, seq))[2] AS seq FROM e GROUP BY paper")
def acceptance_events(spark, d):
    o = orders(spark, d).join(V.verdicts(spark, d), F.col("candidate") == F.col("o_orderkey"))
    e = o.select(F.col("o_custkey").alias("paper"), F.floor(F.col("o_orderkey") / 100).alias("round"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 3 != 0).alias("verified"), "all_passed", F.when(F.col("o_orderstatus") != "P", True).alias("qv_passed"))
    return R.acceptance_event(e)


@query("final_gate", "SELECT o_orderkey, o_custkey % 2 = 0 AND o_custkey % 3 <> 0 AND o_custkey % 5 <> 0 AND o_orderstatus = 'F' AS passed FROM orders")
def final_gate(spark, d):
    overall = F.when(F.col("o_custkey") % 2 == 0, True).when(F.col("o_custkey") % 4 == 1, False)
    return orders(spark, d).select("o_orderkey", R.final_gate(overall, F.col("o_custkey") % 3 != 0, F.col("o_custkey") % 5 != 0, F.col("o_orderstatus") == "F").alias("passed"))


@query("judge_effort_score", f"WITH {V.ATTEMPTS} SELECT candidate, role, attempt, greatest(0.0, CAST(earned * 2 - penalty AS DOUBLE) / nullif(max_positive, 0)) AS score FROM attempts")
def judge_effort_score(spark, d):
    """Clipped at 0 only: doubled points may score more than 1."""
    a = V.attempts(spark, d)
    score = F.when(F.col("max_positive") > 0, H.judge_effort_points(F.col("earned") * 2, F.col("penalty"), F.col("max_positive"))).otherwise(0.0)
    return a.select("candidate", "role", "attempt", score.alias("score"))


@query("last_of_kind", "SELECT user_id AS paper, event_id // 500 AS round, max_by(event_id % 17, event_id) AS value FROM events WHERE event_type = 'click' AND event_id % 17 <> 3 GROUP BY ALL")
def last_of_kind(spark, d):
    e = V.table(spark, d, "events").select(F.col("user_id").alias("paper"), F.floor(F.col("event_id") / 500).alias("round"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.when(F.col("event_id") % 17 != 3, F.col("event_id") % 17).alias("value"))
    return R.last_of_kind(e, "value", "click")


# ------------------------------------------------------------------------------------------------ entry points
@query("evaluate_entry", f"WITH {V.verdict_sql(H.DEPLOYED)} SELECT candidate, weak_passed, CASE WHEN weak_passed THEN strong_passed END AS strong_passed, weak_passed AND all_passed AS all_passed FROM verdicts")
def evaluate_entry(spark, d):
    """The evaluator in stages: without a passing weak stage the strong one is not made."""
    return api.evaluate(V.marks(spark, d), H.DEPLOYED, force_strong=False).select("candidate", "weak_passed", "strong_passed", "all_passed")


@query("baseline_entry", f"WITH {V.verdict_sql(H.PROSE)}, b AS (SELECT o_orderkey AS candidate, o_orderstatus <> 'P' AS qv, o_custkey % 2 = 0 AS shape FROM orders) SELECT candidate, coalesce(qv AND all_passed, false) AS would_be_accepted, qv AND shape AS final_filter_passed, CAST(strong_total * weak_n - weak_total * strong_n AS BIGINT) AS lead FROM b LEFT JOIN verdicts USING (candidate)")
def baseline_entry(spark, d):
    """A single-shot run: every candidate is evaluated by both solvers, whatever its checks say."""
    o = orders(spark, d).select(F.col("o_orderkey").alias("candidate"), (F.col("o_orderstatus") != "P").alias("qv_passed"), (F.col("o_custkey") % 2 == 0).alias("context_ok"), F.lit(True).alias("rubric_ok"), F.lit(1).alias("question_chars"), F.lit(1).alias("n_rubric_items"), F.array().cast("array<string>").alias("errors"))
    rows, _ = api.baseline(V.marks(spark, d), o, H.PROSE)
    lead = F.col("strong_total") * F.col("weak_n") - F.col("weak_total") * F.col("strong_n")
    return rows.select("candidate", "would_be_accepted", "final_filter_passed", lead.cast("long").alias("lead"))


REPORT = f"""{V.ROUNDS}, s AS (SELECT paper, bool_or(failure_mode = 'ACCEPTED') AS accepted, count(*) AS n, max(CASE WHEN failure_mode = 'ACCEPTED' THEN round END) AS won, max(CASE WHEN failure_mode = 'ACCEPTED' THEN max_positive END) AS items,
 max(CASE WHEN failure_mode = 'ACCEPTED' THEN weak_total END) AS weak, max(CASE WHEN failure_mode = 'ACCEPTED' THEN strong_total END) AS strong FROM rounds GROUP BY paper),
m AS (SELECT failure_mode AS name, count(*) AS n FROM rounds WHERE failure_mode <> 'ACCEPTED' GROUP BY 1)
SELECT 'papers' AS section, 'papers' AS name, CAST(count(*) AS DOUBLE) AS value FROM s UNION ALL SELECT 'papers', 'accepted', count(*) FILTER (accepted) FROM s UNION ALL SELECT 'papers', 'final_accepted', count(*) FILTER (accepted AND paper % 2 = 0) FROM s
UNION ALL SELECT 'papers', 'rounds_per_paper', avg(n) FROM s UNION ALL SELECT 'papers', 'acceptance_rate', count(*) FILTER (accepted) / count(*) FROM s
UNION ALL SELECT 'failed_rounds', name, n FROM m UNION ALL SELECT 'failed_share', name, n / (SELECT sum(n) FROM m) FROM m
UNION ALL SELECT 'stop_reasons', why, count(*) FROM (SELECT CASE WHEN paper % 3 = 0 THEN '<none>' ELSE concat('r', paper % 3) END AS why FROM s) GROUP BY why
{' '.join(f"UNION ALL SELECT '{x}', '{n}', avg({c}) FROM s WHERE {w}" for x, w in (('accepted', 'accepted'), ('final', 'accepted AND paper % 2 = 0')) for n, c in (('weak_solver_avg', 'weak'), ('strong_solver_avg', 'strong'), ('gap', 'strong - weak'), ('question_length_chars', 'CASE WHEN accepted THEN paper % 100 END')))}
UNION ALL SELECT 'tokens', 'subagents_prompt', sum(n * 3) FROM s UNION ALL SELECT 'tokens', 'subagents_completion', coalesce(sum(n) FILTER (paper % 2 = 1), 0) FROM s UNION ALL SELECT 'time', 'wall_time_mean_s', avg(n * 10) FILTER (paper % 4 <> 1) FROM s
UNION ALL SELECT 'backing', 'report_backed', count(*) FILTER (accepted AND paper % 3 = 1) FROM s UNION ALL SELECT 'backing', 'summary_backed', count(*) FILTER (accepted AND paper % 3 <> 1) FROM s UNION ALL SELECT 'backing', 'qv_unbound', count(*) FILTER (accepted AND paper % 5 = 2) FROM s
UNION ALL SELECT 'tokens', 'prompt', sum(paper) FROM s UNION ALL SELECT 'tokens', 'completion', coalesce(sum(paper) FILTER (paper % 2 = 0), 0) FROM s
UNION ALL SELECT 'checks', 'agent_claim_mismatches', count(*) FILTER (paper % 5 = 0) FROM s UNION ALL SELECT 'checks', 'papers_with_errors', count(*) FILTER (paper % 4 = 0) FROM s UNION ALL SELECT 'checks', 'guardrail_events', 0
UNION ALL SELECT 'accepted', 'n', count(*) FROM s WHERE accepted UNION ALL SELECT 'accepted', 'rounds_mean', avg(won) FROM s WHERE accepted UNION ALL SELECT 'accepted', 'rounds_median', median(won) FROM s WHERE accepted UNION ALL SELECT 'accepted', 'rounds_max', max(won) FROM s WHERE accepted
UNION ALL SELECT 'accepted', 'rubric_items', avg(items) FROM s WHERE accepted UNION ALL SELECT 'final', 'n', count(*) FROM s WHERE accepted AND paper % 2 = 0 UNION ALL SELECT 'final', 'rounds_mean', avg(won) FROM s WHERE accepted AND paper % 2 = 0
UNION ALL SELECT 'final', 'rounds_median', median(won) FROM s WHERE accepted AND paper % 2 = 0 UNION ALL SELECT 'final', 'rounds_max', max(won) FROM s WHERE accepted AND paper % 2 = 0 UNION ALL SELECT 'final', 'rubric_items', avg(items) FROM s WHERE accepted AND paper % 2 = 0"""


@query("agentic_report", f"WITH {REPORT}")
def agentic_report(spark, d):
    """The whole report; scores are points, which are whole numbers, so that averages do not depend on the order of rows."""
    r = V.rounds(spark, d)
    at = lambda c: F.max(F.when(F.col("accepted"), F.col(c)))
    s = r.groupBy("paper").agg(F.bool_or("accepted").alias("accepted"), F.count("*").alias("n_rounds"), at("round").alias("accepted_round"), at("max_positive").alias("n_rubric_items"), at("weak_total").alias("weak_avg"), at("strong_total").alias("strong_avg"))
    mod = lambda n: F.col("paper") % n
    s = s.withColumns({"final_accepted": F.col("accepted") & (mod(2) == 0), "stop_reason": F.when(mod(3) != 0, F.concat(F.lit("r"), mod(3))), "claim_matches": F.when(mod(5) == 0, False), "errors": F.when(mod(4) == 0, F.array(F.lit("x"))), "guardrails": F.lit(None).cast("array<string>"), "prompt_tokens": F.col("paper"), "completion_tokens": F.when(mod(2) == 0, F.col("paper")), "gap": F.col("strong_avg") - F.col("weak_avg"), "question_chars": F.when(F.col("accepted"), mod(100))})
    s = s.withColumns({"qv_bound": F.when(mod(5) == 2, False).when(mod(5) == 3, True), "scores_source": F.when(mod(3) == 1, "report"), "subagent_prompt_tokens": F.col("n_rounds") * 3, "subagent_completion_tokens": F.when(mod(2) == 1, F.col("n_rounds")), "wall_time_s": F.when(mod(4) != 1, F.col("n_rounds") * 10)})
    return api.report(s, r)


@query("run_inspection", f"WITH {V.ROUNDS}, e AS (SELECT c_custkey AS paper, count(*) AS n FROM customer JOIN events ON user_id = c_custkey GROUP BY ALL) SELECT r.paper, count(*) AS n_rounds, bool_or(failure_mode = 'ACCEPTED') AS accepted, coalesce(max(e.n), 0) AS guardrail_events FROM rounds r LEFT JOIN e ON e.paper = r.paper GROUP BY r.paper")
def run_inspection(spark, d):
    e = V.table(spark, d, "events").select(F.col("user_id").alias("paper"), F.col("event_type").alias("kind"), F.lit(False).alias("informational"))
    return api.inspect(V.rounds(spark, d), e).select("paper", "n_rounds", "accepted", "guardrail_events")


@query("summary_entry", f"WITH {V.ROUNDS}, s AS (SELECT paper, bool_or(failure_mode = 'ACCEPTED') AS accepted, max(CASE WHEN failure_mode = 'ACCEPTED' THEN round END) AS won FROM rounds GROUP BY paper) SELECT count(*) AS n, avg(won) AS rounds_mean, max(won) AS rounds_max, median(won) AS rounds_median FROM s WHERE accepted")
def summary_entry(spark, d):
    """Statistics of the newest summary of each paper; every paper has an older one that does not count."""
    r = V.rounds(spark, d).groupBy("paper").agg(F.bool_or("accepted").alias("accepted"), F.max(F.when(F.col("accepted"), F.col("round"))).alias("accepted_round"))
    none = F.lit(None).cast("double")
    rows = r.withColumns({"finished_at": F.lit("2024-01-02T00:00:00"), "path": F.lit("b"), "completed": F.lit(True), "weak_avg": none, "strong_avg": none, "gap": none, "question_chars": none, "n_rubric_items": none})
    older = rows.withColumns({"finished_at": F.lit("2024-01-01T00:00:00"), "accepted": F.lit(True), "accepted_round": F.lit(99)})
    _, table = api.summarise(rows.unionByName(older))
    return table.select("n", "rounds_mean", "rounds_max", "rounds_median")


LOOP = f"""{V.ROUNDS}, e AS (SELECT *, unnest([0, 1, 2]) AS k FROM rounds),
said AS (SELECT paper, CAST(round * 3 + k AS BIGINT) AS seq, ['challenger', 'quality_verifier', 'both'][k + 1] AS kind, CAST(least(round, {L.MAX_ROUNDS}) AS INT) AS round,
 CASE k WHEN 0 THEN CASE WHEN round <= {L.MAX_ROUNDS} THEN 'round' ELSE 'refused: round budget' END WHEN 1 THEN 'verified'
  ELSE CASE WHEN round > {L.MAX_ROUNDS} THEN 'refused: foreign question' WHEN coalesce(all_passed, false) AND qv_passed THEN 'accepted' WHEN coalesce(all_passed, false) THEN 'refused: no passing verification' ELSE 'evaluated' END END AS decision FROM e)
SELECT *, CASE WHEN decision = 'accepted' THEN round END AS accepted_round FROM said"""


@query("loop_state_machine", f"WITH {LOOP}")
def loop_state_machine(spark, d):
    return api.run_loop(loop_log(spark, d))


def loop_log(spark, d):
    """Rounds as an event log: challenge, verify, evaluate."""
    q = F.col("candidate").cast("string")
    event = lambda n, kind, passed: F.struct((F.col("round") * 3 + n).cast("long").alias("seq"), F.lit(kind).alias("kind"), q.alias("question"), passed.alias("passed"))
    log = F.array(event(0, "challenger", F.lit(None).cast("boolean")), event(1, "quality_verifier", F.col("qv_passed")), event(2, "both", F.coalesce("all_passed", F.lit(False))))
    return V.rounds(spark, d).select("paper", F.explode(log).alias("e")).select("paper", "e.*")


@query("loop_repeats", f"WITH {V.ROUNDS} SELECT paper, count(*) FILTER (round <= {L.MAX_ROUNDS} AND NOT (coalesce(all_passed, false) AND qv_passed)) AS cached, count(*) AS repeated, count(*) FILTER (round <= {L.MAX_ROUNDS} AND coalesce(all_passed, false) AND qv_passed) AS late FROM rounds GROUP BY paper")
def loop_repeats(spark, d):
    """Every verification and evaluation asked for twice: repeats are refused or answered from the earlier result."""
    log = loop_log(spark, d)
    twice = log.unionByName(log.where("kind <> 'challenger'").withColumn("seq", F.col("seq") + 0)).withColumn("seq", F.col("seq") * 2)
    # The second verification stands before the evaluations, the second evaluation last.
    nth = F.row_number().over(V.Window.partitionBy("paper", "seq", "kind").orderBy("kind")) - 1
    got = L.replay(twice.withColumn("seq", F.col("seq") + nth).select("paper", "seq", "kind", "question", "passed"))
    n = lambda decision: F.count_if(F.col("decision") == decision)
    return got.groupBy("paper").agg(n("cached").alias("cached"), n("refused: repeated verification").alias("repeated"), n("refused: after acceptance").alias("late"))
