"""Building a corpus from raw records: ordered classification, metadata lookup, tally, cut at N, and the corpus profile.

Order is carried in columns (shard, line), never implied. Windows are partitioned by record id; the only global order, the cut
at the N-th kept row, is resolved from per-range counts, so no task sorts all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..staging import stage
from .ordered import nth
from .ordered import percentiles as exact_percentiles

# The outcomes of a scanned record, in the order of the checks.
OUTCOMES = ["bad_record", "already_in_output", "duplicate", "body_too_short", "body_too_long", "not_found", "year_missing", "year_too_old", "not_in_field", "no_abstract", "kept"]


#: Records of one id from which on its first places are broadcast.
HOT = 1_000_000
#: Lines that a shard may have, for a place as one number.
LINES = 1 << 40


@dataclass(frozen=True)
class Filters:
    min_year: int = 2022
    field: str = "Computer Science"
    min_body: int = 8_000
    max_body: int = 200_000
    min_abstract: int = 50


def body_outcome(n: Column, f: Filters) -> Column:
    return F.when(n < f.min_body, "body_too_short").when(n > f.max_body, "body_too_long")


def has_abstract(abstract: Column, f: Filters) -> Column:
    return F.coalesce(F.char_length(T.strip(abstract)) >= max(1, f.min_abstract), F.lit(False))


def metadata_outcome(found: Column, year: Column, fields: Column, abstract: Column, f: Filters) -> Column:
    """The first failing check of a record's metadata, else null."""
    return (
        F.when(~found, "not_found")
        .when(year.isNull(), "year_missing")
        .when(year < f.min_year, "year_too_old")
        .when(~F.coalesce(F.array_contains(fields, f.field), F.lit(False)), "not_in_field")
        .when(~has_abstract(abstract, f), "no_abstract")
    )


def parse_id(raw: Column) -> Column:
    """An integer id out of a variant (a number, cut to an integer, or a string of one); null for anything else, booleans too."""
    kind = F.schema_of_variant(raw)
    number = ~F.coalesce(kind.isin("BOOLEAN", "VOID", "STRING"), F.lit(True))
    text = F.trim(F.try_variant_get(raw, "$", "string"))
    return F.when(number, F.try_variant_get(raw, "$", "bigint")).when((kind == "STRING") & text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint"))


def field_categories(fields: Column) -> Column:
    """Distinct non-empty categories in the order they first appear."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(fields, F.array()), lambda x: x["category"]), lambda c: c.isNotNull() & (c != "")))


def author_names(raw: Column) -> Column:
    """Names out of a variant array whose entries are strings or objects (name, or first, middle and last)."""

    def name(x: Column) -> Column:
        get = lambda p, t="string": F.try_variant_get(x, p, t)
        parts = F.concat(F.array(get("$.first")), F.coalesce(get("$.middle", "array<string>"), F.array().cast("array<string>")), F.array(get("$.last")))
        joined = F.array_join(F.filter(parts, lambda p: p.isNotNull()), " ")
        kind = F.schema_of_variant(x)
        return F.when(kind == "STRING", get("$")).when(kind.startswith("OBJECT"), F.coalesce(F.nullif(get("$.name"), F.lit("")), joined))

    return F.filter(F.transform(F.try_variant_get(raw, "$", "array<variant>"), lambda x: T.one_line(name(x))), lambda n: n.isNotNull() & (n != ""))


def external_ids(api: Column, shard: Column) -> Column:
    """The metadata's entries that are not empty; the shard's where there are none."""
    full = lambda m: F.map_filter(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull() & (v != ""))
    return F.when(F.size(full(api)) > 0, full(api)).otherwise(full(shard))


def build_record(title: Column, shard_title: Column, abstract: Column, year: Column, body: Column, api_ids: Column, shard_ids: Column) -> Column:
    """The fields of a kept record: the metadata's title, else the shard's, both on one line; trimmed abstract; body and its length."""
    line = lambda c: F.nullif(T.one_line(c), F.lit(""))
    text = F.coalesce(body, F.lit(""))
    return F.struct(
        F.coalesce(line(title), line(shard_title), F.lit("")).alias("title"),
        T.strip(F.coalesce(abstract, F.lit(""))).alias("abstract"),
        year.cast("int").alias("year"),
        external_ids(api_ids, shard_ids).alias("external_ids"),
        text.alias("body_text"),
        F.char_length(text).alias("n_body_chars"),
    )


#: What of a shard's record is kept while it waits for its metadata.
SLIM = ["corpusid", "title", "authors", "openaccessinfo.externalids", "body.text"]


def slim(record: Column) -> Column:
    """The few paths of a record (variant) that are needed later, each as JSON."""
    return F.struct(*[F.to_json(F.try_variant_get(record, f"$.{p}", "variant")).alias(p.rsplit(".", 1)[-1]) for p in SLIM])


def paper_text(title: Column, abstract: Column, body: Column) -> Column:
    e = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit("Title: "), e(title), F.lit("\n\nAbstract: "), e(abstract), F.lit("\n\n"), e(body))


def classify(records: DataFrame, f: Filters, existing: DataFrame | None = None) -> DataFrame:
    """records: shard, line, corpus_id (null: bad record), body_chars -> with outcome (null: to be looked up) and repeated.

    Checks in order: bad_record, already_in_output, duplicate, body length. A record whose body is out of range does not claim
    its id, so a later record of that id can still be kept.
    """
    at = F.struct("shard", "line")
    rows = records.withColumn("at", at).withColumn("body", body_outcome(F.col("body_chars"), f))
    good, bad = rows.where("corpus_id IS NOT NULL"), rows.where("corpus_id IS NULL")
    # The first places of ids that occur more than once, by partial aggregates. Those of more than HOT records are few (at most a
    # HOT-th of all records) and are broadcast; their records then carry no id into the other join, but a number that spreads them.
    firsts = good.groupBy(F.col("corpus_id").alias("f_id")).agg(F.count("*").alias("n"), F.min("at").alias("first"), F.min(F.when(F.col("body").isNull(), F.col("at"))).alias("claimed")).where("n > 1")
    hot = firsts.where(F.col("n") > HOT).select(F.col("f_id").alias("h_id"), F.col("first").alias("h_first"), F.col("claimed").alias("h_claimed"))
    cold = firsts.where(F.col("n") <= HOT).select("f_id", "first", "claimed", F.lit(0).alias("f_spread"))
    good = good.join(F.broadcast(hot), F.col("corpus_id") == F.col("h_id"), "left")
    is_hot = F.col("h_id").isNotNull()
    good = good.withColumn("spread", F.when(is_hot, F.pmod(F.xxhash64("at"), F.lit(1 << 20)).cast("int")).otherwise(0))
    good = good.join(cold, (F.when(~is_hot, F.col("corpus_id")) == F.col("f_id")) & (F.col("spread") == F.col("f_spread")), "left")
    good = good.withColumn("first", F.coalesce("h_first", "first")).withColumn("claimed", F.coalesce("h_claimed", "claimed"))
    if existing is None:
        good = good.withColumn("known", F.lit(False))
    else:
        good = good.join(existing.select("corpus_id", F.lit(True).alias("known")).distinct(), "corpus_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    outcome = F.when(F.col("known"), "already_in_output").when(F.col("at") > F.col("claimed"), "duplicate").otherwise(F.col("body"))
    good = good.withColumn("outcome", outcome).withColumn("repeated", F.coalesce(F.col("at") > F.col("first"), F.lit(False)))
    bad = bad.withColumn("known", F.lit(False)).withColumn("outcome", F.lit("bad_record")).withColumn("repeated", F.lit(False))
    columns = [*records.columns, "outcome", "repeated"]
    return good.select(*columns).unionByName(bad.select(*columns))


def look_up(classified: DataFrame, metadata: DataFrame, f: Filters) -> DataFrame:
    """Left join of metadata (corpus_id, year, fields, abstract; unique ids) and the final outcome of every record.

    Only records still open are looked up: the others' key is null for the join.
    """
    m = metadata.select(F.col("corpus_id").alias("m_id"), F.col("year").alias("m_year"), F.col("fields").alias("m_fields"), F.col("abstract").alias("m_abstract"))
    open_id = F.when(F.col("outcome").isNull(), F.col("corpus_id"))
    joined = classified.join(m, open_id == F.col("m_id"), "left").withColumn("looked_up", F.col("outcome").isNull())
    final = F.coalesce("outcome", metadata_outcome(F.col("m_id").isNotNull(), F.col("m_year"), F.col("m_fields"), F.col("m_abstract"), f), F.lit("kept"))
    return joined.withColumn("outcome", final)


def cut_at(outcomes: DataFrame, n: int, already: int = 0) -> DataFrame:
    """The rows up to and including the one that is the n-th kept, counting ``already`` kept before; in (shard, line) order.

    Outcomes (slim rows, no texts) are written once; the place of the (n - already)-th kept one is found by counts over ranges of
    places (:func:`ordered.nth`), so neither a sort nor a task with n rows is needed, however large n is.
    """
    left = n - already
    if left <= 0:
        return outcomes.where(F.lit(False))
    rows = stage(outcomes, "outcomes")
    place = F.col("shard").cast("long") * F.lit(LINES) + F.col("line").cast("long")
    last = nth(rows.where("outcome = 'kept'").select(place.alias("place")), "place", left)
    return rows if last is None else rows.where(place <= F.lit(last))


def tally(outcomes: DataFrame) -> DataFrame:
    """One row per shard with a count per outcome, records scanned, looked up and repeated."""
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    return outcomes.groupBy("shard").agg(F.count("*").alias("scanned"), F.count_if("looked_up").alias("looked_up"), F.count_if("repeated").alias("repeated"), *counts)


def totals(outcomes: DataFrame) -> DataFrame:
    """The tally of every shard and of all of them (shard null)."""
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    return outcomes.rollup("shard").agg(F.count("*").alias("scanned"), *counts)


def marginals(looked: DataFrame, f: Filters) -> DataFrame:
    """Overlapping conditions of the records looked up, each counted by itself."""
    found = F.col("m_id").isNotNull()
    year = F.coalesce(F.col("m_year") >= f.min_year, F.lit(False))
    field = F.coalesce(F.array_contains("m_fields", f.field), F.lit(False))
    c = lambda cond, name: F.count_if(found & cond).alias(name)
    return looked.where("looked_up").groupBy("shard").agg(F.count("*").alias("n_looked_up"), c(F.lit(True), "meta_found"), c(year, "meta_year_ok"), c(field, "meta_in_field"), c(year & field, "meta_year_ok_and_in_field"), c(has_abstract(F.col("m_abstract"), f), "meta_has_abstract"))


def select_papers(records: DataFrame, order: str, raw_id: Column, rendered: Column, offset: int = 0, limit: int | None = None, min_chars: int = 0, wanted: DataFrame | None = None) -> DataFrame:
    """Papers for a run: id filter, first of each id, offset on the record's index, least length of the rendered text, limit.

    ``order`` is the column with the record's index from 0. ``wanted`` has a column paper_id.
    """
    rows = records.withColumn("paper_id", T.safe_id(raw_id)).withColumn("raw_id", raw_id).withColumn("text_chars", F.char_length(rendered))
    if wanted is not None:
        # Two equality joins, not an OR: by the clean id, and by the raw one for what that left out.
        w = wanted.select(F.col("paper_id").alias("w_id")).distinct()
        by_clean = rows.join(w, F.col("paper_id") == F.col("w_id"), "left_semi")
        rest = rows.join(w, F.col("paper_id") == F.col("w_id"), "left_anti").join(w, F.col("raw_id") == F.col("w_id"), "left_semi")
        rows = by_clean.unionByName(rest)
    first = Window.partitionBy("paper_id").orderBy(order)
    rows = rows.withColumn("nth", F.row_number().over(first)).where((F.col("nth") == 1) & (F.col(order) >= offset) & (F.col("text_chars") >= min_chars)).drop("nth", "raw_id")
    return rows if limit is None else rows.orderBy(order).limit(limit)


FRACTIONS = {"min": 0.0, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "max": 1.0}


def percentiles(rows: DataFrame, value: Column, by: list[str] | None = None) -> DataFrame:
    """min, p10, p25, p50, p75, p90, max (linear interpolation) and mean, exact, by ranks of the counted values."""
    by = by or []
    p = exact_percentiles(rows.select(*by, value.alias("__v")), by, ["__v"], list(FRACTIONS.values()))
    return p.select(*by, *[F.get("points", i).alias(n) for i, n in enumerate(FRACTIONS)], "mean")


def histogram(rows: DataFrame, value: Column, first: Column, name: str = "value") -> DataFrame:
    """Counts by value with the first position it has, so ties have an order."""
    return rows.groupBy(value.alias(name)).agg(F.count("*").alias("n"), F.min(first).alias("first_pos"))


def top_values(rows: DataFrame, value: Column, first: Column, k: int = 15, name: str = "value") -> DataFrame:
    """The k most frequent values, ties by first position; an empty value shows as <empty>."""
    shown = F.when(value.isNull() | (value == ""), "<empty>").otherwise(value)
    return histogram(rows, shown, first, name).orderBy(F.desc("n"), "first_pos").limit(k)


def duplicate_titles(rows: DataFrame, title: Column) -> DataFrame:
    t = T.norm_title(title)
    return rows.groupBy(t.alias("title")).agg(F.count("*").alias("n")).where("title <> '' AND n > 1")


def quality_flags(rows: DataFrame, body: Column, most: int | None = 20_000, start: int | None = 2_000) -> DataFrame:
    """Language and shape flags of each body. ``most`` and ``start`` bound what is read; None reads whole texts."""
    # Token arrays are computed once per row and dropped again; the start is the whole where neither is bounded.
    whole = most is None and start is None
    w = rows.withColumn("_w", T.words(body, most))
    if not whole:
        w = w.withColumn("_s", T.words(body if start is None else F.substring(body, 1, start)))
    for tag in ("_w",) if whole else ("_w", "_s"):
        n = F.size(tag)
        w = w.withColumn(f"{tag}_en", T.share(T.word_hits(F.col(tag), T.ENGLISH_WORDS), n)).withColumn(f"{tag}_other", T.share(T.word_hits(F.col(tag), T.OTHER_WORDS), n))
    if whole:
        w = w.withColumns({"_s_en": F.col("_w_en"), "_s_other": F.col("_w_other")})
    w = w.withColumn("ascii_letter_share", T.ascii_letter_share(body, most)).withColumn("alpha_share", T.alpha_share(body))
    strict = T.looks_non_english(F.col("_w_en"), F.col("_w_other"), F.col("ascii_letter_share"))
    return w.withColumns(
        {
            "non_english": strict,
            "non_english_start": ~strict & T.looks_non_english(F.col("_s_en"), F.col("_s_other"), F.lit(1.0), strict=False),
            "low_alpha": F.col("alpha_share") < 0.6,
            "lowercase_start": T.starts_lowercase(body),
        }
    ).withColumnsRenamed({"_w_en": "english_share", "_w_other": "other_share"}).drop("_w", "_s", "_s_en", "_s_other")


def abstract_repeated(abstract: Column, body: Column, head: int = 150, least: int = 50, window: int | None = 6_000) -> Column:
    """Whether the squashed body's start holds the first ``head`` characters of the squashed abstract."""
    a = F.substring(T.squash(abstract), 1, head)
    b = T.squash(body if window is None else F.substring(body, 1, window))
    return (F.char_length(a) >= least) & F.contains(b, a)


def resume_violations(stored: DataFrame, f: Filters, release: str, shards: list[int]) -> DataFrame:
    """Reasons why stored records break the active recipe, with counts and the first five ids; a record may have several."""
    meta = metadata_outcome(F.lit(True), F.col("year"), F.col("s2_fields"), F.col("abstract"), f)
    wrong = lambda ok, name: F.when(~F.coalesce(ok, F.lit(False)), name)
    reasons = F.array_compact(F.array(meta, body_outcome(F.char_length(F.coalesce("body_text", F.lit(""))), f), wrong(F.col("release_id") == release, "release_id"), wrong(F.col("shard").isin(shards), "shard")))
    bad = stored.withColumn("reason", F.explode(reasons))
    nth = F.row_number().over(Window.partitionBy("reason").orderBy("paper_id"))  # five a reason survive before the shuffle
    first = bad.withColumn("nth", nth).where("nth <= 5").groupBy("reason").agg(F.array_sort(F.collect_list("paper_id")).alias("examples"))
    return bad.groupBy("reason").agg(F.count("*").alias("n")).join(first, "reason")


def containment(texts: DataFrame, items: DataFrame, text: str = "text", item: str = "item") -> DataFrame:
    """Pairs of rows whose squashed text contains the squashed item, by an equi-join on anchors.

    An item's inner words stand whole in any text that contains it; its longest run of up to four of them is the anchor, joined
    with the runs of that length of every text, and containment is verified. Items of fewer than three words have no inner word
    and meet the texts by a nested loop, meant for a few short items.
    """
    t = texts.withColumn("_t", T.squash(F.coalesce(F.col(text), F.lit("")))).withColumn("_row", F.monotonically_increasing_id())
    i = items.withColumn("_i", T.squash(F.coalesce(F.col(item), F.lit("")))).withColumn("_w", F.split("_i", " "))
    size = F.least(F.size("_w") - 2, F.lit(4))
    anchored = i.where(F.size("_w") >= 3).withColumn("_k", size).withColumn("_anchor", F.xxhash64(F.array_join(F.slice("_w", F.lit(2), size), " ")))
    runs = lambda v, k: F.transform(T.word_runs(v, k), lambda x: F.struct(F.lit(k).alias("k"), F.xxhash64(x).alias("anchor")))
    # Hashes only, of one pass over the texts, of the lengths (at most four) that anchors have: the text itself meets its few
    # candidates afterwards.
    lengths = sorted(r[0] for r in anchored.select("_k").distinct().collect()) or [4]
    every = T.let(F.split("_t", " "), lambda v: F.concat(*[runs(v, k) for k in lengths]))
    keys = t.select("_row", F.explode(every).alias("x")).select("_row", F.col("x.k").alias("_k"), F.col("x.anchor").alias("_anchor"))
    pairs = keys.join(anchored.select("_k", "_anchor").distinct(), ["_k", "_anchor"], "left_semi").distinct().join(anchored, ["_k", "_anchor"])
    long = t.join(pairs.drop("_k", "_anchor", "_w"), "_row").where(F.contains("_t", F.col("_i")))
    short = t.join(i.where(F.size("_w") < 3).drop("_w"), F.contains("_t", F.col("_i")))
    keep = [*texts.columns, *items.columns]
    return long.select(*keep).unionByName(short.select(*keep))


FLAGS = ["non_english", "non_english_start", "low_alpha", "lowercase_start", "abstract_repeated"]
SIZES = ["n_body_chars", "paper_text_chars", "abstract_chars", "n_authors"]


def flagged(rows: DataFrame, most: int | None = 20_000, start: int | None = 2_000, window: int | None = 6_000) -> DataFrame:
    """``rows`` (title, abstract, body and more) with the quality flags and the shares they come from."""
    body = F.coalesce("body", F.lit(""))
    return quality_flags(rows, body, most, start).withColumn("abstract_repeated", abstract_repeated(F.coalesce("abstract", F.lit("")), body, window=window))


def profile(rows: DataFrame, f: Filters, shown: int = 15, examples: int = 10, most: int | None = 20_000, start: int | None = 2_000, window: int | None = 6_000) -> DataFrame:
    """A stored corpus in one table of (section, value, n, number, first, examples).

    rows: place (orders the corpus), paper_id, corpus_id, title, abstract, body, year, shard, release_id, fields (array),
    external_ids (map), venue, publication_date, authors (array). Sections: count (records, unique and duplicate ids, duplicate
    titles, only_field, empty_venue, missing_date, no_authors), the histograms year, shard, release, field, external_id and venue
    (the ``shown`` most frequent), the sizes with their percentiles and mean in ``number``, and flag. ``first`` is the smallest
    place; ``examples`` are the first ``examples`` papers of a flag, the smallest duplicate ids, the first duplicate titles.

    Texts are read in one scan, which leaves a slim written row each; all sections are aggregates of those.
    """
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    strings = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    listed = lambda conditions: F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in conditions.items()]))
    conditions = {"records": F.lit(True), "only_field": F.col("fields").eqNullSafe(F.array(F.lit(f.field))), "empty_venue": e("venue") == "", "missing_date": e("publication_date") == "", "no_authors": F.size(strings("authors")) == 0}
    sizes = {"n_body_chars": F.char_length(e("body")), "paper_text_chars": F.char_length(paper_text(F.col("title"), F.col("abstract"), F.col("body"))), "abstract_chars": F.char_length(e("abstract")), "n_authors": F.size(strings("authors"))}
    one = lambda section, value: F.array(F.struct(F.lit(section).alias("section"), value.cast("string").alias("value")))
    many = lambda section, values: F.transform(values, lambda v: F.struct(F.lit(section).alias("section"), v.alias("value")))
    shown_as = lambda c, name: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(name))
    marks = F.concat(
        many("count", listed(conditions)), one("year", shown_as("year", "<none>")), one("shard", shown_as("shard", "<none>")), one("release", shown_as("release_id", "<none>")),
        many("field", strings("fields")), many("external_id", F.coalesce(F.map_keys("external_ids"), none)), one("venue", shown_as("venue", "<empty>")), many("flag", listed({n: F.col(n) for n in FLAGS})),
    )
    slim = stage(flagged(rows, most, start, window).select("place", F.col("paper_id").cast("string").alias("paper_id"), "corpus_id", T.norm_title(F.col("title")).alias("title"), marks.alias("marks"), *[c.cast("long").alias(n) for n, c in sizes.items()]), "profile")
    marked = slim.select("place", "paper_id", F.explode("marks").alias("m")).select("place", "paper_id", "m.section", "m.value")
    counted = marked.groupBy("section", "value").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    # Ranks up to a bound: every task passes on that many rows a group at most.
    nth_of = F.row_number().over(Window.partitionBy("value").orderBy("place"))
    some = marked.where("section = 'flag'").withColumn("nth", nth_of).where(F.col("nth") <= examples).groupBy("section", "value").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "paper_id"))), lambda x: x["paper_id"]).alias("examples"))
    rank = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("n"), "first"))
    venues = counted.where("section = 'venue'").withColumn("rank", rank).where(F.col("rank") <= shown).drop("rank")
    empty = F.lit(None).cast("double").alias("number")
    histograms = counted.where("section <> 'venue'").unionByName(venues).join(some, ["section", "value"], "left").select("section", "value", "n", empty, "first", "examples")
    ids = slim.groupBy("corpus_id").agg(F.count("*").alias("n"))
    titles = slim.where("title <> ''").groupBy("title").agg(F.count("*").alias("n")).where("n > 1")

    def repeated(rows: DataFrame, value: str, name: str) -> DataFrame:
        """How many values are repeated, with the smallest ones."""
        least = rows.orderBy(value).limit(examples).agg(F.array_sort(F.collect_list(value)).alias("x"))
        both = rows.agg(F.count("*").alias("n")).crossJoin(F.broadcast(least))  # one row each
        return both.select(F.lit("count").alias("section"), F.lit(name).alias("value"), "n", empty, F.lit(None).cast(slim.schema["place"].dataType).alias("first"), F.transform("x", lambda v: v.cast("string")).alias("examples"))

    unique = ids.agg(F.count("*").alias("n")).select(F.lit("count").alias("section"), F.lit("unique_ids").alias("value"), "n", empty, F.lit(None).cast(slim.schema["place"].dataType).alias("first"), F.lit(None).cast("array<string>").alias("examples"))
    points = exact_percentiles(slim, [], SIZES, list(FRACTIONS.values()))
    shape = F.array(F.struct(F.lit("mean").alias("value"), F.col("mean").alias("number")), *[F.struct(F.lit(n).alias("value"), F.get("points", i).alias("number")) for i, n in enumerate(FRACTIONS)])
    sized = points.select("measure", "n", F.explode(shape).alias("x")).select(F.col("measure").alias("section"), "x.value", "n", "x.number", F.lit(None).cast(slim.schema["place"].dataType).alias("first"), F.lit(None).cast("array<string>").alias("examples"))
    return histograms.unionByName(unique).unionByName(repeated(ids.where("n > 1").select("corpus_id"), "corpus_id", "duplicate_ids")).unionByName(repeated(titles.select("title"), "title", "duplicate_titles")).unionByName(sized)
