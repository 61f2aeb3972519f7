"""Mixing sources to target weights, by blocks of words.

Native: DataFrame functions only. Each source is one stream: its documents in pseudorandom order, packed into blocks of
``BLOCK`` words. The mix is a set of output shards of ``SLOTS`` block slots. A shard's source counts are a multinomial draw
(every slot draws its source, with chances in proportion to the quotas); slots drawn above a source's quota are handed to the
sources still below theirs, so totals come out exact. Slot i of a source maps to block perm(i mod n) of pass i div n, where perm
is a keyed swap-or-not shuffle of the n block indexes; blocks and documents then meet by an equi-join on (source, block index).

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating; they share 150 % of all words; a target stops at
twice its source's size and the excess is shared again by weight until none is above (water filling). As a block is taken at
most twice, no document is taken more than twice over.

Defined cases: null text or no words: size 0 and nothing taken; a null source is a source of its own; repeated rows are
documents of their own; an empty table gives an empty result; the same rows give the same mix, however they are split (all
chance is hashed from ids and texts; of rows with one id and text it is open which of them gets which share); columns of any
name pass through.

Scale: positions within a source are two-level prefix sums over hashed buckets, so a source with a third of all rows is spread
over BUCKETS windows, and rows alike in id and text are combined before (``common.laid_out``). What has a row per source is
broadcast while there are at most FEW sources, and merged beyond; a slot finds its source by an equi-join on BINS of the number line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW_ID, WORD, field, laid_out, numbered, read, stage, text_of

BLOCK = 128  # words
SLOTS = 1024  # blocks in an output shard
BUCKETS = 1024  # parts of a source's stream
ROUNDS = 24  # of the swap-or-not shuffle
SHARE = 1.5
LIMIT = 2  # times its size that a source is taken
WEIGHTS = (5, 2, 1)
FEW = 100_000  # sources whose table (some 100 bytes a row) may be broadcast
BINS = 4096  # of the line of all slots


def shuffled(i: Column, n: Column, *key: Column) -> Column:
    """Index i under a pseudorandom permutation of 0..n-1 (swap-or-not, Hoang, Morris and Rogaway 2012)."""

    def swap(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(r, *key), n) - x, n)
        return F.when(F.pmod(F.xxhash64(r, F.greatest(x, partner), *key), F.lit(2)) == 1, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), i.cast("long"), swap)


def uniform(*key: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11) / F.lit(float(2**53))


def per_source(table: DataFrame, n: int) -> DataFrame:
    """A table of about ``n`` rows, one for each source, as it is to be joined."""
    return F.broadcast(table) if n <= FEW else table.hint("merge")


def located(points: DataFrame, x: str, intervals: DataFrame, n: int, total: Column) -> DataFrame:
    """``points`` with the columns of the interval (lo, hi) that holds x; disjoint intervals, their row count n; ``total`` is a column of both."""
    bin_of = lambda c: F.floor(c * BINS / total).cast("long")
    spread = intervals.withColumn("bin", F.explode(F.sequence(bin_of(F.col("lo")), bin_of(F.col("hi") - 1)))).drop("total")
    met = points.withColumn("bin", bin_of(F.col(x))).join(per_source(spread, n + BINS), "bin")
    return met.where((F.col(x) >= F.col("lo")) & (F.col(x) < F.col("hi"))).drop("bin", "lo", "hi")


def sized(docs: DataFrame, id_col: Column, text_col: Column, source_col: Column, row_id: Column) -> tuple[DataFrame, DataFrame]:
    """The sources' streams as (units, offsets) of :func:`common.laid_out`: lane skey (never null) and source, payload id."""
    source = source_col.cast("string")
    base = docs.select(
        row_id.alias("row_id"),
        id_col.alias("id"),
        source.alias("source"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit("null")).alias("skey"),
        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(id_col, id_col.isNull(), text_col, text_col.isNull()).alias("h1"),
        F.xxhash64(F.lit(1), text_col, text_col.isNull(), id_col, id_col.isNull()).alias("h2"),
    )
    return laid_out(base.withColumn("bucket", F.pmod("h1", F.lit(BUCKETS))), ["skey", "source"], ["h1", "h2"], ["id"], "mix-units")


def targets(offsets: DataFrame) -> DataFrame:
    """One row per source: skey, source, source_size, target (words), blocks n, quota (block slots)."""
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("place") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    by_name, rows = Window.orderBy(F.col("source").asc_nulls_last()), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = offsets.groupBy("skey", "source").agg(F.sum("words").alias("source_size")).withColumn("place", F.row_number().over(by_name)).withColumn("w", w.cast("double"))
    t = t.withColumn("want", F.lit(SHARE) * F.sum("source_size").over(rows)).withColumn("full", F.col("source_size") * float(LIMIT))
    # Water filling: in order of full / w, sources fill up until the level that spends the rest among the others is no higher.
    by_level = Window.orderBy(F.col("full") / F.col("w"), "place")
    t = t.withColumn("spent", F.coalesce(F.sum("full").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("open_w", F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("level", F.greatest(F.lit(0.0), F.col("want") - F.col("spent")) / F.col("open_w"))
    t = t.withColumn("final", F.max(F.when(F.col("level") * F.col("w") <= F.col("full"), F.col("level"))).over(rows))
    t = t.withColumn("target", F.least("full", F.coalesce(F.col("final") * F.col("w"), F.col("full"))))
    n = F.ceil(F.col("source_size") / BLOCK)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    quota = F.least(F.col("n") * LIMIT, F.col("passes") * F.col("n") + F.round((F.col("target") - F.col("passes") * F.col("source_size")) / BLOCK).cast("long"))
    return t.select("skey", "source", "place", "source_size", "target", n.cast("long").alias("n"), passes.cast("long").alias("passes")).withColumn("quota", quota)


def positions(units: DataFrame, offsets: DataFrame) -> DataFrame:
    """Each row's start word in its source's stream: row_id, id, skey, size, start."""
    outer = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = offsets.select("skey", "bucket", F.coalesce(F.sum("words").over(outer), F.lit(0)).alias("begin"))
    placed = units.select("skey", "bucket", "size", "start", "rows").join(begins, ["skey", "bucket"])
    each = placed.select("skey", "size", (F.col("begin") + F.col("start")).alias("start"), F.posexplode("rows").alias("nth", "row"))
    return each.select("row.row_id", "row.id", "skey", "size", (F.col("start") + F.col("nth") * F.col("size")).alias("start"))


def slots(sources: DataFrame, seed: int = 1) -> DataFrame:
    """Every slot of the mix: shard, slot, skey, i (the source's slot number), n."""
    n_sources = sources.count()
    upto = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    live = sources.where("quota > 0").withColumn("lo", F.sum("quota").over(upto) - F.col("quota")).withColumn("total", F.sum("quota").over(whole))
    plan = live.agg(F.sum("quota").alias("total")).where("total > 0")
    # A fixed number of partitions: adaptive coalescing judges by the few bytes of the shard numbers, not by the slots they become.
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = plan.select(F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / SLOTS))).alias("shard"), "total").repartition(tasks, "shard")
    each = shards.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(SLOTS).cast("long"), F.col("total") - F.col("shard") * SLOTS) - 1)).alias("slot"), "total")
    points = each.withColumn("at", F.floor(uniform(F.lit(seed), F.col("shard"), F.col("slot")) * F.col("total")))
    cuts = live.select("skey", "lo", (F.col("lo") + F.col("quota")).alias("hi"), "total")
    drawn = located(points, "at", cuts, n_sources, F.col("total")).select("shard", "slot", "skey")
    drawn = drawn.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "skey").orderBy("slot")) - 1)
    # Prefix sums of the shards' counts number each source's slots.
    counts = drawn.groupBy("skey", "shard").agg(F.count("*").alias("c"))
    starts = counts.withColumn("first", F.sum("c").over(Window.partitionBy("skey").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c"))
    drawn = drawn.join(starts.drop("c").hint("merge"), ["skey", "shard"]).select("shard", "slot", "skey", (F.col("first") + F.col("nth")).alias("i"))
    # Draws above a quota go to the sources below theirs, in order.
    got = live.join(counts.groupBy("skey").agg(F.sum("c").alias("got")), "skey", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    got = got.withColumn("over", F.greatest(F.col("got") - F.col("quota"), F.lit(0))).withColumn("under", F.greatest(F.col("quota") - F.col("got"), F.lit(0)))
    got = stage(got.withColumn("over_before", F.sum("over").over(upto) - F.col("over")).withColumn("under_before", F.sum("under").over(upto) - F.col("under")).coalesce(1), "mix-drawn")
    own = drawn.join(per_source(got.select("skey", "quota", "over_before", "total"), n_sources), "skey")
    spare = F.col("i") >= F.col("quota")
    kept = own.where(~spare).select("shard", "slot", "skey", "i")
    x = own.where(spare).select("shard", "slot", (F.col("over_before") + F.col("i") - F.col("quota")).alias("x"), "total")
    room = got.where("under > 0").select("skey", "got", F.col("under_before").alias("first"), F.col("under_before").alias("lo"), (F.col("under_before") + F.col("under")).alias("hi"), "total")
    handed = located(x, "x", room, n_sources, F.col("total")).select("shard", "slot", "skey", (F.col("got") + F.col("x") - F.col("first")).alias("i"))
    return kept.unionByName(handed).join(per_source(live.select("skey", "n"), n_sources), "skey")


def blocks_taken(sources: DataFrame, seed: int = 1) -> DataFrame:
    """skey, block, times: how often the mix takes each block."""
    s = slots(sources, seed)
    block = shuffled(F.pmod("i", "n"), F.col("n"), F.lit(seed), F.col("skey"), F.floor(F.col("i") / F.col("n")))
    return s.select("skey", block.alias("block")).groupBy("skey", "block").agg(F.count("*").alias("times"))


def pieces(units: DataFrame, offsets: DataFrame, seed: int = 1) -> DataFrame:
    """Every row cut at block bounds: row_id, id, skey, size, first word, words, times (0 for a block or a row that is not taken), source_size, target."""
    sources = stage(targets(offsets).coalesce(1), "mix-targets")
    lo, hi = F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK)
    cut = positions(units, offsets).withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(lo, hi))))
    first = F.greatest(F.col("block") * BLOCK - F.col("start"), F.lit(0))
    cut = cut.withColumn("first", first).withColumn("words", F.least((F.col("block") + 1) * BLOCK - F.col("start"), F.col("size")) - F.col("first"))
    # Planned by size, the slots would look as small as the table of sources that they come from, and be broadcast.
    out = cut.join(blocks_taken(sources, seed).hint("merge"), ["skey", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))
    return out.join(per_source(sources.select("skey", "source_size", "target"), sources.count()), "skey")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1) -> DataFrame:
    """One row per input row: row_id, id, size, source_size, target, taken."""
    p = pieces(*sized(docs, F.col(id_col), F.col(text_col), F.col(source_col), F.monotonically_increasing_id()), seed)
    taken = F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).cast("long")
    return p.groupBy("row_id").agg(F.first("id").alias("id"), F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), taken.alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1, written: bool = False) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: one row per document and pass, whose text is the words that pass takes.

    A pass that takes every word keeps the text as it was; else the taken words are joined by single spaces. Rows of which
    nothing is taken go. If there is an ``n_chars`` column it follows the new text.
    """
    rows = numbered(docs, "mix-rows", written)
    p = pieces(*sized(rows, field(id_col), field(text_col), field(source_col), F.col(ROW_ID)), seed).where("times > 0")
    p = p.withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    spans = p.groupBy(F.col("row_id").alias(ROW_ID), "pass").agg(F.sum("words").alias("n"), F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("first", "words"))).alias("spans"))
    words = F.regexp_extract_all(text_of(field(text_col)), F.lit(WORD), F.lit(0))
    cut = F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(F.col("split"), (s["first"] + 1).cast("int"), s["words"].cast("int")))), " ")
    base = rows.join(spans, ROW_ID).withColumn("split", F.when(F.col("n") < F.col("size"), words))
    base = base.withColumn("now", F.when(F.col("n") < F.col("size"), cut).otherwise(field(text_col)))
    new = {text_col: F.col("now")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("now").cast(docs.schema["n_chars"].dataType)
    return base.select(*[new.get(c, field(c)).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
