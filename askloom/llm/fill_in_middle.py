"""Fill-in-middle transformation, as relations of units.

A text is cut into units, the matches of a pattern from left to right (code points, words with their spaces, lines). Cut requests
name unit ordinals; what they need is the place of that unit in the text. So units are rows:

1. matches are exploded with their positions, first runs of BLOCK units, then the units of each run; a run's rows are folded at once
   (partial aggregation) into its count and length, so unit rows are neither sorted nor shuffled;
2. running sums over a document's runs, in a window, give the ordinal and the place where each run begins;
3. cut requests are rows too (row, cut, ordinal) and join the run whose ordinals hold theirs;
4. the places of a document's cuts are aggregated per document and meet its text again, which is then cut by ``substring``.

All four steps share one hash partitioning by row number: texts are exchanged once, and that exchange is reused by each step.

A document is *plain* (left as it is) if it is empty, holds a marker or its hash says so; otherwise its three parts are written as
``<P>prefix<S>suffix<M>middle`` (psm) or ``<S>suffix<P>prefix<M>middle`` (spm). Choices are hashes of the id, so reruns agree.

Defined cases: null text is empty (n = 0, plain); a null id is hashed as an empty string; ids of any type and repeated ids are
rows like others (rows of one id and one text get one output); ties of the two cuts give an empty middle; an empty table gives an
empty result; other columns are ignored, whatever their names; whole texts are cut, however long: no step holds more of a text
than the text itself, its runs of units and one run's units.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read, text_of

#: Units of a run: rows of the window are that much fewer than units, and that many units are matched again around each cut.
BLOCK = 128
CODE_POINT = "."
#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")


def units_pattern(unit: str, most: int = 0) -> str:
    """One unit, or a run of up to ``most`` units: what the unit's pattern leaves unmatched is a unit a code point, so units tile the text.

    The quantifier is possessive: the runs are exactly the units matched one after another. The pattern must not match empty strings
    nor look around.
    """
    one = unit if unit == CODE_POINT else f"(?:(?:{unit})|.)"
    return f"(?s){one}{{1,{most}}}+" if most else f"(?s){one}"


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def cut_places(docs: DataFrame, points: Callable[[Column, Column], Column], unit: str = CODE_POINT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: row_id, id, text, n (units) and places: for each ordinal in ``points(id, n)`` the code points before that unit."""
    one, run = units_pattern(unit), units_pattern(unit, BLOCK)
    texts = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("id"), text_of(text_col).alias("text")).repartition("row_id")

    runs = texts.select("row_id", "id", F.posexplode(matches(F.col("text"), run)).alias("run", "piece"))
    units = runs.select("row_id", "id", "run", F.posexplode(matches(F.col("piece"), one)).alias("at", "unit"))
    sizes = units.groupBy("row_id", "id", "run").agg(F.count("*").alias("units"), F.sum(F.char_length("unit")).alias("chars"))
    before = Window.partitionBy("row_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    starts = sizes.select("row_id", "units", "chars", so_far("units").alias("first_unit"), so_far("chars").alias("first_char"))

    pieces = matches(F.col("text"), run)  # all runs but the last are full
    counted = texts.select("row_id", "id", pieces.alias("pieces")).select("row_id", "id", F.when(F.size("pieces") == 0, F.lit(0)).otherwise((F.size("pieces") - 1) * BLOCK + F.size(matches(F.element_at("pieces", -1), one))).cast("long").alias("n"))
    requests = counted.select("row_id", "n", F.posexplode(points(F.col("id"), F.col("n"))).alias("cut", "ordinal"))

    held = (F.col("ordinal") >= F.col("first_unit")) & ((F.col("ordinal") < F.col("first_unit") + F.col("units")) | ((F.col("ordinal") == F.col("n")) & (F.col("first_unit") + F.col("units") == F.col("n"))))
    met = requests.join(starts, "row_id").where(held)
    found = met.groupBy("row_id").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("cut", "first_char", "chars", (F.col("ordinal") - F.col("first_unit")).alias("inner")))).alias("cuts"))

    def place(c: Column) -> Column:
        piece = F.substring(F.col("text"), (c["first_char"] + 1).cast("int"), c["chars"].cast("int"))
        ahead = F.slice(matches(piece, one), F.lit(1), c["inner"].cast("int"))
        return c["first_char"] + F.aggregate(ahead, F.lit(0).cast("long"), lambda s, u: s + F.char_length(u))

    joined = texts.join(found.hint("shuffle_hash"), "row_id", "left")
    return joined.select("row_id", "id", "text", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.transform("cuts", place).alias("places"))


def hash_part(id_: Column, k: int, salt: str = "1") -> Column:
    """The k-th group of eight hex digits, from 1, of the sha256 of ``salt:id``, as an unsigned integer."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def cut_points(id_: Column, n: Column, salt: str = "1") -> Column:
    """Two ordinals from 0 to n, ascending."""
    a, b = (hash_part(id_, k, salt) % (n + 1) for k in (1, 2))
    return F.array(F.least(a, b), F.greatest(a, b))


def fill_in_middle(docs: DataFrame, unit: str = CODE_POINT, plain_percent: int = 10, spm_percent: int = 20, salt: str = "1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n (units), form, prefix_chars and middle_chars (null if plain), output."""
    cut = cut_places(docs, lambda id_, n: cut_points(id_, n, salt), unit, id_col, text_col)
    text, (p, s, m) = F.col("text"), MARKS
    plain = (text == "") | text.contains(p) | text.contains(s) | text.contains(m) | (hash_part(F.col("id"), 3, salt) % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(hash_part(F.col("id"), 4, salt) % 100 < spm_percent, "spm").otherwise("psm")
    formed = cut.select("id", "text", "n", form.alias("form"), F.col("places")[0].alias("a"), F.col("places")[1].alias("b"))
    a, b, whole = F.col("a").cast("int"), F.col("b").cast("int"), F.char_length("text")
    prefix, middle, suffix = F.substring(text, F.lit(1), a), F.substring(text, a + 1, b - a), F.substring(text, b + 1, whole - b)
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(p), prefix, F.lit(s), suffix, F.lit(m), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(s), suffix, F.lit(p), prefix, F.lit(m), middle))
        .otherwise(text)
    )
    unless_plain = lambda c: F.when(F.col("form") != "plain", c)
    return formed.select("id", "n", "form", unless_plain(F.col("a")).alias("prefix_chars"), unless_plain(F.col("b") - F.col("a")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: its parts hold no marker, so the first of each marker ends the part before it."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        i, j = F.instr(output, F.lit(second)), F.instr(output, F.lit(MARKS[2]))
        cut = lambda lo, hi: F.substring(output, lo, hi - lo)
        return cut(F.lit(len(first) + 1), i), cut(i + len(second), j), cut(j + len(MARKS[2]), F.char_length(output) + 1)

    prefix, suffix, middle = parts(MARKS[0], MARKS[1])
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(MARKS[1], MARKS[0])
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def query(spark, sf_dir: str) -> DataFrame:
    done = fill_in_middle(read(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c, 256)
    return done.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: DuckDB SQL for the query's rows: a code point a unit, so places are ordinals.
SQL = r"""
with h as (
  select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n,
         list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(sha256('1:' || coalesce(cast(doc_id as varchar), '')), cast(k as bigint), 8))::bigint) as h
  from documents),
c as (
  select *, least(h[1] % (n + 1), h[2] % (n + 1)) as a, greatest(h[1] % (n + 1), h[2] % (n + 1)) as b,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h[3] % 100 >= 90 then 'plain'
              when h[4] % 100 < 20 then 'spm' else 'psm' end as form
  from h),
p as (select *, substr(text, 1, a) as prefix, substr(text, a + 1, b - a) as middle, substr(text, b + 1) as suffix from c)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(a as bigint) end as prefix_chars, case when form <> 'plain' then cast(b - a as bigint) end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(text) as restored_sha256
from p
"""
