"""Benchmark decontamination with an FM-index per shard of the documents.

Words are runs of ASCII letters (A-Z lowered), digits and characters beyond ASCII. A phrase is a window of consecutive words of a
benchmark item, or the whole item if it has fewer. Each task gathers its documents in shards of about SHARD words and, per shard:

* numbers the words that phrases have; every other word, and the end of a document, is a *break*, which no phrase can span;
* sorts the suffixes of the stretches between breaks by prefix doubling (numpy) and keeps, as the FM-index, the Burrows-Wheeler
  transform as a wavelet tree (one bit vector a level, ranks by popcount), the counts of smaller symbols, and the text positions of
  every SAMPLE-th place and of each stretch's start;
* searches all phrases at once backwards, from their last word, through the ranks of the wavelet tree: what is left is one range of
  suffixes a phrase;
* locates each occurrence by stepping back to the next sampled position, and merges the words hit into removal spans.

The phrases are the stated query set. They go to tasks with the function, in passes of at most PASS_WORDS words of items each (longer
items are cut into overlapping parts): with one pass the documents are scanned once; with more they are numbered and written once,
each pass yields the spans of hit documents only, and spans and items are merged by row number.

Defined cases: null text has no words; items without words have no phrases; equal item rows count once, rows of one item_id are one
item, a null item_id is an empty string; null and repeated document ids (of any type) are rows like others; empty tables give an
empty result or no hits; other columns are ignored; whole texts are searched, however long (a shard holds one document at least).

Scale: no shuffle of texts, work linear in words but for sorting; memory of a task is some 150 bytes for each word of a shard.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field, lean, numbered, read, ship, small_batches, stage, text_of

WINDOW = 10
#: Words, and documents, of a shard.
SHARD, SHARD_DOCS = 1 << 20, 1 << 17
#: Every so many text positions one is kept for locating.
SAMPLE = 8
#: Words of benchmark items searched in one pass over the documents, and of one part of an item.
PASS_WORDS, PART = 1 << 17, 10_000
WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
#: The same words in Spark's and DuckDB's patterns, after lowering A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPAN = "struct<start:long,end:long>"


def words_of(text: bytes | None) -> list[bytes]:
    """bytes.lower() changes A-Z alone."""
    return WORD_BYTES.findall((text or b"").lower())


class Phrases:
    """The distinct windows of some items: ``symbols`` (word numbers from 1, right-aligned, -1 before shorter ones) and their items."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int):
        self.window, self.number = window, {}
        rows, of = {}, []
        for item, words in items:
            w = [self.number.setdefault(x.encode(), len(self.number) + 1) for x in words]
            for k in range(max(1, len(w) - window + 1) if w else 0):
                part = tuple(w[k : k + window])
                of.append((rows.setdefault(part, len(rows)), item))
        self.lengths = np.array([len(p) for p in rows], np.int64)
        self.symbols = np.full((len(rows), window), -1, np.int64)
        for k, p in enumerate(rows):
            self.symbols[k, window - len(p) :] = p
        self.names = sorted({item for _, item in of})
        at = {x: k for k, x in enumerate(self.names)}
        pairs = np.unique(np.array([(r, at[item]) for r, item in of], np.int64).reshape(-1, 2), axis=0)
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1))
        self.items = pairs[:, 1]

    def items_of(self, doc: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, item) of (document, phrase)."""
        n = self.first[row + 1] - self.first[row]
        item = self.items[np.repeat(self.first[row] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        key = np.unique(np.repeat(doc, n) * len(self.names) + item)
        return key // max(1, len(self.names)), key % max(1, len(self.names))


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Positions of ``s`` (symbols; 0 is a break, and the last is one) in the order of their suffixes; breaks are all different,
    ordered by position. Prefix doubling: only suffixes that tie with others are sorted again."""
    n = len(s)
    breaks = np.flatnonzero(s == 0)
    until = breaks[np.searchsorted(breaks, np.arange(n))]  # the next break
    bits = max(1, int(s.max()).bit_length())
    h = max(1, 62 // bits)  # symbols that fit one number
    key, alive = np.zeros(n, np.int64), np.arange(n)
    for k in range(h):
        at = np.minimum(alive + k, until)
        key = (key << bits) | s[at]
    # breaks come first, by position
    key[breaks] = np.arange(len(breaks)) - len(breaks)
    order = np.argsort(key, kind="stable")
    rank, slots = np.empty(n, np.int64), np.arange(n)
    key = key[order]
    pos = order
    while True:
        new = np.concatenate([[True], key[1:] != key[:-1]])
        start = np.flatnonzero(new)
        rank[pos] = slots[start[np.cumsum(new) - 1]]
        size = np.diff(np.append(start, len(pos)))
        tied = np.repeat(size > 1, size)
        if not tied.any():
            return order
        slots, pos = slots[tied], pos[tied]
        key = rank[pos] * n + rank[np.minimum(pos + h, until[pos])]
        again = np.argsort(key, kind="stable")
        pos, key = pos[again], key[again]
        order[slots] = pos
        h *= 2


class Bits:
    """A bit vector with ranks."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        w = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & below)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletTree:
    """Symbols by level, the highest bit first; at each level those with a 0 stand before those with a 1."""

    def __init__(self, s: np.ndarray, n_symbols: int):
        self.levels, self.zeros = [], []
        for b in range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1):
            one = (s >> b) & 1 != 0
            self.levels.append((b, Bits(one)))
            self.zeros.append(int(len(s) - one.sum()))
            s = np.concatenate([s[~one], s[one]])
        every = np.arange(n_symbols)
        self.base = self.down(every, np.zeros(n_symbols, np.int64))  # where each symbol begins at the lowest level

    def down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for (b, bits), zeros in zip(self.levels, self.zeros):
            ones = bits.rank(i)
            i = np.where((c >> b) & 1 != 0, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands before i."""
        return self.down(c, i) - self.base[c]

    def get(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and how often it stands before i."""
        c = np.zeros(len(i), np.int64)
        for (b, bits), zeros in zip(self.levels, self.zeros):
            one, ones = bits.get(i), bits.rank(i)
            c |= one.astype(np.int64) << b
            i = np.where(one, zeros + ones, i - ones)
        return c, i - self.base[c]


class FMIndex:
    def __init__(self, s: np.ndarray, n_symbols: int, sample: int = SAMPLE):
        """``s``: symbols below n_symbols; 0 is a break, and the last symbol is one."""
        order = suffix_order(s)
        bwt = s[order - 1]  # before position 0 stands the last symbol, a break
        self.tree = WaveletTree(bwt, n_symbols)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=n_symbols))])
        kept = (order % sample == 0) | (bwt == 0)  # no step back ever leaves a stretch
        self.kept, self.position = Bits(kept), order[kept]

    def search(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes, [lo, hi), that begin with each row of symbols (right-aligned, -1 before shorter rows)."""
        last = symbols[:, -1]
        lo, hi = self.smaller[last].copy(), self.smaller[last + 1].copy()
        for t in range(symbols.shape[1] - 2, -1, -1):
            live = np.flatnonzero((lo < hi) & (symbols[:, t] >= 0))
            if not len(live):
                break
            c = symbols[live, t]
            lo[live] = self.smaller[c] + self.tree.rank(c, lo[live])
            hi[live] = self.smaller[c] + self.tree.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps back to a kept one."""
        out, at, steps = np.empty(len(row), np.int64), np.arange(len(row)), 0
        while len(at):
            there = self.kept.get(row)
            out[at[there]] = self.position[self.kept.rank(row[there])] + steps
            at, row = at[~there], row[~there]
            c, n = self.tree.get(row)
            row, steps = self.smaller[c] + n, steps + 1
        return out


def stretches(words: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the stretches of at least ``least`` phrase words, each with a break after it, and the word each symbol stands for.

    ``words``: word numbers of all documents one after another, 0 for words that no phrase has; ``starts``: where documents begin.
    """
    n = len(words)
    begins = np.zeros(n, bool)
    begins[starts[starts < n]] = True
    known = words > 0
    opens = known & (begins | np.concatenate([[True], ~known[:-1]]))
    number = np.cumsum(opens) - 1  # of the stretch, where known
    size = np.bincount(number[known]) if known.any() else np.zeros(0, np.int64)
    long = known.copy()
    long[known] = size[number[known]] >= least
    place = np.flatnonzero(long)
    if not len(place):
        return np.zeros(0, np.int64), place
    shift = np.cumsum(opens[place]) - 1  # breaks before
    s, of = np.zeros(len(place) + int(shift[-1]) + 1, np.int64), np.full(len(place) + int(shift[-1]) + 1, -1, np.int64)
    at = np.arange(len(place)) + shift
    s[at], of[at] = words[place], place
    return s, of


def search_shard(counts: np.ndarray, words: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents with so many words each: hit words a document; spans as (document, first word, end); (document, item)."""
    n, starts = len(words), np.concatenate([[0], np.cumsum(counts)])
    none = np.zeros(0, np.int64)
    s, place = stretches(words, starts[:-1], int(phrases.lengths.min())) if len(phrases.lengths) else (none, none)
    if not len(s):
        return np.zeros(len(counts), np.int64), np.zeros((0, 3), np.int64), none, none, none
    index = FMIndex(s, len(phrases.number) + 1)
    lo, hi = index.search(phrases.symbols)
    phrase = np.repeat(np.arange(len(lo)), hi - lo)
    ends = np.cumsum(hi - lo)
    row = np.arange(len(phrase)) - np.repeat(ends - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
    first = place[index.locate(row)]
    doc = np.searchsorted(starts, first, "right") - 1
    change = np.bincount(first, minlength=n + 1) - np.bincount(first + phrases.lengths[phrase], minlength=n + 1)
    hit = np.cumsum(change)[:n] > 0
    before = np.concatenate([[0], np.cumsum(hit)])
    n_hit = before[starts[1:]] - before[starts[:-1]]
    begins = np.zeros(n + 1, bool)
    begins[starts] = True
    opens = np.flatnonzero(hit & (begins[:n] | np.concatenate([[True], ~hit[:-1]])))
    closes = np.flatnonzero(hit & (begins[1:] | np.concatenate([~hit[1:], [True]]))) + 1
    of = np.searchsorted(starts, opens, "right") - 1
    spans = np.stack([of, opens - starts[of], closes - starts[of]], axis=1)
    key = np.unique(doc * len(phrases.lengths) + phrase)
    return n_hit, spans, *phrases.items_of(key // len(phrases.lengths), key % len(phrases.lengths)), before


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of these spans and what stands between them."""
    places, out, at = [m.span() for m in WORD_BYTES.finditer(text.lower())], [], 0
    for first, end in spans:
        out.append(text[at : places[first][0]])
        at = places[end - 1][1]
    return b"".join([*out, text[at:]])


def scan(rows: DataFrame, phrases: Phrases, cleaned: bool, shard: int) -> DataFrame:
    """``rows``: id and text. One row each: id, n_words, n_hit, spans (of words), items, and the cleaned text (null if nothing is hit)."""
    span_type = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def out(ids: list, counts: list[int], parts: list[np.ndarray], texts: list[bytes | None]) -> pa.RecordBatch:
        n = np.array(counts, np.int64)
        n_hit, spans, doc, item, _ = search_shard(n, np.concatenate([np.zeros(0, np.int64), *parts]), phrases)
        docs = np.arange(len(n) + 1)
        of_span = pa.ListArray.from_arrays(pa.array(np.searchsorted(spans[:, 0], docs), pa.int32()), pa.StructArray.from_arrays([pa.array(spans[:, 1]), pa.array(spans[:, 2])], fields=list(span_type)))
        names = pa.array(phrases.names, pa.string()).take(pa.array(item))
        of_item = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, docs), pa.int32()), names)
        clean = [None] * len(n)
        if cleaned:
            for k in np.flatnonzero(n_hit).tolist():
                clean[k] = without(texts[k], [tuple(x) for x in spans[spans[:, 0] == k, 1:].tolist()])
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays(ids), pa.array(n), pa.array(n_hit), of_span, of_item, pa.array(clean, pa.binary()).cast(pa.string())],
            ["id", "n_words", "n_hit", "spans", "items", "cleaned"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        number = phrases.number.get
        ids, counts, parts, texts, total = [], [], [], [], 0
        for b in batches:
            begun = 0
            for k, text in enumerate(b.column("text").cast(pa.large_binary()).to_pylist()):
                words = words_of(text)
                counts.append(len(words))
                parts.append(np.array([number(w, 0) for w in words], np.int64))
                texts.append(text if cleaned else None)
                total += len(words)
                if total >= shard or len(counts) >= SHARD_DOCS:
                    ids.append(b.column("id").slice(begun, k + 1 - begun))
                    yield out(ids, counts, parts, texts)
                    ids, counts, parts, texts, total, begun = [], [], [], [], 0, k + 1
            if begun < b.num_rows:
                ids.append(b.column("id").slice(begun))
        if counts:
            yield out(ids, counts, parts, texts)

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {id_type}, n_words long, n_hit long, spans array<{SPAN}>, items array<string>, cleaned string")


def item_words(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct items: item (string), part, words; parts of an item overlap so that each window stands in one."""
    lowered = F.translate(text_of(text_col), UPPER, LOWER)
    words = items.select(text_of(F.col(id_col).cast("string")).alias("item"), F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)).alias("words")).where(F.size("words") > 0).distinct()
    step = PART - window + 1
    return words.select("item", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - window), F.lit(step))).alias("from")).select("item", F.slice("words", F.col("from") + 1, F.lit(PART)).alias("words"))


def passes(parts: DataFrame, most: int) -> list[DataFrame]:
    """The parts in groups, by hashes, of at most ``most`` words each (or one part)."""
    n, size = 1, F.sum(F.size("words")).alias("words")
    while True:
        dealt = parts.withColumn("pass", F.pmod(F.xxhash64("item", "words"), F.lit(n)))
        largest, rows = dealt.groupBy("pass").agg(size, F.count("*").alias("n")).agg(F.max(F.when(F.col("n") > 1, F.col("words"))), F.count("*")).first()
        if (largest or 0) <= most:
            return [dealt.where(F.col("pass") == k).drop("pass") for k in range(n)] if rows else []
        n = max(n + 1, n * largest // most + 1)


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, cleaned: bool = False, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most: int = PASS_WORDS, shard: int = SHARD) -> DataFrame:
    """One row per input row: id, n_words, n_hit (words within any occurrence of a phrase), spans (merged, as word numbers), items
    (sorted, distinct); ``cleaned`` (text without the spans; null where nothing is hit, or if it is not asked for)."""
    small_batches(docs.sparkSession)
    parts = stage(item_words(items, item_col, item_text, window), "decontamination-items")
    groups = passes(parts, most)
    load = lambda g: Phrases(sorted((r.item, r.words) for r in g.toLocalIterator()), window)
    if len(groups) <= 1:
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        return scan(rows, load(groups[0]) if groups else Phrases([], window), cleaned, shard)
    rows = numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "decontamination-rows")
    slim = rows.select(F.col("__row_id").alias("id"), field("text").alias("text"))
    found = None
    for k, g in enumerate(groups):
        one = scan(slim, load(g), False, shard).drop("cleaned")
        one = stage(one if k == 0 else one.where("n_hit > 0"), "decontamination-spans")  # the first pass has a row for each document
        found = one if found is None else found.unionByName(one)
    merged = found.groupBy("id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    empty = F.expr(f"cast(array() as array<{SPAN}>)")

    def join(so_far, x):
        last = F.element_at(so_far, -1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        meets = (F.size(so_far) > 0) & (x["start"] <= F.try_element_at(so_far, F.lit(-1))["end"])
        return F.when(meets, F.concat(F.slice(so_far, F.lit(1), F.greatest(F.size(so_far) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(so_far, F.array(x)))

    spans = F.aggregate(F.array_sort("all"), empty, join)
    merged = merged.select("id", "n_words", "items", spans.alias("spans")).select("id", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]).alias("n_hit"), "spans", "items")
    met = rows.select("__row_id", field("id").alias("id"), *([field("text").alias("text")] if cleaned else [])).join(merged.withColumnRenamed("id", "__row_id"), "__row_id")
    if not cleaned:
        return met.select("id", "n_words", "n_hit", "spans", "items", F.lit(None).cast("string").alias("cleaned"))

    @F.udf("string", useArrow=True)
    def cut(text, spans):
        return without(text.encode(), [(s["start"], s["end"]) for s in spans]).decode() if spans else None

    return met.select("id", "n_words", "n_hit", "spans", "items", cut("text", "spans").alias("cleaned"))


def query(spark, sf_dir: str) -> DataFrame:
    found = contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = rf"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as w from documents),
i as (
  select distinct coalesce(cast(item_id as varchar), '') as item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as w from benchmark),
p as (
  select distinct item, w[k : k + {WINDOW - 1}] as phrase, least(len(w), {WINDOW}) as n
  from (select item, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) as k from i where len(w) > 0)),
g as (
  select r, k, n, w[k : k + n - 1] as phrase
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as k from d, (select distinct n from p) where len(w) >= n)),
o as (select distinct g.r, g.k, g.n, p.item from g join p on g.n = p.n and g.phrase = p.phrase),
hits as (select r, count(distinct x) as n_hit from (select r, unnest(range(k, k + n)) as x from (select distinct r, k, n from o)) group by r),
its as (select r, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct r, item from o) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits using (r) left join its using (r)
"""

ship(__name__)
